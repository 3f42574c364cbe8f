"""What the language-model scores leave on disk where the filter is not broadcast."""

from collections import Counter
from pathlib import Path

import numpy as np

from spanweave.llm import op05_lm_score
from spanweave.scratch import collecting


def test_questions_to_the_filter_are_packed(spark, monkeypatch):
    """Several chunks and segments; nulls, empty texts and repeated rows. The tables written are smaller than the texts, and scores stay."""
    monkeypatch.setattr(op05_lm_score, "SEGMENT_POSITIONS", 20_000)
    monkeypatch.setattr(op05_lm_score, "CHUNK_POSITIONS", 30_000, raising=False)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k % 997}" if k < 9_000 else f"rare{k}" for k in rng.integers(0, 10_000, 150).tolist()) for _ in range(1_000)]
    rows = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:50]), (None, texts[0]), (None, None), (7, "")], "doc_id long, text string")

    def scores(broadcast_bytes):
        got = op05_lm_score.lm_scores(rows, 500, 10**6, broadcast_bytes).collect()
        return Counter((*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in got)

    opened = []
    with collecting(opened):
        packed = scores(0)
    assert packed == scores(10**9) and sum(packed.values()) == 1_053
    written = sum(f.stat().st_size for s in opened for f in Path(s.root.removeprefix("file:")).rglob("*.parquet"))
    assert 0 < written < sum(map(len, texts))
