"""Vocabulary tables: word counts over a whole corpus, split into a bounded frequent head and a tail.

The head is broadcast (at most ``head_limit`` entries, so a proven bound); words of the
tail go through a shuffle join. Word frequencies are heavy-tailed, so the head covers all
but a small share of occurrences at any corpus size, and the result is exact either way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD_LIMIT = 1_000_000


def head_threshold(vocab: DataFrame, head_limit: int = HEAD_LIMIT) -> int:
    """A count c such that at most ``head_limit`` rows have cnt >= c; the smallest of those with six leading binary digits.

    The histogram of the counts so rounded has at most 32 rows for each of 63 magnitudes."""
    shift = F.greatest(F.lit(0), F.length(F.bin("cnt")) - 6).cast("int")
    rounded = F.expr("shiftleft(shiftright(cnt, _s), _s)")
    hist = (
        vocab.where("cnt > 0")
        .select("cnt", shift.alias("_s"))
        .groupBy(rounded.alias("c"))
        .agg(F.count("*").alias("n"))
        .toPandas()
        .sort_values("c", ascending=False)
    )
    total, best = 0, 2**62
    for c, n in zip(hist["c"], hist["n"]):
        total += int(n)
        if total > head_limit:
            break
        best = int(c)
    return best


def collect_sorted(df: DataFrame, key: str, *values: str) -> tuple[np.ndarray, ...]:
    """A bounded table as numpy arrays ordered by ``key`` seen as uint64."""
    table = df.select(key, *values).toArrow()
    keys = table.column(key).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return (keys[order], *(table.column(v).to_numpy()[order] for v in values))


def lookup(keys: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each query in sorted ``keys`` and whether it is there."""
    if len(keys) == 0:
        return np.zeros(len(query), np.int64), np.zeros(len(query), bool)
    at = np.minimum(np.searchsorted(keys, query), len(keys) - 1)
    return at, keys[at] == query
