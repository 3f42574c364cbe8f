"""Token counts of whole texts without materialising token ids.

1. Every text is cut into pre-tokens: runs between ASCII white space. The tokenizer drops
   white space before its merges and no merge crosses it, so the tokens of a text are those
   of its pre-tokens. Each task emits its distinct pre-tokens; an aggregation leaves one row each.
2. The library counts the pieces of each distinct pre-token once.
3. Per-document frequencies are joined to the piece counts: the bounded frequent head by
   broadcast, the rest by a shuffle join on 128 bits of the pre-token's hash; a sum per document follows.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows and repeated or
null doc_id give one output row per input row; an empty table gives no rows; columns other
than doc_id and text are ignored. Special strings inside a text count as the library's
default does (one token each). Nothing is truncated.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.text import distinct_keys, mix, text_chunks, words_of
from spanweave.llm.vocab import HEAD_LIMIT, collect_sorted, head_threshold, lookup
from spanweave.scratch import Scratch

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of text whose distinct words are counted together.
TOGETHER = 4 << 20
_DOC = np.uint64(0x9E3779B97F4A7C15)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, cnt): the distinct words of some megabytes of text."""
    for batch in batches:
        for _, _, data, offs in text_chunks(batch.column(0), TOGETHER):
            words = words_of(data, offs, lower=False, second=True)
            first, number = distinct_keys(words.hashes, words.second)
            raw = words.data.tobytes()
            spans = [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(spans, pa.binary()), pa.array(np.bincount(number, minlength=len(first)))], ["w", "cnt"])


def distinct_words(docs: DataFrame) -> DataFrame:
    """Distinct words of all texts with their counts: w binary, cnt long."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_distinct_words, "w binary, cnt long").groupBy("w").agg(F.sum("cnt").alias("cnt"))


def _keys_of(words: list[bytes]) -> list[pa.Array]:
    """The two keys of each word, as in a text."""
    offs = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    found = words_of(np.frombuffer(b"".join(words), np.uint8), offs, lower=False, second=True)
    return [pa.array(k.view(np.int64)) for k in (found.hashes, found.second)]


def _piece_counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        for batch in batches:
            words = batch.column(0).to_pylist()
            out = np.zeros(len(words), np.int32)
            for i in range(0, len(words), 2000):
                part = [w.decode("utf-8", "replace") for w in words[i : i + 2000]]
                out[i : i + 2000] = [len(e.ids) for e in tok.encode_batch_fast(part, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*_keys_of(words), pa.array(out), batch.column(1)], ["h", "h2", "pieces", "cnt"])

    return run


def _document_counts(head):
    """Rows of kind 0: one per document with its bytes and the tokens of head words; rows of
    kind 1: frequencies of the words outside the head, under the same row key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, second, pieces = head.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j, data, offs in text_chunks(texts):
                words = words_of(data, offs, lower=False, second=True)
                at, known = lookup(keys, words.hashes)
                if len(keys):
                    known &= second[at] == words.second.view(np.int64)
                each = np.where(known, pieces[at] if len(keys) else 0, 0).astype(np.int64)
                run_sum = np.concatenate([[0], np.cumsum(each)])
                n = j - i
                rows = np.arange(row, row + n)
                row += n
                doc = np.repeat(np.arange(n), np.diff(words.offs))[~known]
                h, h2 = words.hashes[~known], words.second[~known]
                first, number = distinct_keys(mix(h ^ (doc.astype(np.uint64) * _DOC)), h2)
                freq = np.bincount(number, minlength=len(first))
                m = len(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([0, 1], [n, m]).astype(np.int32)),
                        pa.array(np.concatenate([rows, rows[doc[first]]])),
                        pa.concat_arrays([ids.slice(i, n).cast(pa.int64()), pa.nulls(m, pa.int64())]),
                        pa.array(np.concatenate([np.diff(offs), h[first].view(np.int64)])),
                        pa.array(np.concatenate([np.zeros(n, np.int64), h2[first].view(np.int64)])),
                        pa.array(np.concatenate([run_sum[words.offs[1:]] - run_sum[words.offs[:-1]], freq])),
                    ],
                    ["kind", "row", "doc_id", "a", "h2", "b"],
                )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, head_limit: int = HEAD_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "token-counts")
    pieces = tmp.save(
        distinct_words(docs).mapInArrow(_piece_counter(path), "h long, h2 long, pieces int, cnt long"), "pieces"
    )
    cut = head_threshold(pieces, head_limit)
    head = spark.sparkContext.broadcast(collect_sorted(pieces.where(F.col("cnt") >= cut), "h", "h2", "pieces"))
    rows = tmp.save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            _document_counts(head), "kind int, row long, doc_id long, a long, h2 long, b long"
        ),
        "rows",
        partition_by="kind",
    )
    tail = (
        rows.where("kind = 1")
        .select("row", F.col("a").alias("h"), "h2", F.col("b").alias("freq"))
        .join(pieces.where(F.col("cnt") < cut).select("h", "h2", "pieces"), ["h", "h2"])
        .groupBy("row")
        .agg(F.sum(F.col("freq") * F.col("pieces")).alias("tail"))
    )
    n = F.col("b") + F.coalesce(F.col("tail"), F.lit(0))
    return (
        rows.where("kind = 0")
        .join(tail, "row", "left")
        .select("doc_id", F.col("a").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit"))
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE: dict[str, str] = {}
