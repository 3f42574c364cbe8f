"""Resampling of documents towards a target's word distribution (importance resampling on hashed features).

1. Each task reads its texts into a word trie: a node is a run of 1 to ``most`` words and holds how often the run occurred and the
   CRC-32 state after its bytes, from which a longer run's state goes on. At ``NODES`` nodes the counts go into the task's bucket
   totals and a new trie begins, so a task's memory does not grow with its texts.
2. The bucket totals of all tasks are summed: at most ``buckets`` rows for the corpus and as many for the target, whatever their
   size. The driver turns them into the gain of each bucket.
3. A second pass walks each document's runs along tries whose nodes have the gain of their bucket attached, and sums the gains.
4. The draw: a document's score is its floored mean gain plus a Gumbel number that its id alone decides, so the highest scores are a sample
   without replacement. Scores are whole numbers in a range of some ten thousand, so a count for each score gives the score down to which
   documents are drawn; only those are put in order, over sorted ranges that are numbered one after another.

Defined cases: a null or empty text has no features, weight 0, and is not drawn (under ``least`` words); repeated rows are rows of their
own with equal scores, in any order among themselves; a null doc_id is hashed as the empty string and comes last among ties; an empty
target or corpus has totals of 0; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.sql import _LOW, _UP
from spanweave.llm.text import Words, distinct_keys, text_chunks, words_of
from spanweave.scratch import Scratch

MOST, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Nodes of a task's trie, at some 200 bytes each.
NODES = 300_000

_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


class WordTrie:
    """Runs of 1 to ``most`` words as nodes. ``crc[node]`` is the CRC-32 of the run's words joined by single spaces."""

    def __init__(self, most: int):
        self.most = most
        self._first: dict[bytes, int] = {}
        self._longer: dict[int, int] = {}
        self._spelt: dict[int, bytes] = {}
        self.crc = array("I")

    def __len__(self) -> int:
        return len(self.crc)

    def _node(self, state: int) -> int:
        self.crc.append(state)
        return len(self.crc) - 1

    def walk(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of run: (document of each run of that length, its node). Unknown runs become nodes."""
        doc = np.repeat(np.arange(len(words.offs) - 1), np.diff(words.offs))
        at, number = distinct_keys(words.hashes, words.second)
        raw, single = words.data.tobytes(), np.empty(len(at), np.int64)
        for i, (a, b) in enumerate(zip(words.starts[at].tolist(), words.ends[at].tolist())):
            word = raw[a:b]
            node = self._first.get(word)
            if node is None:
                node = self._first[word] = self._node(zlib.crc32(word))
                if self.most > 1:
                    self._spelt[node] = word
            single[i] = node
        word = single[number] if len(at) else np.zeros(0, np.int64)
        nodes = word
        yield doc, nodes
        for n in range(2, self.most + 1):
            inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
            prefix, last = nodes[: len(doc) - n + 1], word[n - 1 :]
            nodes = np.full(len(inside), -1)  # of runs that would leave their document: none
            keys, back = np.unique((prefix[inside] << 32) | last[inside], return_inverse=True)
            found = np.empty(len(keys), np.int64)
            for i, key in enumerate(keys.tolist()):
                node = self._longer.get(key)
                if node is None:
                    node = self._longer[key] = self._node(zlib.crc32(b" " + self._spelt[key & 0xFFFFFFFF], self.crc[key >> 32]))
                found[i] = node
            nodes[inside] = found[back]
            yield doc[: len(inside)][inside], nodes[inside]

    def states(self) -> np.ndarray:
        return np.array(self.crc, np.int64)


def _bucket_totals(most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie, counts = np.zeros(buckets, np.int64), WordTrie(most), np.zeros(0, np.int64)

        def empty_out():
            np.add.at(totals, trie.states()[: len(counts)] % buckets, counts)

        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column(0)):
                for _, nodes in trie.walk(words_of(data, offs, space=_BETWEEN, second=True)):
                    counts = np.concatenate([counts, np.zeros(len(trie) - len(counts), np.int64)])
                    counts += np.bincount(nodes, minlength=len(counts))
                if len(trie) > NODES:
                    empty_out()
                    trie, counts = WordTrie(most), np.zeros(0, np.int64)
        empty_out()
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some])], ["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    rows = (
        texts.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(_bucket_totals(most, buckets), "bucket int, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"]] = rows["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's smoothed share in the target over that in the corpus, floored."""
    b, big, small = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratio = [(t + 1.0) * big / ((s + 1.0) * small) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64) if b else np.zeros(0, np.int64)


def _gain_sums(most: int, gains):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of, trie = gains.value, WordTrie(most)
        attached = np.zeros(0, np.int64)
        for batch in batches:
            for i, j, data, offs in text_chunks(batch.column(1)):
                words = words_of(data, offs, space=_BETWEEN, second=True)
                total, number = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for doc, nodes in trie.walk(words):
                    if len(attached) < len(trie):
                        attached = np.concatenate([attached, gain_of[np.array(trie.crc[len(attached) :], np.int64) % len(gain_of)]])
                    ends = np.concatenate([[0], np.cumsum(attached[nodes])])
                    edges = np.searchsorted(doc, np.arange(j - i + 1))
                    total += ends[edges[1:]] - ends[edges[:-1]]
                    number += np.diff(edges)
                if len(trie) > NODES:
                    trie, attached = WordTrie(most), np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(words.offs)), pa.array(number), pa.array(total)], ["doc_id", "n_words", "n_features", "total"]
                )

    return run


def weights(docs: DataFrame, gains: np.ndarray, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _gain_sums(most, shared), "doc_id long, n_words long, n_features long, total long"
    )
    mean = F.expr("CASE WHEN n_features = 0 THEN 0 ELSE (total - pmod(total, n_features)) div n_features END")
    return rows.select("doc_id", "n_words", "n_features", mean.alias("weight"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, most: int = MOST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null unless drawn) of every row of ``docs`` (doc_id, text); ``target`` has
    text. Of the documents with ``least`` words, ``percent`` of a hundred are drawn."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "resample")
    gains = bucket_gains(bucket_totals(docs, most, buckets), bucket_totals(target, most, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    chance = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = tmp.save(weights(docs, gains, most).withColumn("score", F.col("weight") + chance).withColumn("row", F.monotonically_increasing_id()), "scored")
    counts = scored.where(F.col("n_words") >= least).groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    wanted = int(counts["n"].sum()) * percent // 100
    reached = counts["n"].cumsum() >= wanted
    if wanted == 0:
        return scored.select("doc_id", "n_words", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    lowest = int(counts["score"][reached].iloc[0])
    near = (F.col("n_words") >= least) & (F.col("score") >= lowest)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    placed = tmp.save(
        scored.where(near).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed"
    )
    part = F.shiftright("place", 33)
    before, offsets = 0, []
    for p, n in sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        offsets.append((p, before))  # a row for each partition
        before += n
    offset = spark.createDataFrame(offsets, "p long, before long")
    number = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = placed.withColumn("p", part).join(F.broadcast(offset), "p").withColumn("rank", F.when(number <= wanted, number))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return scored.where(~near).withColumn("rank", F.lit(None).cast("long")).select(columns).unionAll(drawn.select(columns))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of a word in SQL: one step for each byte over the table of 256 states, for distinct words only.
_SQL = f"""
WITH steps AS (SELECT i, list_reduce([i] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM (SELECT unnest(range(256)) AS i)),
states AS (SELECT list(c ORDER BY i) AS t FROM steps),
texts AS (SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
split AS (SELECT row_number() OVER () AS row, kind, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
counts AS (SELECT row, kind, word, count(*) AS n FROM (SELECT row, kind, unnest(w) AS word FROM split) GROUP BY ALL),
spelt AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM counts)),
hashed AS (SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM spelt, states),
sums AS (SELECT sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t FROM counts),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM counts JOIN hashed USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((totals.t + 1) * (coalesce(sums.s, 0)::DOUBLE + 10000) / ((totals.s + 1) * (coalesce(sums.t, 0)::DOUBLE + 10000))))::BIGINT AS gain FROM totals, sums),
summed AS (SELECT row, sum(n * gain)::BIGINT AS total FROM counts JOIN hashed USING (word) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY row),
weighed AS (SELECT doc_id, len(w)::BIGINT AS n_features, CASE WHEN total IS NULL THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END AS weight,
  ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM split LEFT JOIN summed USING (row) WHERE kind = 0),
scored AS (SELECT doc_id, n_features, weight::BIGINT AS weight, weight::BIGINT + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked
"""

QUERIES = {"op13_resample": op13_resample}
ORACLE = {"op13_resample": _SQL}
