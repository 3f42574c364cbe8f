"""Benchmark decontamination: short items found inside documents of any length.

Containment of an item in a document is the share of the item's distinct 5-word shingles that
the document has; an item counts as found from 80 %. Search: items are partitioned by size (powers of two of their shingle
count), and each partition has a sampling rate, so that an item's MinHash sketch (its hashes below a limit) has 16 to 32
elements, however long it is; items of up to ``SKETCH`` shingles are their own sketch. A document's sketch for a partition
is its hashes below the same limit, so the share of an item's sketch that it has estimates the containment at any size of
the document. Each sketch has its own threshold: a candidate shares so many elements that an item with 80 % is missed with
probability ``MISS`` at most (an item that is its own sketch: never). A document that is too small for a partition skips it.
Candidates are verified with the shingles' words.

Items are broadcast in blocks of at most ``BLOCK_SHINGLES`` shingles; a larger benchmark takes
more passes over the documents. Documents are never shuffled.

Defined cases: null or empty texts have no shingles and match nothing; a text of 1 to 4 words is
one shingle, so an item that short is found only in equal texts; repeated rows give repeated
pairs; empty tables give no rows; other columns are ignored (or kept, by ``clean``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import sql
from spanweave.llm.text import Words, shingle_sets, text_chunks, words_of

BLOCK_SHINGLES = 1_000_000
#: Distinct shingles shared, in percent of the item's.
PERCENT = 80
#: Elements of a sketch, at most on average.
SKETCH = 32
MISS = 1e-6


@cache
def least_shared(sketch: int) -> int:
    """The most elements that a threshold may ask for: fewer are shared with probability ``MISS`` at most where each is with ``PERCENT``."""
    p, total = PERCENT / 100, 0.0
    for c in range(sketch + 1):
        total += math.comb(sketch, c) * p**c * (1 - p) ** (sketch - c)
        if total > MISS:
            return c
    return sketch


class Items:
    """Shingle sets of a block of items, and the index of their sketches for each size partition."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.texts, self.sets = ids, texts, []
        for _, _, data, offs in text_chunks(pa.array(texts, pa.string())):
            hashes, ends = shingle_sets(words_of(data, offs))
            self.sets.extend(hashes[a:b] for a, b in zip(ends[:-1], ends[1:]))
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.grams: dict[int, set] = {}
        self.need = np.maximum(1, -(-self.size * PERCENT // 100))
        sketches: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, s in enumerate(self.sets):
            part = max(0, (max(1, len(s)) - 1).bit_length() - (SKETCH - 1).bit_length())
            sketch = s[: np.searchsorted(s, self.limit(part))] if part else s
            if part and least_shared(len(sketch)) < 1:
                part, sketch = 0, s  # an unlucky draw: too few elements for any threshold
            elif part:
                self.need[k] = least_shared(len(sketch))
            sketches.setdefault(part, []).append((k, sketch))
        self.parts = {}
        for part, held in sketches.items():
            key = np.concatenate([s for _, s in held])
            item = np.repeat([k for k, _ in held], [len(s) for _, s in held])
            order = np.argsort(key, kind="stable")
            smallest = min(int(-(-self.size[k] * PERCENT // 100)) for k, _ in held)
            self.parts[part] = key[order], item[order], smallest

    @staticmethod
    def limit(part: int) -> np.uint64:
        """Hashes below it are in the sketches of a partition."""
        return np.uint64((1 << (64 - part)) - 1)

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Items whose sketch shares enough with that of a document."""
        found = []
        for part, (key, item, smallest) in self.parts.items():
            if len(hashes) < smallest or not len(key):
                continue
            own = hashes[: np.searchsorted(hashes, self.limit(part))] if part else hashes
            a, b = np.searchsorted(key, own), np.searchsorted(key, own, "right")
            n = (b - a)[b > a]
            if not len(n):
                continue
            at = np.repeat(a[b > a] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hit, shared = np.unique(item[at], return_counts=True)
            found.append(hit[shared >= self.need[hit]])
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def item_grams(self, k: int) -> set:
        if k not in self.grams:
            data = np.frombuffer(self.texts[k].encode(), np.uint8)
            self.grams[k] = grams(words_of(data, np.array([0, len(data)])), 0)
        return self.grams[k]

    def found(self, words: Words, doc: int, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, shared, size) of the items found in a document."""
        out, own = [], None
        if not len(hashes):
            return out
        for k in self.candidates(hashes).tolist():
            at = np.minimum(np.searchsorted(hashes, self.sets[k]), len(hashes) - 1)
            if 100 * int((hashes[at] == self.sets[k]).sum()) < PERCENT * len(self.sets[k]):
                continue
            own = own if own is not None else grams(words, doc)
            shared = len(own & self.item_grams(k))
            if 100 * shared >= PERCENT * len(self.item_grams(k)):
                out.append((k, shared, len(self.item_grams(k))))
        return out


def grams(words: Words, doc: int, n: int = 5) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a document as tuples of words."""
    raw, a, b = words.data.tobytes(), words.offs[doc], words.offs[doc + 1]
    seq = [raw[x:y] for x, y in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist())]
    return {tuple(seq[i : i + n]) for i in range(max(1, len(seq) - n + 1))} if seq else set()


def item_blocks(items: DataFrame, block: int = BLOCK_SHINGLES) -> list[Items]:
    """Blocks of items with at most ``block`` words each, about; one is on the driver at a time."""
    rows = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = F.size(F.split(F.trim("text"), r"\s+"))
    n = max(1, -(-(rows.agg(F.sum(size)).first()[0] or 0) // block))
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield [r[0] for r in got], [r[1] for r in got]


def _search(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*block.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for i, j, data, offs in text_chunks(batch.column(1)):
                words = words_of(data, offs)
                hashes, ends = shingle_sets(words)
                for d in range(j - i):
                    out.extend((ids[i + d], items.ids[k], s, n) for k, s, n in items.found(words, d, hashes[ends[d] : ends[d + 1]]))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "shared", "n_item"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, shared, n_item for each item found in a document."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for part in item_blocks(items, block):
        found = rows.mapInArrow(_search(sc.broadcast(part)), "doc_id long, item_id long, shared long, n_item long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs``, with their columns, in which no item is found."""
    sc = docs.sparkSession.sparkContext
    for part in item_blocks(items, block):
        docs = docs.where(~_contaminated(sc.broadcast(part))(F.col("text").cast("string")))
    return docs


def _contaminated(shared):
    held: dict = {}

    @F.arrow_udf("boolean")
    def run(text: pa.Array) -> pa.Array:
        if "items" not in held:
            held["items"] = Items(*shared.value)
        items, flags = held["items"], []
        for i, j, data, offs in text_chunks(text):
            words = words_of(data, offs)
            hashes, ends = shingle_sets(words)
            flags.extend(bool(items.found(words, d, hashes[ends[d] : ends[d + 1]])) for d in range(j - i))
        return pa.array(flags, pa.bool_())

    return run


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLE = {
    "op3_decontaminate": f"""
WITH dw AS ({sql.words("documents", "doc_id")}), ds AS ({sql.shingles("dw", "doc_id")}),
bw AS ({sql.words("benchmark", "item_id")}), bs AS ({sql.shingles("bw", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
j AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (sh) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(shared AS BIGINT) AS shared, CAST(n_item AS BIGINT) AS n_item
FROM j JOIN n USING (item_id) WHERE 100 * shared >= {PERCENT} * n_item
"""
}
