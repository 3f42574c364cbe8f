"""Pairs of texts whose sets of substrings are alike, worked out on Arrow batches.

A substring of k characters is told apart within a pair of texts by 64 bits of hash. A text's signature holds the smallest hash of its substrings for each of some lanes; texts that agree in a band of lanes are
candidates, those that agree in too few lanes overall are none after all, and what is left is compared exactly, by the texts.

Defined cases: texts with fewer than k characters, or null, pair with nothing; equal texts pair at 1; empty tables give none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanweave.scratch import Scratch

#: Hashes that a pass over the lanes takes at a time, so that they stay in the cache.
SPAN = 1 << 8
#: Texts whose sets a comparison keeps.
HELD = 256
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def substring_hashes(text: str | None, k: int) -> np.ndarray:
    """64 bits of each substring of k characters, in order: hashes of 1, 2, 4, ... characters, and of two such that overlap."""
    chars = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(chars) < k:
        return np.zeros(0, np.uint64)
    h, n = _mixed(chars.astype(np.uint64) * _ODD[0] + np.uint64(1)), 1
    while n < k:
        step = min(n, k - n)
        h, n = _mixed(h[: len(h) - step] * _ODD[3] + _mixed(h[step:] + _ODD[0])), n + step
    return h


def shape_for(least: float, miss: float = 1e-6) -> tuple[int, int, int]:
    """(bands, lanes of each, lanes that must agree): two lanes a band, and as many bands and agreements as miss a pair at Jaccard ``least`` with probability ``miss`` in all."""
    bands = 1 if least >= 1 else math.ceil(math.log(miss / 2) / math.log1p(-(least**2)))
    lanes, below, agree = 2 * bands, 0.0, 0
    while least < 1 and agree < lanes:
        below += math.exp(math.lgamma(lanes + 1) - math.lgamma(agree + 1) - math.lgamma(lanes - agree + 1) + agree * math.log(least) + (lanes - agree) * math.log1p(-least))
        if below > miss / 2:
            break
        agree += 1
    return bands, 2, agree if least < 1 else lanes


def _signed(k: int, bands: int, rows: int, kind: pa.DataType):
    lanes = bands * rows
    seeds = np.random.default_rng(30).integers(1, 1 << 31, lanes, np.uint32) * np.uint32(2) + np.uint32(1)
    odd, half = np.uint32(0x7FEB352D), np.uint32(15)
    number = np.arange(bands, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                h = np.unique(substring_hashes(text, k))
                if not len(h):
                    continue
                # 32 bits do for the lanes: among the substrings of a text few are equal in them
                own, least = (h >> np.uint64(32)).astype(np.uint32), np.full(lanes, np.iinfo(np.uint32).max, np.uint32)
                for a in range(0, len(own), SPAN):
                    part = own[a : a + SPAN]
                    x = part[None, :] * seeds[:, None]
                    x ^= x >> half
                    x *= odd
                    np.minimum(least, x.min(1), out=least)
                least = least.astype(np.uint64)
                banded = _mixed(number * _ODD[0] + np.uint64(7))
                for j in range(rows):
                    banded = _mixed(banded * _ODD[3] + least[j::rows])
                name = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64)
                out.append((i, int(name[0]), int(name[1]), banded.view(np.int64).tolist(), _mixed(least).astype(np.uint16).tobytes()))
            if out:
                at, h1, h2, b, s = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)).cast(kind), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(b, pa.list_(pa.int64())), pa.array(s, pa.binary())], ["_key", "_h1", "_h2", "_bands", "_s"]
                )

    return run


def _agreeing(least: int):
    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        lanes = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), -1)
        return pa.array((lanes(a) == lanes(b)).sum(1) >= least)

    return run


def _compared(k: int):
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out, sets = [], {}

        def set_of(text: str) -> np.ndarray:
            if text not in sets:
                if len(sets) == HELD:
                    sets.clear()
                sets[text] = np.unique(substring_hashes(text, k))
            return sets[text]

        for x, y in zip(a.to_pylist(), b.to_pylist()):
            own, other = set_of(x), set_of(y)
            at = np.minimum(own.searchsorted(other), len(own) - 1)
            both = int((own[at] == other).sum())
            out.append(both / (len(own) + len(other) - both))
        return pa.array(out)

    return run


def text_pairs(df: DataFrame, key: str, text: str, k: int, least: float = 0.1, miss: float = 1e-6) -> DataFrame:
    """a, b, jaccard of keys whose texts' sets of substrings of k characters have an exact Jaccard of ``least`` or more; a pair at that threshold is missed with
    probability ``miss`` at most. Texts with equal sets are one class until the end; texts are shuffled for what is left of the candidates only."""
    bands, rows, agree = shape_for(least, miss)
    scratch = Scratch(df.sparkSession, "texts")
    kind = df.schema[key].dataType
    # signing is the work, and files may be few
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(F.col(key).alias("_key"), F.col(text).alias("_t")).repartition(tasks, "_key")
    schema = f"_key {kind.simpleString()}, _h1 long, _h2 long, _bands array<long>, _s binary"
    signed = scratch.save(dealt.mapInArrow(_signed(k, bands, rows, to_arrow_type(kind)), schema), "signed")
    classes = signed.groupBy("_h1", "_h2").agg(F.min("_key").alias("c"))
    members = scratch.save(signed.select("_key", "_h1", "_h2").join(classes, ["_h1", "_h2"]).select("_key", "c"), "members")
    once = members.where("_key = c").select(F.col("c").alias("_key"))
    own = signed.join(once, "_key", "left_semi")
    exploded = own.select(F.col("_key").alias("c"), F.explode("_bands").alias("_b"))
    pairs = exploded.withColumnRenamed("c", "a").join(exploded.withColumnRenamed("c", "b"), "_b").where("a < b").select("a", "b").distinct()
    sides = lambda source, name, shown: [source.select(F.col("_key").alias(c), F.col(name).alias(f"{shown}{c}")) for c in "ab"]
    one, other = sides(own, "_s", "_s")
    pairs = pairs.join(one, "a").join(other, "b").where(_agreeing(agree)("_sa", "_sb")).select("a", "b")
    pairs = scratch.save(pairs, "pairs")
    met = pairs.select(F.col("a").alias("_key")).unionByName(pairs.select(F.col("b").alias("_key"))).distinct()
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_t")).join(met, "_key", "left_semi")
    one, other = sides(source, "_t", "_t")
    # dealt by number: comparing is the work, not the size of the texts
    near = pairs.join(one, "a").repartition(tasks, "b").join(other.repartition(tasks, "b"), "b").select("a", "b", _compared(k)("_ta", "_tb").alias("jaccard")).where(F.col("jaccard") >= least)
    near = near.unionByName(members.where("_key = c").select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(1.0).alias("jaccard")))
    ends = lambda c: members.select(F.col("c").alias(c), F.col("_key").alias(f"_{c}"))
    out = near.join(ends("a"), "a").join(ends("b"), "b").where("a <> b or _a < _b")
    return out.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "jaccard")
