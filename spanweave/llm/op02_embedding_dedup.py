"""Near-duplicate embeddings (cosine 0.95) by projection passes with whole buckets.

Each pass puts vectors whose random hyperplane hashes agree in ``bits`` bits in one bucket, and every pair
of a bucket is compared by exact cosine in double precision: buckets of at most ``BUCKET`` vectors in one task,
larger ones by pairs of blocks. So a pair is met wherever its own bits agree, however densely others lie around
it, and the number of passes follows from ``bits`` alone: a pair at the threshold is missed by all of them with
probability ``MISS`` at most. ``bits`` is the cheapest by the bucket sizes of one measured pass; 0 bits is
one exact comparison of all vectors, which is what inputs of some thousand vectors get. Where it costs less, the members
of all large buckets are compared with each other once instead of bucket by bucket. Either is quadratic in a
dense group's size. The links of all passes are united into components. Links join vectors of one
component only, so a vector's links are then counted within its component, by blocks of it: that count
is complete for the component, whichever pairs the buckets met. Equal vectors are one class from the start.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths do not link; one output row per input row; ties in vec_id
count as separate vectors; a null vec_id leaves ``kept`` null unless the component has another; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.op04_jaccard_join import runs
from spanweave.operators.components import connected_components, local_roots
from spanweave.scratch import Scratch

COSINE = 0.95
MISS = 1e-4
#: Vectors of a bucket that one task compares.
BUCKET = 2048
BLOCK = 4096
#: Vectors in a block of what is beyond a bucket.
DENSE_BLOCK = 4096
MOST_BITS = 48
#: What a vector costs in a pass (hashes, shuffle), in comparisons.
_ROW = 512
_STEP = 512


def passes_for(bits: int, cosine: float = COSINE, miss: float = MISS) -> int:
    """Passes after which a pair at ``cosine`` stays unmet with probability ``miss`` at most: it is met
    where all its ``bits`` hashes agree."""
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if agree == 1 else math.ceil(math.log(miss) / math.log1p(-agree))


def best_bits(n: int, sizes: dict[int, tuple[int, int, int]], cosine: float = COSINE) -> int:
    """The cheapest number of bits. sizes: for each, the squares of a pass's small buckets and of its large ones,
    summed, and the vectors in large ones."""

    def cost(bits: int) -> float:
        small, large, dense = sizes[bits]
        passes = passes_for(bits, cosine)
        return passes * (n * _ROW + small / 2) + min(passes * large / 2, min(n, 2 * dense) ** 2 / 2)

    return min(sizes, key=cost)


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, embedding -> vec_id, v (bytes of float64; null if it links with nothing)."""
    for batch in batches:
        out = []
        for x in batch.column(1):
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) if x.is_valid and len(x.values) else None
            usable = v is not None and np.isfinite(v).all() and np.abs(v).max() > 0
            out.append((v + 0.0).tobytes() if usable else None)  # + 0.0: one zero
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashes(passes: int, bits: int, vectors: bool):
    """cid, v -> pass, dim, key, cid and, with ``vectors``, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.int64(1) << np.arange(bits, dtype=np.int64)[::-1]
        for batch in batches:
            cid, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            dims = np.array([len(r) // 8 for r in raw])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), 4096):
                    part = at[i : i + 4096]
                    x = _unit([raw[k] for k in part.tolist()])
                    n = len(part)
                    for t in range(passes):
                        planes = np.random.Generator(np.random.PCG64([7, dim, t])).standard_normal((bits, dim))
                        key = (x @ planes.T > 0) @ place if bits else np.zeros(n, np.int64)
                        columns = [pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(key), pa.array(cid[part])]
                        names = ["pass", "dim", "key", "cid"]
                        if vectors:
                            columns.append(batch.column(1).take(pa.array(part)))
                            names.append("v")
                        yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _stars(cosine: float, keys: int):
    """Rows ordered by the first ``keys`` columns, which name a bucket or a pair of blocks: its links, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, keys):
            if part.num_rows < 2:
                continue
            cid, x = part.column("cid").to_numpy(), _unit(part.column("v").to_pylist())
            end, second = len(x), None
            if "b" in part.column_names and part.column("i")[0] != part.column("j")[0]:
                # two blocks: each of the first with all of the second
                order = np.argsort(part.column("b").to_numpy(), kind="stable")
                cid, x = cid[order], x[order]
                end = second = np.count_nonzero(part.column("b").to_numpy() == part.column("i")[0].as_py())
            src, dst = [cid[:0]], [cid[:0]]
            for i in range(0, end, _STEP):
                k = i if second is None else second
                p, q = np.nonzero(x[i : min(end, i + _STEP)] @ x[k:].T >= cosine)
                after = i + p < k + q
                src.append(cid[i + p[after]])
                dst.append(cid[k + q[after]])
                if sum(map(len, src)) > 1 << 20:
                    node, root = local_roots(np.concatenate(src), np.concatenate(dst))
                    src, dst = [node], [root]
            node, root = local_roots(np.concatenate(src), np.concatenate(dst))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["src", "dst"])

    return run


def _count(cosine: float):
    """Rows ordered by (component, i, j): links of each class in a pair of blocks, a block against itself where i = j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, 3):
            cid, own, weight = (part.column(c).to_numpy() for c in ("cid", "b", "n"))
            x = _unit(part.column("v").to_pylist())
            first = own == part.column("i")[0].as_py()
            links = np.zeros(len(cid), np.int64)
            rows, others = np.flatnonzero(first), np.flatnonzero(~first) if not first.all() else np.arange(len(cid))
            alone = part.column("i")[0] == part.column("j")[0]
            for k in range(0, len(rows), _STEP):
                at = rows[k : k + _STEP]
                hit = x[at] @ x[others].T >= cosine
                if alone:
                    hit[np.arange(len(at)), at] = False
                elif first.all():
                    hit[:] = False
                links[at] += hit @ weight[others]
                if not alone and not first.all():
                    links[others] += weight[at] @ hit
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(links)], ["cid", "links"])

    return run


def _measured(classes: DataFrame, n: int, bucket: int) -> dict[int, tuple[int, int, int]]:
    """What best_bits() takes: bucket sizes of the first pass, which has the same leading bits at any depth."""
    most = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, n) / 64))) + 16)
    keys = classes.select("cid", "v").mapInArrow(_hashes(1, most, False), "pass int, dim int, key long, cid long")
    found = keys.groupBy("dim", "key").agg(F.count("*").alias("r"))
    least = max(1, math.ceil(math.log2(max(1, n) / (4 * bucket))))
    steps = sorted({0, most, *range(least, most, 3)})
    found = found.select("dim", "r", "key", F.explode(F.array(*map(F.lit, steps))).alias("bits"))
    cut = F.expr(f"shiftright(key, {most} - bits)")
    r = F.col("r").cast("double")
    sizes = (
        found.groupBy("bits", "dim", cut.alias("key"))
        .agg(F.sum("r").alias("r"))
        .groupBy("bits")
        .agg(F.sum(F.when(r <= bucket, r * r).otherwise(0)), F.sum(F.when(r > bucket, r * r).otherwise(0)), F.sum(F.when(r > bucket, r).otherwise(0)))
    )
    return {row[0]: (row[1], row[2], row[3]) for row in sizes.collect()}


def _edges(tmp: Scratch, classes: DataFrame, cosine: float, bits: int, bucket: int) -> DataFrame:
    """src, dst: the links of all buckets, as stars."""
    passes, names = passes_for(bits, cosine), ["pass", "dim", "key"]
    held = classes.select("cid", "v")
    keys = held.mapInArrow(_hashes(passes, bits, False), "pass int, dim int, key long, cid long")
    large = tmp.save(keys.groupBy(*names).agg(F.count("*").alias("r")).where(F.col("r") > bucket), "large")
    square, any_ = large.agg(F.sum(F.col("r").cast("double") * F.col("r")), F.count("*")).first()
    rows = held.mapInArrow(_hashes(passes, bits, True), "pass int, dim int, key long, cid long, v binary")
    small = rows.join(large, names, "left_anti") if any_ else rows
    out = small.repartition(*names).sortWithinPartitions(*names).mapInArrow(_stars(cosine, 3), "src long, dst long").distinct()
    out = tmp.save(out, "edges")
    if not any_:
        return out
    dense = tmp.save(keys.join(large, names, "left_semi"), "dense")
    once = tmp.save(dense.select("cid", "dim").distinct(), "once")
    if (once.groupBy("dim").count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0]) <= square:
        dense = once.select(F.col("dim").cast("long").alias("group"), "cid")
    else:
        dense = dense.select(F.xxhash64(*names).alias("group"), "cid")
    blocks = dense.groupBy("group").agg(F.ceil(F.count("*") / DENSE_BLOCK).cast("int").alias("blocks"))
    split = dense.join(blocks, "group").withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    split = split.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select("group", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "cid", "b").join(held, "cid")
    more = (
        split.select("group", "i", "j", "cid", "b", "v")
        .repartition("group", "i", "j")
        .sortWithinPartitions("group", "i", "j")
        .mapInArrow(_stars(cosine, 3), "src long, dst long")
        .distinct()
    )
    return out.unionByName(tmp.save(more, "dense_edges"))


def embedding_components(vectors: DataFrame, cosine: float = COSINE, bits: int | None = None, bucket: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding). ``bits`` is measured if it is None."""
    spark = vectors.sparkSession
    tmp = Scratch(spark, "embeddings")
    bucket = BUCKET if bucket is None else bucket
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = tmp.save(rows.mapInArrow(_valid, "vec_id long, v binary"), "rows")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = tmp.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    if bits is None:
        bits = best_bits(n, _measured(classes, n, bucket), cosine) if n > bucket else 0
    edges = _edges(tmp, classes, cosine, bits, bucket)
    found = connected_components(edges).select(F.col("node").alias("cid"), "component")
    members = tmp.save(classes.join(found, "cid"), "members")
    size = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("rep").alias("component_id"))
    split = members.join(size, "component").withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    split = split.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    links = (
        split.select("component", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "cid", "b", "n", "v")
        .repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
        .mapInArrow(_count(cosine), "cid long, links long")
        .groupBy("cid")
        .agg(F.sum("links").alias("links"))
    )
    known = members.join(size, "component").join(links, "cid").select("cid", "links", "component_id")
    labelled = classes.join(known, "cid", "left").select(
        "v", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")
    )
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return (
        rows.join(labelled.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v"), "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}
_PAIRS = """WITH RECURSIVE
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, least(a, min(b)) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT x.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(component_id, x.vec_id) AS BIGINT) AS component_id,
       x.vec_id = coalesce(component_id, x.vec_id) AS kept
FROM embeddings x LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""
ORACLE = {"op2_embedding_dedup": _PAIRS}
