"""Connected components of an edge table, by alternating star contractions.

Every round is two equi joins and two partial aggregations over the edges; rounds grow with
the logarithm of the longest path. What is left when at most ``LOCAL_EDGES`` edges are (a few megabytes, whatever the table's size was) is
finished by one task instead of further rounds over all tasks; the result is the same. Nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.scratch import Scratch


#: Edges that one task may finish.
LOCAL_EDGES = 200_000
#: Edges that a task contracts together before the first shuffle.
CONTRACTED = 1 << 20
#: A node with more neighbours than this meets them by a broadcast; there are at most as many such nodes as the edges hold this number.
HEAVY = 100_000


def local_roots(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node each one reaches."""
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    label = np.arange(len(nodes))
    a, b = ends[: len(src)], ends[len(src) :]
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges -> stars of some at a time."""
    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= CONTRACTED:
            yield _stars(held)
            held, size = [], 0
    if held:
        yield _stars(held)


def _stars(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    node, root = local_roots(*(np.concatenate(x) for x in zip(*held)))
    keep = node != root
    return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["u", "v"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges that are left, in one task -> stars."""
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if held:
        yield _stars(held)


def _with_least(edges: DataFrame, low: DataFrame, heavy: int) -> DataFrame:
    """Edges (u, v) with the least node m of u (``low``: u, m, n neighbours). The neighbours of one node with many stay where they are."""
    many = F.broadcast(low.where(F.col("n") > heavy).select("u", "m"))
    rest = edges.join(many.select("u"), "u", "left_anti").join(low.where(F.col("n") <= heavy).select("u", "m"), "u")
    return rest.unionByName(edges.join(many, "u"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_iter: int = 200, local: int = LOCAL_EDGES, heavy: int = HEAVY) -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``edges`` (long ids).

    Edges with a null end are ignored; loops give a component of one node. Rounds go on until nothing changes; more than
    ``max_iter`` of them (they grow with the logarithm of the longest path) is an error, never an unfinished result."""
    tmp = Scratch(edges.sparkSession, "components")
    edges = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    loops = edges.where("u = v").select("u").distinct()
    now = tmp.save(edges.where("u <> v").mapInArrow(_contract, "u long, v long").distinct(), "edges")
    mark = None
    for k in range(max_iter + 1):
        if now.count() <= local:
            done = tmp.save(now.repartition(1).mapInArrow(_finish, "u long, v long"), "finished")
            tmp.drop(now)
            now = done
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = tmp.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), f"low{k}")
        large = _with_least(both.where("v > u"), low, heavy).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = tmp.save(large, f"large{k}")
        tmp.drop(now, low)
        low = tmp.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"low{k}")
        small = (
            _with_least(large, low, heavy)
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        now = tmp.save(small, f"round{k}")
        tmp.drop(large, low)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components still changed after {max_iter} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.join(now.select("u").union(now.select("v")).distinct(), "u", "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return stars.unionByName(roots).unionByName(alone)
