"""Density clusters, greedy containment dedup and components over interval rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.components import connected_components
from spanweave.operators.intervals import overlap_join
from spanweave.operators.tables import number_rows
from spanweave.scratch import Scratch


def eps_graph(df: DataFrame, by: list[str], cols: list[str], eps: float) -> DataFrame:
    """src, dst of rows (column id) of one group at most ``eps`` apart (Euclidean). Candidates meet in grid
    cells of the first two axes, each row listed in the cells next to its own."""
    axes = cols[:2]
    cells = [F.floor(F.col(c) / eps) for c in axes]
    near = df
    for c, cell in zip(axes, cells):
        near = near.withColumn(f"_{c}", F.explode(F.array(cell - 1, cell, cell + 1)))
    own = df
    for c, cell in zip(axes, cells):
        own = own.withColumn(f"_{c}", cell)
    keys = [*by, *(f"_{c}" for c in axes)]
    a = own.select(*keys, F.col("id").alias("src"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = near.select(*keys, F.col("id").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in cols])
    square = sum((F.pow((F.col(f"a_{c}") - F.col(f"b_{c}")).cast("double"), 2) for c in cols[1:]), F.pow((F.col(f"a_{cols[0]}") - F.col(f"b_{cols[0]}")).cast("double"), 2))
    # nine rows for each of df: the planner takes them for one and would broadcast them
    return a.join(b.hint("merge"), keys).where((F.col("src") <= F.col("dst")) & (square <= eps * eps)).select("src", "dst")


def eps_clusters(df: DataFrame, by: list[str], cols: list[str], eps: float, resplit: tuple = ((1000, 10000.0), (10000, 5000.0))) -> DataFrame:
    """id, cluster (its smallest id): components of the eps graph, which is density clustering with one point as
    core. Clusters with more rows than a bound are clustered again with its smaller eps."""
    out = connected_components(eps_graph(df, by, cols, eps)).withColumnsRenamed({"node": "id", "component": "cluster"})
    for rows, smaller in resplit:
        if smaller >= eps:
            continue
        size = out.groupBy("cluster").agg(F.count("*").alias("_n")).where(F.col("_n") > rows).select("cluster")
        big = df.join(out.join(size, "cluster"), "id")
        if not big.limit(1).count():
            continue
        again = connected_components(eps_graph(big, [*by, "cluster"], cols, smaller)).withColumnsRenamed({"node": "id", "component": "_again"})
        out = out.join(again, "id", "left").select("id", F.coalesce("_again", "cluster").alias("cluster"))
    return out


def cluster_kind(clusters: DataFrame, large: int = 100) -> DataFrame:
    """cluster, n, kind: nointe (one row), large (from ``large`` rows on) or inte."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return size.withColumn("kind", F.when(F.col("n") == 1, "nointe").when(F.col("n") >= large, "large").otherwise("inte"))


#: Conflicts between undecided rows that one task may finish.
LOCAL_CONFLICTS = 200_000


def first_independent(edges: DataFrame, max_rounds: int = 1000, local: int = LOCAL_CONFLICTS) -> DataFrame:
    """id of the rows that go when rows are read by id and one goes if one that stayed is in conflict with it. edges: a, b (a < b; in conflict).

    A row that no undecided one before it is in conflict with stays, and what it is in conflict with goes, for all such rows of a round at once. At most
    ``local`` conflicts that are left are finished by one task; rounds follow the longest alternation of staying and going, and more than ``max_rounds`` are an error."""
    tmp = Scratch(edges.sparkSession, "independent")
    left = tmp.save(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "conflicts")
    gone = edges.sparkSession.createDataFrame([], "id long")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if not held:
            return
        a, b = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((a, b))
        out: set[int] = set()
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            if x not in out:  # all its conflicts with rows before it have been read
                out.add(y)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.int64())], ["id"])

    for k in range(max_rounds):
        n = left.count()
        if n <= local:
            return gone.unionByName(left.repartition(1).mapInArrow(finish, "id long")) if n else gone
        firsts = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        out = tmp.save(left.join(firsts, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "gone")
        gone = gone.unionByName(out)
        open_ = left.join(firsts, "a", "left_anti")
        for c in ("a", "b"):
            open_ = open_.join(out.withColumnRenamed("id", c), c, "left_anti")
        after = tmp.save(open_.select("a", "b"), f"round{k}")
        tmp.drop(left)
        left = after
    raise RuntimeError(f"conflicts were left after {max_rounds} rounds")


def greedy_dedup(df: DataFrame, by: list[str], sides: int = 1, thr: float = 0.9) -> DataFrame:
    """Rows that stay when each group is read from the longest on (ties by place) and a row goes if a kept one covers ``thr`` of the
    shorter of both (closed), for two sides on each side with either side of the kept one. Of rows with equal places in a group the smallest stays. Rows with nulls in
    their places go. Pairs in conflict come from an overlap join, and the reading is done in rounds (``first_independent``), so no task holds a group."""
    names = [("chrom", "start", "end")] if sides == 1 else [("chrom1", "start1", "end1"), ("chrom2", "start2", "end2")]
    places = [c for n in names for c in n]
    tmp = Scratch(df.sparkSession, "dedup")
    total = sum((F.col(e) - F.col(s) for _, s, e in names[1:]), F.col(names[0][2]) - F.col(names[0][1]))
    one = df.dropna(subset=places).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.struct(*by).alias("_by"), *places)
    one = one.groupBy("_by", *places).agg(F.min("_row").alias("_row")).withColumn("_t", -total)
    rows = tmp.save(number_rows(one, "_t", *places, name="_id"), "rows")
    spots = rows.select("_id", "_by", *places)
    own = spots.select("_id", "_by", F.col(names[0][0]).alias("chrom"), F.col(names[0][1]).alias("start"), F.col(names[0][2]).alias("end"))
    other = reduce(DataFrame.unionByName, [spots.select("_id", "_by", F.col(c).alias("chrom"), F.col(s).alias("start"), F.col(e).alias("end")) for c, s, e in names])
    pairs = overlap_join(own, other, closed=True).where((F.col("_id_b") < F.col("_id_a")) & F.col("_by_a").eqNullSafe(F.col("_by_b")))
    pairs = pairs.select(F.col("_id_b").alias("a"), F.col("_id_a").alias("b")).distinct()
    side = lambda tag: spots.select(F.col("_id").alias(tag), *[F.col(c).alias(f"{tag}_{c}") for c in places])

    def share(new: tuple, old: tuple) -> Column:
        (cn, sn, en), (co, so, eo) = [f"b_{x}" for x in new], [f"a_{x}" for x in old]
        shared = F.greatest(F.least(en, eo) - F.greatest(sn, so) + 1, F.lit(0))
        return F.when(F.col(cn) == F.col(co), shared / F.least(F.col(en) - F.col(sn) + 1, F.col(eo) - F.col(so) + 1)).otherwise(0.0)

    covered = reduce(Column.__and__, [reduce(F.greatest, [share(new, old) for old in names[1:]], share(new, names[0])) >= thr for new in names])
    conflicts = pairs.join(side("a"), "a").join(side("b"), "b").where(covered).select("a", "b")
    stays = rows.join(first_independent(conflicts).withColumnRenamed("id", "_id"), "_id", "left_anti")
    return stays.select("_row.*")


def grouped_components(edges: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """members with ``component``: that of its edges, or the row's own key."""
    got = connected_components(edges).withColumnsRenamed({"node": key})
    return members.join(got, key, "left").withColumn("component", F.coalesce("component", key))


def representatives(clusters: DataFrame, key: str, weight: str) -> DataFrame:
    """The heaviest row of each component (ties: smallest key)."""
    over = Window.partitionBy("component").orderBy(F.desc(weight), key)
    return clusters.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")
