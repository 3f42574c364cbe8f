"""Hierarchical density clusters: spanning forest of mutual reachability, condensed tree, clusters by stability.

1. ``reachability``: links between points at most ``reach`` apart, weighted by the largest of their distance and both points' core distances (to
   the ``samples``-th neighbour). No link longer than ``reach`` is made, so ``reach`` is the size above which no cluster has to hold together.
2. ``spanning_forest``: the lightest links that hold each connected part together, by rounds in which every part takes its lightest link to another one.
3. ``density_clusters``: links are cut from the heaviest to the lightest, all of one weight at once. A part that falls into several with
   ``least`` points each ends there, and they begin; what is smaller leaves it. Of a cluster and those within it whichever is more stable stays (points times
   the range of 1 / weight over which they belong); the whole is none. A cluster that begins below ``epsilon`` gives way to the first around it
   that begins above, or to the outermost.

A tree of the forest (its links, not the pairs of its points) is finished by one task, and is an error beyond ``TREE_LINKS`` links (24 bytes each).

Defined cases: a point without links belongs to no cluster, nor does one that left before its cluster was chosen (null); points with a null
coordinate likewise; weights of 0 count as ``TINY``; equal rows with ids of their own are points of their own; empty tables give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.clustering import eps_graph
from spanweave.operators.components import connected_components
from spanweave.scratch import Scratch

TINY = 1e-9
TREE_LINKS = 5_000_000


def reachability(points: DataFrame, by: list[str], cols: list[str], reach: float, samples: int = 1) -> DataFrame:
    """a, b, w (a < b) of ``points`` (id, by, cols): mutual reachability of points of one group at most ``reach`` apart."""
    near = eps_graph(points.dropna(subset=["id", *cols]), by, cols, reach).where("src < dst")
    place = lambda c: points.select(F.col("id").alias(c), *[F.col(x).cast("double").alias(f"{c}_{x}") for x in cols])
    square = sum((F.pow(F.col(f"src_{c}") - F.col(f"dst_{c}"), 2) for c in cols[1:]), F.pow(F.col(f"src_{cols[0]}") - F.col(f"dst_{cols[0]}"), 2))
    far = near.join(place("src"), "src").join(place("dst"), "dst").select("src", "dst", F.sqrt(square).alias("d"))
    ends = far.select(F.col("src").alias("id"), "d").unionByName(far.select(F.col("dst").alias("id"), "d"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d"))
    # a point with fewer neighbours within reach has none of its links below reach
    core = ends.withColumn("_n", rank).where(F.col("_n") <= samples).groupBy("id").agg(F.when(F.count("*") >= samples, F.max("d")).otherwise(F.lit(float(reach))).alias("core"))
    of = lambda c: core.select(F.col("id").alias(c), F.col("core").alias(f"c{c}"))
    return far.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.greatest("d", "csrc", "cdst").alias("w"))


def spanning_forest(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The rows (a, b, w) of ``links`` that make up its lightest spanning forest; of equal weights the smaller (a, b) comes first."""
    tmp = Scratch(links.sparkSession, "forest")
    own = links.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), F.col("w").cast("double").alias("w"))
    left = tmp.save(own.groupBy("a", "b").agg(F.min("w").alias("w")).withColumns({"u": F.col("a"), "v": F.col("b")}), "links")
    taken = links.sparkSession.createDataFrame([], "a long, b long, w double")
    for k in range(max_rounds):
        link = F.struct("w", "a", "b")
        sides = left.select("u", link.alias("l"), "v").unionByName(left.select(F.col("v").alias("u"), link.alias("l"), F.col("u").alias("v")))
        best = sides.groupBy("u").agg(F.min(F.struct("l", "v")).alias("m"))
        chosen = tmp.save(best.select(F.col("m.l.a").alias("a"), F.col("m.l.b").alias("b"), F.col("m.l.w").alias("w"), F.col("u"), F.col("m.v").alias("v")), "chosen")
        if not chosen.limit(1).count():
            return taken
        taken = taken.unionByName(chosen.select("a", "b", "w").distinct())
        part = connected_components(chosen.select(F.col("u").alias("src"), F.col("v").alias("dst")))
        of = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        after = left.join(of("u"), "u").join(of("v"), "v").where("_u <> _v").select("a", "b", "w", F.col("_u").alias("u"), F.col("_v").alias("v"))
        # of the links between two parts only the lightest can be taken
        after = after.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")}).groupBy("u", "v").agg(F.min(link).alias("l")).select("l.a", "l.b", "l.w", "u", "v")
        after = tmp.save(after, f"round{k}")
        tmp.drop(left)
        left = after
    raise RuntimeError(f"a spanning forest was not finished after {max_rounds} rounds")


def tree_clusters(a: list[int], b: list[int], w: list[float], least: int, epsilon: float) -> dict[int, int]:
    """The cluster (its smallest point) of each point of one tree that has one."""
    top: dict[int, int] = {}
    for x in {*a, *b}:
        top[x] = x

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    # from the lightest links on: parts that merge at one weight become one node above them
    size, below, weight, node_of = {}, {}, {}, {x: ("p", x) for x in top}
    links = sorted(zip((max(x, TINY) for x in w), a, b))
    i = 0
    while i < len(links):
        j = i
        while j < len(links) and links[j][0] == links[i][0]:
            j += 1
        roots = {find(x) for _, u, v in links[i:j] for x in (u, v)}
        for _, u, v in links[i:j]:
            u, v = find(u), find(v)
            if u != v:
                top[max(u, v)] = min(u, v)
        merged: dict[int, list] = {}
        for r in roots:
            merged.setdefault(find(r), []).append(node_of[r])
        for r, parts in merged.items():
            node = ("n", len(below))
            below[node], weight[node] = parts, links[i][0]
            size[node] = sum(size.get(p, 1) for p in parts)
            node_of[r] = node
        i = j
    if not below:
        return {}
    # from the whole down: clusters (0 is the whole), where they begin, what they hold on to, and which are within them
    began, stable, within, around, members = [0.0], [0.0], [[]], [0], []
    open_ = [(node_of[find(a[0])], 0, False)]
    while open_:
        node, c, gone = open_.pop()
        if node[0] == "p":
            members.append((node[1], c))
            continue
        lam = 1 / weight[node]
        large = [] if gone else [p for p in below[node] if size.get(p, 1) >= least]
        for p in below[node]:
            whole = p in large
            if not gone and not (whole and len(large) == 1):
                stable[c] += size.get(p, 1) * (lam - began[c])
            if whole and len(large) > 1:
                began.append(lam)
                stable.append(0.0)
                within.append([])
                around.append(c)
                within[c].append(len(began) - 1)
                open_.append((p, len(began) - 1, False))
            else:
                open_.append((p, c, not whole))
    # a point below the last cluster it was in has left that cluster; its label is that cluster's or one around it
    chosen = set()
    for c in range(len(began) - 1, 0, -1):
        inner = sum(stable[x] for x in within[c])
        if inner > stable[c]:
            stable[c] = inner
        else:
            chosen.add(c)
    kept = set()
    for c in sorted(chosen):  # those around come first
        if not _any_around(c, around, chosen):
            kept.add(c)
    if epsilon > 0:
        raised = set()
        for c in kept:
            low = 1 / began[c] < epsilon
            while low and around[c]:
                c = around[c]
                low = 1 / began[c] <= epsilon
            raised.add(c)
        kept = {c for c in raised if not _any_around(c, around, raised)}
    label: dict[int, int] = {}
    first: dict[int, int] = {}
    for x, c in members:
        while c and c not in kept:
            c = around[c]
        if c:
            label[x] = c
            first[c] = min(first.get(c, x), x)
    return {x: first[c] for x, c in label.items()}


def _any_around(c: int, around: list[int], those: set[int]) -> bool:
    while around[c]:
        c = around[c]
        if c in those:
            return True
    return False


def density_clusters(points: DataFrame, forest: DataFrame, least: int = 2, epsilon: float = 0.0) -> DataFrame:
    """id, cluster (its smallest id, or null) of ``points`` (id) by the links (a, b, w) of a spanning forest. An ``epsilon`` of one's own for each tree: a column of
    that name in ``forest``."""
    part = connected_components(forest.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnsRenamed({"node": "a", "component": "tree"})
    rows = forest.select("a", "b", "w", (F.col("epsilon") if "epsilon" in forest.columns else F.lit(epsilon)).cast("double").alias("epsilon")).join(part, "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > TREE_LINKS:
            raise ValueError(f"a tree of {len(pdf)} links; choose a smaller reach")
        found = tree_clusters(pdf["a"].tolist(), pdf["b"].tolist(), pdf["w"].tolist(), least, float(pdf["epsilon"].max()))
        return pd.DataFrame(list(found.items()), columns=["id", "cluster"])

    labels = rows.groupBy("tree").applyInPandas(run, "id long, cluster long")
    return points.select(F.col("id").cast("long").alias("id")).join(labels, "id", "left")


def hdbscan(points: DataFrame, by: list[str], cols: list[str], reach: float, least: int = 2, samples: int = 1, epsilon: float = 0.0) -> DataFrame:
    """id, cluster of ``points`` (id, by, cols); see above."""
    return density_clusters(points, spanning_forest(reachability(points, by, cols, reach, samples)), least, epsilon)
