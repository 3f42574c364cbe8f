"""Haplotype blocks of a region: runs of nodes that go together in all paths that have them, and scores.

Steps are region, path, ord, node, len. Steps with a null region, path or node are left out; a node's length is the largest of its steps', null counts
as 0; equal steps at one ord count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.ranking import rank_chains
from spanweave.operators.running import keyed, running, unkeyed


def collinear_runs(steps: DataFrame) -> DataFrame:
    """region, node, run (the smaller of its end nodes), place (from that end): neighbours a, b go together if every path that has either has them next
    to each other (in either direction) and just once. Runs are unbranched, so they are ranked as chains."""
    rows = steps.select("region", "path", "ord", "node").dropna()
    times = rows.groupBy("region", "path", "node").agg(F.count("*").alias("n"))
    support = times.groupBy("region", "node").agg(F.count("*").alias("paths"), F.max("n").alias("most"))
    ahead = unkeyed(running(keyed(rows, ["region", "path"], "ord"), ["region", "path"], ["ord"], "next", F.col("node"), "last", inclusive=False, reverse=True), ["region", "path"])
    pairs = ahead.where("next is not null and next <> node").select("region", "path", F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b")).distinct()
    pairs = pairs.groupBy("region", "a", "b").agg(F.count("*").alias("on"))
    side = lambda c: support.select("region", F.col("node").alias(c), F.col("paths").alias(f"p{c}"), F.col("most").alias(f"m{c}"))
    together = pairs.join(side("a"), ["region", "a"]).join(side("b"), ["region", "b"]).where("on = pa and on = pb and ma = 1 and mb = 1")
    name = lambda c: F.struct("region", F.col(c).alias("node"))
    alone = support.select(name("node").alias("a"), name("node").alias("b"))
    ranked = rank_chains(together.select(name("a").alias("a"), name("b").alias("b")).unionByName(alone))
    return ranked.select("node.region", "node.node", F.col("chain.node").alias("run"), "place")


def region_blocks(steps: DataFrame, least: int = 200) -> DataFrame:
    """region, blocks, kept_len, total_len, polyratio (length outside retained blocks over all), poly (polymorphic blocks) and simple (blocks of the nodes
    that make up nine tenths of the length). Collinear runs of ``least`` letters or more are retained blocks if all paths share them, polymorphic if some lack them."""
    rows = steps.dropna(subset=["region", "path", "node"])
    paths = rows.groupBy("region").agg(F.countDistinct("path").alias("paths"))
    nodes = rows.groupBy("region", "node").agg(F.coalesce(F.max("len"), F.lit(0)).cast("long").alias("len"))
    nodes = nodes.join(collinear_runs(rows), ["region", "node"])
    on = rows.select("region", "path", "node").distinct().join(nodes.select("region", "node", "run"), ["region", "node"]).groupBy("region", "run").agg(F.countDistinct("path").alias("on"))
    runs = nodes.groupBy("region", "run").agg(F.sum("len").alias("size")).join(on, ["region", "run"]).join(paths, "region")
    whole, wide = F.col("on") == F.col("paths"), F.col("size") >= least
    summed = runs.groupBy("region").agg(
        F.count(F.when(whole & wide, 1)).cast("int").alias("blocks"),
        F.coalesce(F.sum(F.when(whole & wide, F.col("size"))), F.lit(0)).alias("kept_len"),
        F.sum("size").alias("total_len"),
        F.count(F.when(~whole & wide, 1)).cast("int").alias("poly"),
    )
    # heaviest first: the sum of what is heavier, by length and then among equals
    tied = nodes.groupBy("region", "len").agg(F.sum("len").alias("s"))
    before = unkeyed(running(keyed(tied, ["region"], "len"), ["region"], ["len"], "heavier", F.col("s"), "sum", inclusive=False, reverse=True), ["region"]).select("region", "len", F.coalesce("heavier", F.lit(0)).alias("heavier"))
    among = F.sum("len").over(Window.partitionBy("region", "len").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    held = nodes.withColumn("_among", F.coalesce(among, F.lit(0))).join(before, ["region", "len"]).join(summed.select("region", "total_len"), "region")
    simple = held.where(F.col("heavier") + F.col("_among") <= 0.9 * F.col("total_len")).groupBy("region").agg(F.countDistinct("run").cast("int").alias("simple"))
    ratio = F.when(F.col("total_len") > 0, (F.col("total_len") - F.col("kept_len")) / F.col("total_len")).otherwise(1.0)
    return summed.join(simple, "region", "left").select("region", "blocks", "kept_len", "total_len", ratio.alias("polyratio"), "poly", F.coalesce("simple", F.lit(0)).alias("simple"))


def anchor_pair(steps: DataFrame, k: int = 20, edge: int = 10) -> DataFrame:
    """For each region the two nodes, from the first and last ``edge`` steps of paths and among the ``k`` that
    most samples have, that most paths have on opposite ends: region, a, b, paths."""
    n = F.count("*").over(Window.partitionBy("region", "path"))
    rank = F.row_number().over(Window.partitionBy("region", "path").orderBy("ord"))
    ends = steps.withColumn("_n", n).withColumn("_r", rank)
    heads, tails = ends.where(F.col("_r") <= edge), ends.where(F.col("_r") > F.col("_n") - edge)
    support = steps.groupBy("region", "node").agg(F.countDistinct("path").alias("s"))
    over = Window.partitionBy("region").orderBy(F.desc("s"), "node")
    top = support.withColumn("_k", F.row_number().over(over)).where(F.col("_k") <= k).select("region", "node")
    a = heads.join(top, ["region", "node"]).select("region", "path", F.col("node").alias("a"))
    b = tails.join(top, ["region", "node"]).select("region", "path", F.col("node").alias("b"))
    both = a.join(b, ["region", "path"]).where("a <> b").groupBy("region", "a", "b").agg(F.countDistinct("path").alias("paths"))
    best = F.max_by(F.struct("a", "b", "paths"), F.struct("paths", "a", "b"))
    return both.groupBy("region").agg(best.alias("m")).select("region", "m.a", "m.b", "m.paths")


def structural_runs(steps: DataFrame, least: int = 20) -> DataFrame:
    """steps: path, ord, len, ref_pos (null off the reference). path, kind, first, last, left_end, right_pos, inserted, deleted.

    INS: runs of steps off the reference with more than ``least`` letters, or whose neighbours on it lie more than ``least`` apart in either direction (a
    path's end counts as before its beginning). DEL: gaps of more than ``least`` between the parts of the reference that a run of steps on it covers; its
    first and last are those of that run."""
    from spanweave.operators.intervals import merge_intervals
    from spanweave.operators.ordered import gaps_to_next

    rows = keyed(steps.select("path", "ord", "len", "ref_pos"), ["path"], "ord")
    on = F.col("ref_pos").isNotNull()
    place = F.when(on, F.struct(F.col("ref_pos").alias("s"), (F.col("ref_pos") + F.col("len")).alias("e")))
    rows = running(rows, ["path"], ["ord"], "_b", place, "last", inclusive=False)
    rows = running(rows, ["path"], ["ord"], "_a", place, "last", inclusive=False, reverse=True)
    rows = running(rows, ["path"], ["ord"], "_on", F.when(on, 1).otherwise(0), "sum")
    rows = running(rows, ["path"], ["ord"], "_off", F.when(on, 0).otherwise(1), "sum")
    rows = unkeyed(rows, ["path"])
    off = rows.where(~on).groupBy("path", "_on").agg(
        F.min("ord").alias("first"), F.max("ord").alias("last"), F.sum("len").alias("inserted"), F.first("_b").alias("b"), F.first("_a").alias("a")
    )
    edge = F.lit(-1).cast("long")
    left_s, left_e, right_s, right_e = F.coalesce("b.s", edge), F.coalesce("b.e", edge), F.coalesce("a.s", edge - 1), F.coalesce("a.e", edge - 1)
    wide = (F.col("inserted") > least) | (right_s - left_e > least) | (left_s - right_e > least)
    ins = off.where(wide).select("path", F.lit("INS").alias("kind"), "first", "last", F.col("b.e").alias("left_end"), F.col("a.s").alias("right_pos"), "inserted", F.lit(0).cast("long").alias("deleted"))
    parts = rows.where(on).select("path", F.col("_off").alias("run"), F.col("ref_pos").alias("start"), (F.col("ref_pos") + F.col("len")).alias("end"))
    gaps = gaps_to_next(merge_intervals(parts, ["path", "run"], max_gap=least), ["path", "run"], "start", "end").where("gap is not null")
    spans = rows.where(on).groupBy("path", F.col("_off").alias("run")).agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    gone = gaps.join(spans, ["path", "run"]).select(
        "path", F.lit("DEL").alias("kind"), "first", "last", F.col("end").alias("left_end"), (F.col("end") + F.col("gap")).alias("right_pos"), F.lit(0).cast("long").alias("inserted"), F.col("gap").alias("deleted")
    )
    return ins.unionByName(gone)


def region_scores(regions: DataFrame) -> DataFrame:
    """Adds pathratio (kept_paths / all_paths) and lenratio (the smaller over the larger of node_len and end - start) to regions, both cut to two places, as
    the score takes them; null where a denominator is 0."""
    cut = lambda x: F.floor(x * 100) / 100
    span = F.col("end") - F.col("start")
    return regions.withColumns({
        "pathratio": cut(F.try_divide(F.col("kept_paths"), F.col("all_paths"))),
        "lenratio": cut(F.try_divide(F.least("node_len", span), F.greatest("node_len", span))),
    })


def element_delta(windows: DataFrame, counts: DataFrame, classes: list[str]) -> DataFrame:
    """REF - SDR + QUE of each window's element counts. counts: window, source (REF, SDR, QUE), kind, n."""
    sign = F.when(F.col("source") == "SDR", -F.col("n")).otherwise(F.col("n"))
    total = counts.where(F.col("kind").isin(*classes)).groupBy("window").agg(F.sum(sign).alias("delta"))
    return windows.join(total, "window", "left").select(*windows.columns, F.coalesce("delta", F.lit(0)).alias("delta"))
