"""Operators on ordered rows: islands, running shares, as-of lookups, path positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.running import keyed, running, unkeyed
from spanweave.scratch import Scratch


def islands_1d(df: DataFrame, by: list[str], pos: str, eps: float) -> DataFrame:
    """Adds ``island``: a new one begins where the gap to the previous position exceeds ``eps``. Equal to
    density clustering of single points with that radius."""
    order = Window.partitionBy(*by).orderBy(pos)
    gap = F.col(pos) - F.lag(pos).over(order)
    marked = df.withColumn("_new", F.when(gap > eps, 1).otherwise(0))
    return marked.withColumn("island", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def change_groups(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds ``run``: the number of changes of the value so far."""
    over = Window.partitionBy(*by).orderBy(order)
    changed = F.when(F.lag(value).over(over).eqNullSafe(F.col(value)) | (F.row_number().over(over) == 1), 0).otherwise(1)
    return df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(over).cast("long")).drop("_c")


def run_lengths(df: DataFrame, by: list[str], order: str, value: str, least: int = 1) -> DataFrame:
    """Runs of equal values, with their length and first position; from ``least`` rows on."""
    runs = change_groups(df, by, order, value).groupBy(*by, "run", value)
    return runs.agg(F.count("*").alias("length"), F.min(order).alias("first")).where(F.col("length") >= least)


def consecutive_runs(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Runs of consecutive index values: first, last, n (different values; repeated rows count once)."""
    rows = keyed(df.where(F.col(index).isNotNull()).select(*by, index), by, index)
    for name, back in (("_prev", False), ("_next", True)):
        rows = running(rows, by, [index], name, F.col(index), "last", inclusive=False, reverse=back)
    at = F.col(index)
    rows = running(rows, by, [index], "first", F.when(F.col("_prev").isNull() | (at - F.col("_prev") > 1), at), "max")
    ends = unkeyed(rows, by).where(F.col("_next").isNull() | (F.col("_next") - at > 1))
    return ends.select(*by, "first", at.alias("last"), (at - F.col("first") + 1).alias("n"))


def gaps_to_next(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Adds ``gap``: from a row's end to the start of the next row (by start, then end); null for the last."""
    saved = Scratch(df.sparkSession, "gaps").save(df, "rows")  # it is read for the blocks' width, the totals and the rows
    rows = running(keyed(saved, by, start), by, [start, end], "_next", F.col(start), "last", inclusive=False, reverse=True)
    return unkeyed(rows, by).select(*df.columns, (F.col("_next") - F.col(end)).alias("gap"))


def cumulative_share(df: DataFrame, by: list[str], weight: str, tie: str, until: float = 0.9) -> DataFrame:
    """The heaviest rows of each group, up to and with the one that brings their share above ``until``."""
    over = Window.partitionBy(*by).orderBy(F.desc(weight), tie)
    before = F.coalesce(F.sum(weight).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(weight).over(Window.partitionBy(*by))
    return df.withColumn("_b", before).withColumn("_t", total).where(F.col("_b") <= until * F.col("_t")).drop("_b", "_t")


def top_k(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    over = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def equal_slices(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    return df.withColumn("slice", F.ntile(n).over(Window.partitionBy(*by).orderBy(order)))


def _points_around(points: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (key, start, end; distinct) with left, the last point (key, pos) before the start, and right, the first at the end or after; null
    where there is none."""
    # points on chromosomes without regions lie around none
    points = points.where("pos is not null").join(regions.select("key").distinct(), "key", "left_semi")
    none = F.lit(None).cast("long")
    marks = points.select("key", "pos", F.lit(2).alias("kind"), none.alias("start"), none.alias("end"))
    left = regions.select("key", F.col("start").alias("pos"), F.lit(0).alias("kind"), "start", "end")
    right = regions.select("key", F.col("end").alias("pos"), F.lit(1).alias("kind"), "start", "end")
    own = F.when(F.col("kind") == 2, F.col("pos"))
    # at one position borders come first: a point there is not before the start, but at the end
    rows = keyed(marks.unionByName(left).unionByName(right), ["key"], "pos")
    rows = running(rows, ["key"], ["pos", "kind"], "left", own, "last")
    rows = unkeyed(running(rows, ["key"], ["pos", "kind"], "right", own, "last", reverse=True), ["key"]).where("kind < 2")
    side = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c))).alias(c)
    return rows.groupBy("key", "start", "end").agg(side(0, "left"), side(1, "right"))


def asof_both(points: DataFrame, regions: DataFrame, max_span: int = 1_000_000) -> DataFrame:
    """For each region (chrom, start, end) the last point before its start and the first at its end or
    after; regions without either, or with more than ``max_span`` between them, are left out."""
    spots = regions.select(F.col("chrom").alias("key"), "start", "end").distinct()
    found = _points_around(points.withColumnRenamed("chrom", "key"), spots).where((F.col("right") - F.col("left")) <= max_span)
    return regions.join(found.withColumnRenamed("key", "chrom"), ["chrom", "start", "end"])


def asof_path(regions: DataFrame, steps: DataFrame) -> DataFrame:
    """For each region (path, start, end; closed) the last step that begins at its start or before and the first that ends at its end or after: adds
    first_ord and last_ord (null where there is none). steps: path, ord, pos_s, pos_e, in path order."""
    spots = regions.select("path", "start", "end").distinct()
    begins = steps.select(F.col("path").alias("key"), F.col("pos_s").alias("pos"))
    ends = steps.select(F.col("path").alias("key"), F.col("pos_e").alias("pos"))
    left = _points_around(begins, spots.select(F.col("path").alias("key"), (F.col("start") + 1).alias("start"), F.col("end")))
    right = _points_around(ends, spots.select(F.col("path").alias("key"), F.col("start"), F.col("end")))
    both = left.select("key", (F.col("start") - 1).alias("start"), "end", "left").join(right.select("key", "start", "end", "right"), ["key", "start", "end"])
    at = lambda pos, name: steps.groupBy(F.col("path").alias("key"), F.col(pos)).agg(F.min("ord").alias(name))
    both = both.join(at("pos_s", "first_ord").withColumnRenamed("pos_s", "left"), ["key", "left"], "left").join(
        at("pos_e", "last_ord").withColumnRenamed("pos_e", "right"), ["key", "right"], "left"
    )
    return regions.join(both.select(F.col("key").alias("path"), "start", "end", "first_ord", "last_ord"), ["path", "start", "end"], "left")


def walk_positions(steps: DataFrame, segments: DataFrame, path: str = "path", ord: str = "ord", node: str = "node", closed: bool = False) -> DataFrame:
    """Adds pos_s, pos_e of each step on its path, from the lengths of the nodes (node, len). Steps at unknown nodes are left out."""
    rows = keyed(steps.join(segments.select(node, "len"), node), [path], ord)
    rows = unkeyed(running(rows, [path], [ord], "pos_e", F.col("len"), "sum"), [path])
    return rows.withColumn("pos_s", F.col("pos_e") - F.col("len") + (1 if closed else 0))


def path_string(steps: DataFrame, by: list[str], ord: str, text: str, sep: str = "") -> DataFrame:
    """The steps' texts in order, joined."""
    listed = F.array_sort(F.collect_list(F.struct(ord, text)))
    return steps.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x[text]), sep).alias("string"))


def clip_steps(steps: DataFrame, regions: DataFrame) -> DataFrame:
    """Steps (path, ord, node, pos_s, pos_e) within regions (path, start, end): the part of each step inside,
    relative to the step (from, to) and to the region (at)."""
    rows = steps.join(regions, "path").where("pos_s < end and start < pos_e")
    lo, hi = F.greatest("pos_s", "start"), F.least("pos_e", "end")
    return rows.select("path", "start", "end", "ord", "node", (lo - F.col("pos_s")).alias("from"), (hi - F.col("pos_s")).alias("to"), (lo - F.col("start")).alias("at"))


def path_share(paths: DataFrame, reference: DataFrame) -> DataFrame:
    """For each path the first reference path (smallest ord) that shares a node with it: path, ref_path."""
    # of a node's reference paths only the first can be a path's first, so no list of paths meets another
    first = reference.groupBy("node").agg(F.min(F.struct("ord", F.col("path").alias("ref_path"))).alias("_r"))
    hit = paths.select("path", "node").distinct().join(first, "node")
    return hit.groupBy("path").agg(F.min("_r").alias("_r")).select("path", "_r.ref_path")


def weighted_overlap(members: DataFrame, least: float | None = None) -> DataFrame:
    """group, a, b, ratio: total length of the nodes two paths share over the larger total.
    members: group, path, node, len (each node once a path)."""
    rows = members.select("group", "path", "node", "len").distinct()
    total = rows.groupBy("group", "path").agg(F.sum("len").alias("total"))
    a = rows.withColumnRenamed("path", "a")
    b = rows.select("group", "node", F.col("path").alias("b"))
    shared = a.join(b, ["group", "node"]).where("a < b").groupBy("group", "a", "b").agg(F.sum("len").alias("shared"))
    out = shared.join(total.withColumnsRenamed({"path": "a", "total": "ta"}), ["group", "a"]).join(total.withColumnsRenamed({"path": "b", "total": "tb"}), ["group", "b"])
    out = out.select("group", "a", "b", (F.col("shared") / F.greatest("ta", "tb")).alias("ratio"))
    return out if least is None else out.where(F.col("ratio") >= least)


def pattern_groups(gt: DataFrame, window: str = "window") -> DataFrame:
    """Samples of a window with the same genotype at every variant: window, pattern, samples (sorted)."""
    each = gt.groupBy(window, "sample").agg(F.array_sort(F.collect_list(F.struct("variant", "gt"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["variant"].cast("string"), x["gt"])), ",")
    return each.groupBy(window, text.alias("pattern")).agg(F.array_join(F.array_sort(F.collect_set(F.col("sample").cast("string"))), ",").alias("samples"))


def haplotype_string(blocks: DataFrame, by: list[str], order: str, letter: str, strand: str) -> DataFrame:
    """Letters of the blocks in order, lower case on the minus strand."""
    shown = F.when(F.col(strand) == "-", F.lower(letter)).otherwise(F.col(letter))
    return path_string(blocks.withColumn("_t", shown), by, order, "_t")
