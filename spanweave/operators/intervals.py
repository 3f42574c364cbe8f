"""Interval algebra on (chrom, start, end) rows, half-open unless ``closed`` says otherwise.

Joins are equi joins on (chrom, level, bin). An interval's level follows from its length, so that it touches two bins of its
level at most; it is listed at its own level and, to meet longer intervals, at the coarser levels that occur on the other side. So a
chromosome-long interval among short ones costs two rows, not one for each short bin. A pair meets at the level of its longer
interval and is emitted in the one bin where the later of the two begins. Adaptive execution splits a bin that is still too large.
Orders along a chromosome are taken in two levels (``running``), so no task holds a whole one.

Defined cases: rows with a null chrom, start or end overlap nothing (``anti`` and ``left`` keep them); empty intervals (start >= end)
overlap what they lie inside of; repeated rows count each; other columns, null or not, are carried; empty tables give none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.running import BLOCK_ROWS, keyed, running, unkeyed
from spanweave.scratch import Scratch

#: Width of the smallest bins, and the factor from one level to the next.
SMALLEST, FACTOR = 64, 8
#: The same for pairs, which are listed once for each two of their bins: wide enough that most have one on either side.
SMALLEST_PAIRS = 512
MOST_LEVELS = 17


def make_windows(df: DataFrame, width: int = 1000, step: int = 500, compat_shift: bool = False) -> DataFrame:
    """One window for each start in [start, end) by ``step``, clipped at the end. ``compat_shift`` adds 1 to starts."""
    at = F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(step).cast("long")))
    rows = df.where("start < end").withColumn("_at", at)
    return rows.select(
        *[c for c in df.columns if c not in ("start", "end")],
        (F.col("_at") + (1 if compat_shift else 0)).alias("start"),
        F.least(F.col("_at") + width, F.col("end")).alias("end"),
    )


def _level(start: str, end: str, smallest: int) -> Column:
    """The first level whose bins are as wide as the interval is long."""
    size = F.col(end) - F.col(start)
    out = F.lit(MOST_LEVELS)
    for k in range(MOST_LEVELS - 1, -1, -1):
        out = F.when(size <= smallest * FACTOR**k, k).otherwise(out)
    return out


def level_of(start: str, end: str) -> Column:
    """The level of an interval, by its length; of the smallest bins' width that joins take unless told otherwise."""
    return _level(start, end, SMALLEST)


def levels_of(df: DataFrame, start: str = "start", end: str = "end", smallest: int = SMALLEST) -> list[int]:
    """The levels that occur; at most ``MOST_LEVELS`` + 1."""
    return sorted(df.agg(F.collect_set(_level(start, end, smallest))).first()[0])


def _place(level: int, turn: int):
    return lambda at: F.struct(F.lit(level).alias("l"), at.alias("b"), F.lit(turn).alias("t"))


def _listed(df: DataFrame, start: str, end: str, own: list[int], other: list[int], first: bool, smallest: int, closed: bool, tag: str = "") -> DataFrame:
    """``df`` once for each bin where a row looks for partners: adds _level, _bin and _turn (with ``tag``). In turn 1 a row of
    the first side meets, at its own level, shorter or equal ones; in turn 2 longer ones, at theirs."""
    last = F.col(end) if closed else F.greatest(F.col(start), F.col(end) - 1)
    size = lambda k: F.lit(smallest * FACTOR**k)
    level = _level(start, end, smallest)
    places = []
    for k in sorted({*own, *other}):
        lo, hi = F.floor(F.col(start) / size(k)), F.floor(last / size(k))
        turns = []
        if k in own:
            turns.append((level == k, 1))
            if not first and any(x < k for x in other):
                turns.append((level == k, 2))
        if k in other and any(x < k for x in own):
            turns.append((level < k, 2 if first else 1))
        for cond, turn in turns:
            at = F.transform(F.sequence(lo, F.greatest(lo, hi)), _place(k, turn))
            places.append(F.when(cond, at).otherwise(F.expr("cast(array() as array<struct<l:int,b:bigint,t:int>>)")))
    if not places:
        places = [F.expr("cast(array() as array<struct<l:int,b:bigint,t:int>>)")]
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_p", F.explode(F.concat(*places)))
    return rows.withColumns({f"_level{tag}": F.col("_p.l"), f"_bin{tag}": F.col("_p.b"), f"_turn{tag}": F.col("_p.t")}).drop("_p")


def _suffixed(df: DataFrame, suffix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(c + suffix) for c in df.columns])


_PLACE = ["_level", "_bin", "_turn"]


def _here(start: Column, level: str, bin: str, smallest: int) -> Column:
    """Whether this is the bin in which the pair's later interval begins."""
    width = F.lit(float(smallest)) * F.pow(F.lit(float(FACTOR)), F.col(level))
    return F.col(bin) == F.floor(start / width)


def _pairs(a: DataFrame, b: DataFrame, closed: bool, smallest: int) -> DataFrame:
    """Overlapping pairs: chrom, a's columns with _a, b's with _b, overlap."""
    one = 1 if closed else 0
    la, lb = levels_of(a, smallest=smallest), levels_of(b, smallest=smallest)
    left = _suffixed(_listed(a, "start", "end", la, lb, True, smallest, closed), "_a", ["chrom", *_PLACE])
    right = _suffixed(_listed(b, "start", "end", lb, la, False, smallest, closed), "_b", ["chrom", *_PLACE])
    start, end = F.greatest("start_a", "start_b"), F.least("end_a", "end_b")
    cond = (F.col("start_a") < F.col("end_b") + one) & (F.col("start_b") < F.col("end_a") + one) & _here(start, "_level", "_bin", smallest)
    # the planner knows neither the rows that are listed nor how well they compress: it would broadcast what the driver cannot hold
    return left.join(right.hint("merge"), ["chrom", *_PLACE]).where(cond).drop(*_PLACE).withColumn("overlap", end - start + one)


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    how: str = "inner",
    min_frac_a: float | None = None,
    reciprocal: bool = False,
    closed: bool = False,
    bin: int | None = None,
) -> DataFrame:
    """Pairs of overlapping rows of a and b; columns get the suffixes _a and _b.

    how: inner; left (rows of a without a partner too); semi or anti (rows of a). min_frac_a: share of a's
    length that the overlap must reach; reciprocal: of b's too. ``overlap`` is the length of the overlap. ``bin``: width of the
    smallest bins, which does not change the result."""
    one = 1 if closed else 0
    size = F.col("overlap")
    cond = F.lit(True)
    if min_frac_a is not None:
        cond = size >= (F.col("end_a") - F.col("start_a") + one) * min_frac_a
        if reciprocal:
            cond = cond & (size >= (F.col("end_b") - F.col("start_b") + one) * min_frac_a)
    if how == "inner":
        return _pairs(a, b, closed, bin or SMALLEST).where(cond)
    # whether a row of a has a partner depends on its place alone; of b no other columns are needed for that
    spot = ["chrom", "start", "end"]
    hit = _pairs(a.select(*spot).distinct(), b.select(*spot).distinct(), closed, bin or SMALLEST).where(cond)
    hit = hit.select("chrom", F.col("start_a").alias("start"), F.col("end_a").alias("end")).distinct()
    if how in ("semi", "anti"):
        return a.join(hit, spot, f"left_{how}")
    lone = _suffixed(a.join(hit, spot, "left_anti"), "_a", ["chrom"])
    return _pairs(a, b, closed, bin or SMALLEST).where(cond).unionByName(lone, allowMissingColumns=True)


def both_sides_join(p: DataFrame, q: DataFrame, closed: bool = False, smallest: int = SMALLEST_PAIRS) -> DataFrame:
    """Pairs of rows of p and q (chrom1, start1, end1, chrom2, start2, end2) that overlap on both sides, met by bins of both: columns with _p
    and _q, and overlap1, overlap2."""
    one = 1 if closed else 0
    keys, cond = [], F.lit(True)
    left, right = p, q
    sizes = {}
    for k in ("1", "2"):
        s, e = f"start{k}", f"end{k}"
        lp, lq = levels_of(p, s, e, smallest), levels_of(q, s, e, smallest)
        left = _listed(left, s, e, lp, lq, True, smallest, closed, k)
        right = _listed(right, s, e, lq, lp, False, smallest, closed, k)
        keys += [f"chrom{k}", *[f"{c}{k}" for c in _PLACE]]
        start, end = F.greatest(f"{s}_p", f"{s}_q"), F.least(f"{e}_p", f"{e}_q")
        cond = cond & (F.col(f"{s}_p") < F.col(f"{e}_q") + one) & (F.col(f"{s}_q") < F.col(f"{e}_p") + one) & _here(start, f"_level{k}", f"_bin{k}", smallest)
        sizes[f"overlap{k}"] = end - start + one
    hit = _suffixed(left, "_p", keys).join(_suffixed(right, "_q", keys).hint("merge"), keys).where(cond)
    return hit.drop(*[c for c in keys if not c.startswith("chrom")]).withColumns(sizes)


def _marked(rows: DataFrame, by: list[str], new) -> DataFrame:
    """Adds ``_island``: the first start of the run of rows that a row belongs to. new(reach): whether a row begins one, by the
    largest end of all rows before it."""
    reached = running(keyed(rows, by, "start"), by, ["start", "end"], "_reach", F.col("end"), "max", inclusive=False)
    first = F.when(F.col("_reach").isNull() | new(F.col("_reach")), F.col("start"))
    return unkeyed(running(reached, by, ["start", "end"], "_island", first, "max").drop("_reach"), by)


def merge_intervals(df: DataFrame, by: list[str] | None = None, max_gap: int = 0, collect: str | None = None) -> DataFrame:
    """Unions of rows that overlap, touch or lie at most ``max_gap`` apart, with the number of rows in
    each; ``collect``: a column whose values are listed in order."""
    by = by or ["chrom"]
    rows = df.select(*by, "start", "end", *([collect] if collect else [])).where("start is not null and end is not null")
    value = [F.array_sort(F.collect_list(collect)).alias("items")] if collect else []
    marked = _marked(rows, by, lambda reach: F.col("start") > reach + max_gap)
    return marked.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), *value).drop("_island")


def mark_islands(df: DataFrame, by: list[str], max_gap: int = 0) -> DataFrame:
    """Adds ``island``: the start of the union (``merge_intervals``) that the row belongs to; rows without a place go."""
    rows = df.where("start is not null and end is not null")
    return _marked(rows, by, lambda reach: F.col("start") > reach + max_gap).withColumnRenamed("_island", "island")


def _of_chroms(b: DataFrame, a: DataFrame) -> DataFrame:
    """The rows of b on chromosomes of a: others meet nothing, and need not be merged."""
    return b.join(a.select("chrom").distinct(), "chrom", "left_semi")


def coverage(a: DataFrame, b: DataFrame, bin: int | None = None) -> DataFrame:
    """Rows of a with n (overlapping rows of b), covered (length of their union within the row),
    length and fraction. Equal rows of a are counted each."""
    keys = a.columns
    own = [F.col("chrom") if c == "chrom" else F.col(f"{c}_a").alias(c) for c in keys]
    spots = a.select("chrom", "start", "end").distinct()
    b = _of_chroms(b.select("chrom", "start", "end"), spots)
    raw = overlap_join(spots, b.select("chrom", "start", "end"), bin=bin).groupBy("chrom", "start_a", "end_a").agg(F.count("*").alias("n"))
    union = Scratch(b.sparkSession, "coverage").save(merge_intervals(b).select("chrom", "start", "end"), "union")
    part = overlap_join(spots, union, bin=bin).groupBy("chrom", "start_a", "end_a").agg(F.sum("overlap").alias("covered"))
    both = raw.join(part, ["chrom", "start_a", "end_a"])
    rows = _suffixed(a, "_a", ["chrom"])
    zero = F.lit(0).cast("long")
    return rows.join(both, ["chrom", "start_a", "end_a"], "left").select(
        *own,
        F.coalesce("n", zero).alias("n"),
        F.coalesce("covered", zero).alias("covered"),
        (F.col("end_a") - F.col("start_a")).alias("length"),
        F.when(F.col("end_a") > F.col("start_a"), F.coalesce("covered", zero) / (F.col("end_a") - F.col("start_a"))).alias("fraction"),
    )


def subtract(a: DataFrame, b: DataFrame, whole: bool = False) -> DataFrame:
    """What b leaves of each row of a (one row for each piece); ``whole``: rows of a that b does not touch."""
    if whole:
        return overlap_join(a, b.select("chrom", "start", "end"), "anti")
    spots = a.select("chrom", "start", "end").distinct()
    union = Scratch(b.sparkSession, "subtract").save(merge_intervals(_of_chroms(b.where("start < end"), spots)).select("chrom", "start", "end"), "union")
    cuts = overlap_join(spots, union).groupBy("chrom", "start_a", "end_a").agg(
        F.array_sort(F.collect_list(F.struct(F.greatest("start_a", "start_b").alias("s"), F.least("end_a", "end_b").alias("e")))).alias("_cuts")
    )
    rows = a.join(cuts.withColumnsRenamed({"start_a": "start", "end_a": "end"}), ["chrom", "start", "end"], "left")
    starts = F.concat(F.array("start"), F.transform(F.coalesce("_cuts", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")), lambda x: x["e"]))
    ends = F.concat(F.transform(F.coalesce("_cuts", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")), lambda x: x["s"]), F.array("end"))
    pieces = rows.withColumn("_p", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e")))).where("_p.s < _p.e")
    return pieces.select(*[F.col("_p.s").alias(c) if c == "start" else F.col("_p.e").alias(c) if c == "end" else F.col(c) for c in a.columns])


def union_width(df: DataFrame, by: list[str] | None = None, closed: bool = False) -> DataFrame:
    """Positions covered by at least one row (closed: end included), for each group."""
    by = by or ["chrom"]
    rows = df.select(*by, "start", (F.col("end") + (1 if closed else 0)).alias("end"))
    return merge_intervals(rows, by).groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("width"))


def group_hull(df: DataFrame, by: list[str]) -> DataFrame:
    """Smallest interval around the rows of each group."""
    return df.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def clamp(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """Starts under 1 become 1, ends beyond the sequence's length become that length (chrom, length)."""
    rows = df.join(lengths, "chrom", "left")
    return rows.select(
        *[F.greatest(F.col(c), F.lit(1)).alias(c) if c == "start" else F.least("end", "length").alias(c) if c == "end" else F.col(c) for c in df.columns]
    )


def expand_by_overhang(regions: DataFrame, repeats: DataFrame) -> DataFrame:
    """Regions widened to the hull with all repeats that overlap them."""
    hull = overlap_join(regions, repeats.select("chrom", "start", "end")).groupBy("chrom", "start_a", "end_a").agg(F.min("start_b").alias("_s"), F.max("end_b").alias("_e"))
    hull = hull.withColumnsRenamed({"start_a": "start", "end_a": "end"})
    rows = regions.join(hull.distinct(), ["chrom", "start", "end"], "left")
    return rows.select(*[F.least("start", "_s").alias(c) if c == "start" else F.greatest("end", "_e").alias(c) if c == "end" else F.col(c) for c in regions.columns])


def transfer_overhang(pairs: DataFrame, repeats: DataFrame, lengths: DataFrame, factor: int = 1) -> DataFrame:
    """pairs: chrom1, start1, end1, chrom2, start2, end2. The second side grows by ``factor`` times what repeats on the first side stick out of it,
    within its sequence (chrom, length)."""
    first = pairs.select(F.col("chrom1").alias("chrom"), F.col("start1").alias("start"), F.col("end1").alias("end")).distinct()
    out = expand_by_overhang(first.withColumns({"s0": F.col("start"), "e0": F.col("end")}), repeats)
    grown = out.select(F.col("chrom").alias("chrom1"), F.col("s0").alias("start1"), F.col("e0").alias("end1"), (F.col("s0") - F.col("start")).alias("_l"), (F.col("end") - F.col("e0")).alias("_r"))
    rows = pairs.join(grown, ["chrom1", "start1", "end1"]).join(lengths.select(F.col("chrom").alias("chrom2"), "length"), "chrom2", "left")
    start, end = F.greatest(F.lit(0), F.col("start2") - factor * F.col("_l")), F.least("length", F.col("end2") + factor * F.col("_r"))
    return rows.select(*pairs.columns, start.alias("grown_start"), end.alias("grown_end"))


def nonrepeat_filter(regions: DataFrame, repeats: DataFrame, least: int = 500, satellites: DataFrame | None = None, most_share: float = 0.7) -> DataFrame:
    """Regions with at least ``least`` positions outside the repeats and, if ``satellites`` are given, at most ``most_share`` of theirs in those."""
    left = coverage(regions, repeats).where(F.col("length") - F.col("covered") >= least).select(*regions.columns)
    return left if satellites is None else coverage(left, satellites).where(F.col("fraction") <= most_share).select(*regions.columns)


def redistribute(base: DataFrame, merged: DataFrame, value: str) -> DataFrame:
    """Give each base window inside a merged window an equal part of the merged window's value."""
    tmp = Scratch(base.sparkSession, "redistribute")  # a join reads its sides for their levels, and again for their rows
    inside = overlap_join(tmp.save(base, "base"), tmp.save(merged, "merged"), min_frac_a=1.0)
    inside = tmp.save(inside.select("chrom", "start_a", "end_a", "start_b", "end_b", f"{value}_b"), "inside")
    count = inside.groupBy("chrom", "start_b", "end_b").agg(F.count("*").alias("_n"))
    return inside.join(count, ["chrom", "start_b", "end_b"]).select(
        "chrom", F.col("start_a").alias("start"), F.col("end_a").alias("end"), (F.col(f"{value}_b") / F.col("_n")).alias(value)
    )


def grow_to_fixpoint(windows: DataFrame, regions: DataFrame) -> DataFrame:
    """Windows widened by the regions that stick out of them, until nothing changes: the hull of each
    connected group of overlapping windows and regions that holds a window."""
    both = windows.select("chrom", "start", "end", F.lit(1).alias("w")).unionByName(regions.select("chrom", "start", "end", F.lit(0).alias("w")))
    marked = _marked(both.where("start is not null and end is not null"), ["chrom"], lambda reach: F.col("start") >= reach)
    return marked.groupBy("chrom", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("w").alias("w")).where("w = 1").drop("_island", "w")


def adjacent_windows(windows: DataFrame, shared: int = 500) -> DataFrame:
    """Adds ``cluster``, the first start of a run of windows each of which overlaps the one before it (in the order of starts, then ends) by more than
    ``shared`` or lies inside it."""
    rows = keyed(windows.where("start is not null and end is not null"), ["chrom"], "start")
    rows = running(rows, ["chrom"], ["start", "end"], "_p", F.struct("start", "end"), "last", inclusive=False)
    inside = (F.col("start") >= F.col("_p.start")) & (F.col("end") <= F.col("_p.end"))
    near = F.least("end", F.col("_p.end")) - F.greatest("start", F.col("_p.start")) > shared
    first = F.when(F.col("_p").isNull() | ~(inside | near), F.struct("start", "end"))
    rows = unkeyed(running(rows, ["chrom"], ["start", "end"], "_first", first, "last"), ["chrom"])
    return rows.select(*windows.columns, F.col("_first.start").alias("cluster"))


def carry_hulls(windows: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """windows: chrom, start, end, hull_start, hull_end (what a window would grow to; null: itself). In the order of places a window strictly inside the hull that is
    carried takes that hull (extended true); any other carries on its own hull. Adds extended; windows with a null place are left out.

    As starts ascend, the hull of a window holds until the next window, if that does not begin inside, or the first one after it that ends at the hull's end or
    beyond. So each window has a successor, whatever came before it, and the windows that carry their own hulls are those that successors
    reach from the first one of a chromosome: found by jumps of 1, 2, 4, ... successors. Successors come from within a block of ``block`` windows, or from the first later
    block with a large enough end, so no task holds a run of windows."""
    tmp = Scratch(windows.sparkSession, "hulls")
    names, order = windows.columns, ["start", "end", "hull_start", "hull_end"]
    whole = windows.where("chrom is not null and start is not null and end is not null")
    whole = whole.withColumns({"hull_start": F.coalesce("hull_start", "start"), "hull_end": F.coalesce("hull_end", "end")})
    rows = unkeyed(running(keyed(whole, ["chrom"], "start"), ["chrom"], order, "_pos", F.lit(1), "sum"), ["chrom"]).withColumn("_pos", F.col("_pos") - 1)
    rows = tmp.save(rows.withColumn("_block", F.expr(f"_pos div {block}")), "rows")
    kind = rows.schema["chrom"].dataType.simpleString()

    def within(pdf):
        pdf = pdf.sort_values("_pos")
        s, e, a, b = (pdf[c].to_numpy(np.int64) for c in order)
        n = len(pdf)
        # levels of maxima of 1, 2, 4, ... ends, by which the first end that is large enough is found
        tops = [np.append(e, np.iinfo(np.int64).min)]
        while 1 << len(tops) <= n:
            step, last = 1 << (len(tops) - 1), tops[-1]
            tops.append(np.maximum(last, last[np.minimum(np.arange(n + 1) + step, n)]))
        at = np.arange(1, n + 1)
        for k in range(len(tops) - 1, -1, -1):
            at = np.where((at < n) & (tops[k][np.minimum(at, n)] < b), np.minimum(at + (1 << k), n), at)
        outside = np.append(s[1:] <= a[:-1], False)
        at = np.where(outside, np.arange(1, n + 1), at)
        pos = pdf["_pos"].to_numpy(np.int64)
        top = np.maximum.accumulate(e)
        return pdf.assign(_next=np.where(at < n, pos + (at - np.arange(n)), -1), _last=np.arange(n) == n - 1, _prior=np.append(np.iinfo(np.int64).min // 4, top[:-1]), _record=np.append(True, e[1:] > top[:-1]))

    spots = rows.select("chrom", *[F.col(c).cast("long").alias(c) for c in order], "_pos", "_block")
    schema = f"chrom {kind}, {', '.join(f'{c} long' for c in order)}, _pos long, _block long, _next long, _last boolean, _prior long, _record boolean"
    spots = tmp.save(spots.groupBy("chrom", "_block").applyInPandas(within, schema), "spots")
    blocks = spots.groupBy("chrom", "_block").agg(F.max("end").alias("top"), F.min("_pos").alias("first"), F.min("start").alias("low"))
    blocks = tmp.save(blocks, "blocks")
    pending = spots.where("_next < 0").select("chrom", "_pos", "hull_start", F.col("hull_end").alias("reach"), (F.col("_block") + 1).alias("_at"), "_last")
    ahead = blocks.select("chrom", F.col("_block").alias("_at"), "low", "first")
    pending = tmp.save(pending.join(ahead, ["chrom", "_at"]).withColumn("_next", F.when(F.col("_last") & (F.col("low") <= F.col("hull_start")), F.col("first"))), "pending")
    # the first later block whose largest end reaches: skip 2**k blocks whose ends do not, from the largest k on
    most = blocks.groupBy("chrom").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = [blocks.select("chrom", F.col("_block").alias("_at"), "top")]
    for k in range(max(1, most).bit_length() - 1):
        later = levels[-1].select("chrom", (F.col("_at") - (1 << k)).alias("_at"), F.col("top").alias("_top"))
        levels.append(tmp.save(levels[-1].join(later, ["chrom", "_at"], "left").select("chrom", "_at", F.greatest("top", "_top").alias("top")), f"level{k}"))
    search = pending.where("_next is null").select("chrom", "_pos", "reach", "_at")
    for k in range(len(levels) - 1, -1, -1):
        seen = search.join(levels[k], ["chrom", "_at"])  # beyond the last block nothing is found
        search = seen.withColumn("_at", F.col("_at") + F.when(F.col("top") < F.col("reach"), 1 << k).otherwise(0)).drop("top")
    key = F.struct("chrom", "_at").alias("chrom")
    points = search.select(key, F.col("reach").alias("start"), (F.col("reach") + 1).alias("end"), "_pos")
    records = spots.where("_record").select(F.struct("chrom", F.col("_block").alias("_at")).alias("chrom"), (F.col("_prior") + 1).alias("start"), (F.col("end") + 1).alias("end"), "_pos")
    found = overlap_join(points, records).select(F.col("chrom.chrom").alias("chrom"), F.col("_pos_a").alias("_pos"), F.col("_pos_b").alias("_next"))
    after = spots.where("_next >= 0").select("chrom", "_pos", "_next").unionByName(pending.where("_next is not null").select("chrom", "_pos", "_next")).unionByName(found)
    after = tmp.save(after, "successors")
    reached = tmp.save(spots.where("_pos = 0").select("chrom", "_pos"), "reached")
    n = 1
    while True:
        more = reached.join(after, ["chrom", "_pos"]).select("chrom", F.col("_next").alias("_pos"))
        if not more.limit(1).count():
            break
        wider = tmp.save(reached.unionByName(more).distinct(), f"reached{n}")
        tmp.drop(reached)
        reached, n = wider, n + 1
        twice = after.join(after.select("chrom", F.col("_pos").alias("_next"), F.col("_next").alias("_to")), ["chrom", "_next"]).select("chrom", "_pos", F.col("_to").alias("_next"))
        longer = tmp.save(twice, f"jump{n}")
        tmp.drop(after)
        after = longer
    marked = rows.join(reached.withColumn("_own", F.lit(True)), ["chrom", "_pos"], "left")
    hull = F.when(F.col("_own"), F.struct("hull_start", "hull_end"))
    done = running(marked, ["chrom"], ["_pos"], "_hull", hull, "last")
    shown = {"hull_start": F.col("_hull.hull_start"), "hull_end": F.col("_hull.hull_end")}
    return done.select(*[shown.get(c, F.col(f"`{c}`")).alias(c) for c in names], F.col("_own").isNull().alias("extended"))
