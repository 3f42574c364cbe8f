"""Duplicated regions of a reference: windows with similar k-mer sets, clusters of such pairs, regions for the aligner, and what of its alignments stays.

Windows are chrom, start, end, seq (repeats masked by N); pairs are chrom1, start1, end1, chrom2, start2, end2 with the first side before the second.

Defined cases: windows without k-mers and rows with nulls in their places have no pairs; equal windows of different places are a pair with a similarity of 1; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions import kmers
from spanweave.operators import clustering, intervals, pairs, setjoin, tables
from spanweave.plans.stages import Run
from spanweave.scratch import Scratch
from spanweave.sources import formats

PLACE = ["chrom", "start", "end"]
SIDES = [*pairs.SIDE1, *pairs.SIDE2]


def window_pairs(windows: DataFrame, k: int = 11, least: float = 0.05, apart: float = 0.1, touching: float = 0.6) -> DataFrame:
    """Pairs of windows with the Jaccard of their k-mer sets, exact: from ``least`` on, then from ``apart`` on, or above ``touching`` if they touch. Pairs of one
    masked repeat's equal windows are all in the result, so repeats should be masked."""
    spots = windows.dropna(subset=PLACE).select(F.struct(*PLACE).alias("w"), "seq")
    classes = setjoin.set_classes(kmers.kmer_rows(spots, "w", F.col("seq"), k), "w", ["hi", "lo"])
    classes = Scratch(windows.sparkSession, "windows").save(classes, "classes")
    near = setjoin.similar_classes(classes, "w", least).select("a", "b", "jaccard")
    same = classes.groupBy("rep").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("jaccard"))
    member = lambda c: classes.select(F.col("rep").alias(c), F.col("w").alias(f"_{c}"))
    every = near.unionByName(same).join(member("a"), "a").join(member("b"), "b").where("a <> b or _a < _b")
    first, second = F.least("_a", "_b"), F.greatest("_a", "_b")
    out = every.select(*[x[c].alias(f"{c}{k}") for k, x in ((1, first), (2, second)) for c in PLACE], "jaccard")
    return pairs.overlap_dependent_threshold(out, "jaccard", apart, touching)


def duplicated_regions(found: DataFrame, gap: int = 10_000, eps: float = 300_000, resplit: tuple = ((1000, 10_000.0), (10_000, 5_000.0))) -> DataFrame:
    """Hulls of the pairs' clusters: pairs of the same two sequences whose first sides lie at most ``gap`` apart and whose four ends are linked by steps of at most ``eps``; clusters
    with many rows are clustered again by smaller steps."""
    rows = found.select(*SIDES).dropna().distinct()
    rows = intervals.mark_islands(rows.withColumnsRenamed({"start1": "start", "end1": "end"}), ["chrom1", "chrom2"], gap).withColumnsRenamed({"start": "start1", "end": "end1"})
    rows = tables.number_rows(rows, "chrom1", "start1", "end1", "chrom2", "start2", "end2", name="id")
    rows = Scratch(found.sparkSession, "regions").save(rows, "rows")
    cluster = clustering.eps_clusters(rows, ["chrom1", "chrom2", "island"], ["start1", "start2", "end1", "end2"], eps, resplit)
    low, high = [F.min(c).alias(c) for c in ("start1", "start2")], [F.max(c).alias(c) for c in ("end1", "end2")]
    return rows.join(cluster, "id").groupBy("cluster", "chrom1", "chrom2").agg(*low, *high).select(*SIDES)


def drop_repeated_selves(regions: DataFrame, repeats: DataFrame, share: float = 0.98) -> DataFrame:
    """Without the pairs that overlap themselves and whose first side is repeats by ``share`` or more."""
    return _side(regions, 1, lambda df: intervals.coverage(df, repeats)).where(
        ~((F.col("chrom1") == F.col("chrom2")) & (F.col("start1") <= F.col("end2")) & (F.col("end1") >= F.col("start2")) & (F.col("fraction") >= share))
    ).select(*regions.columns)


def _side(df: DataFrame, k: int, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    there = {f"{c}{k}": c for c in PLACE}
    return change(df.withColumnsRenamed(there)).withColumnsRenamed({c: n for n, c in there.items()})


def grown_regions(regions: DataFrame, repeats: DataFrame, lengths: DataFrame) -> DataFrame:
    """Both sides widened by what repeats stick out of either of them, within their sequences."""
    once = pairs.swap_sides(_grow(regions, repeats, lengths))
    return pairs.swap_sides(_grow(once, repeats, lengths)).select(*SIDES).distinct()


def _grow(regions: DataFrame, repeats: DataFrame, lengths: DataFrame) -> DataFrame:
    out = intervals.transfer_overhang(regions.select(*SIDES), repeats, lengths)
    return out.select(*pairs.SIDE1, "chrom2", F.col("grown_start").alias("start2"), F.col("grown_end").alias("end2"))


def kept_alignments(aligned: DataFrame, repeats: DataFrame, satellites: DataFrame | None = None, least: int = 500, share: float = 0.9) -> DataFrame:
    """Alignments (``parse_paf``) that are accepted, whose sides both have ``least`` positions outside the repeats, the first at most 70 % satellites, that do not touch themselves, and that
    no longer one contains by ``share`` on both sides."""
    rows = pairs.accepted(aligned).withColumnsRenamed({f"{n}_{c}": f"{c if c != 'chr' else 'chrom'}{k}" for n, k in (("ref", 1), ("que", 2)) for c in ("chr", "start", "end")})
    rows = Scratch(aligned.sparkSession, "alignments").save(rows.distinct(), "accepted")
    rows = _side(rows, 1, lambda df: intervals.nonrepeat_filter(df, repeats, least, satellites))
    rows = _side(rows, 2, lambda df: intervals.nonrepeat_filter(df, repeats, least))
    rows = pairs.drop_self_overlaps(rows).withColumn("_all", F.lit(1))
    return clustering.greedy_dedup(rows, ["_all"], sides=2, thr=share).drop("_all")


def annotate(spark: SparkSession, folder: str, inputs: dict[str, str], align: Callable[[DataFrame], DataFrame], aligner: str, k: int = 11, eps: float = 300_000) -> tuple[DataFrame, Run]:
    """The whole plan, in stages that can be taken up again. inputs: windows (a Parquet table), repeats and satellites (BED), lengths (a sequence index). ``align`` takes regions (the six
    columns) and gives PAF lines (value) whose names are chrom:start-end; ``aligner`` names it and its version, for the digest."""
    run = Run(spark, folder, inputs)
    bed = lambda path: formats.read_bed(spark, path)
    run.stage("pairs", lambda path, k: window_pairs(spark.read.parquet(path), k), inputs=["windows"], k=k)
    run.stage("regions", lambda found, path, eps: drop_repeated_selves(duplicated_regions(found, eps=eps), bed(path)), ["pairs"], ["repeats"], eps=eps)
    run.stage("grown", lambda found, path, sizes: grown_regions(found, bed(path), formats.read_lengths(spark, sizes)), ["regions"], ["repeats", "lengths"])
    run.stage("aligned", lambda found, aligner: formats.parse_paf(align(found)), ["grown"], aligner=aligner)
    done = run.stage("duplications", lambda found, path, sat: kept_alignments(found, bed(path), bed(sat)), ["aligned"], ["repeats", "satellites"])
    return done, run
