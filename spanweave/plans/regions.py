"""Complexity classes of regions: features of windows from five branches, joined, scaled, encoded and assigned to classes.

Windows are chrom, start, end. Each branch gives a table of windows; a window without variants is in no branch of diversity and hence not classed.

Defined cases: a window with a null feature is left out; windows without bubble, repeats or elements have the defaults 0.01, 0 and null; equal windows count once; empty tables give none.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions import kmers
from spanweave.operators import intervals, model, stats
from spanweave.plans.stages import Run
from spanweave.scratch import Scratch
from spanweave.sources import formats

PLACE = ["chrom", "start", "end"]
# fixed values: the bubble features of a window that lies in no bubble
NO_BUBBLE = 0.01
#: Windows of up to this width (the end of a level) meet their variants in one task.
WIDE = intervals.SMALLEST * intervals.FACTOR**4
TASK_VARIANTS = 1 << 18


def variants_of(vcf: DataFrame) -> DataFrame:
    """chrom, start, end, ref_len, alt_len (the longest allele), entropy (of the samples' calls) of each row of a VCF; row by row, without a shuffle."""
    samples = vcf.columns[9:]
    alt = F.array_max(F.transform(F.split("ALT", ","), F.length))
    size = F.length("REF")
    calls = F.array(*[F.col(f"`{c}`") for c in samples]) if samples else F.array().cast("array<string>")
    return vcf.select(
        F.col("CHROM").alias("chrom"), F.col("POS").alias("start"), (F.col("POS") + size).alias("end"),
        size.alias("ref_len"), alt.alias("alt_len"), stats.entropy_of(calls).alias("entropy"),
    )


def _diversity_of_wide(windows: DataFrame, variants: DataFrame) -> DataFrame:
    """``window_diversity`` of windows that may hold a chromosome's variants: their orders are taken in blocks."""
    met = intervals.overlap_join(windows, variants)
    met = Scratch(windows.sparkSession, "diversity").save(met, "met")
    rows = met.select(
        "chrom", F.col("start_a").alias("wstart"), F.col("end_a").alias("wend"), F.col("start_b").alias("vstart"), F.col("end_b").alias("vend"),
        F.col("ref_len_b").alias("ref_len"), F.col("alt_len_b").alias("alt_len"), F.col("entropy_b").alias("entropy"),
    )
    keys = ["chrom", "wstart", "wend"]
    mean = rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col("entropy") * F.col("alt_len")), F.sum("alt_len")).alias("entropy"), F.sum("alt_len").alias("weight"))
    near = stats.window_similarity(rows).select(*keys, F.col("sim").alias("win_sim"))
    return mean.join(near, keys).withColumnsRenamed({"wstart": "start", "wend": "end"}).select(*PLACE, "entropy", "weight", "win_sim")


def _diversity_by_blocks(windows: DataFrame, variants: DataFrame, widths: dict[int, int]) -> DataFrame:
    """``window_diversity`` with one shuffle of the variants: a window lies in the block of its width's level (``widths``: the widest of each) in which it starts, a variant in
    all blocks in which a window that it overlaps can start. So a window meets its variants, orders and adds them up in one task."""
    size = lambda k: intervals.SMALLEST * intervals.FACTOR**k
    spot = lambda k: lambda block: block * (intervals.MOST_LEVELS + 1) + k
    # a number of tasks that is given is not coalesced by the size of what is shuffled, which the join multiplies
    tasks = max(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-variants.count() // TASK_VARIANTS))
    at = F.coalesce(*[F.when(intervals.level_of("start", "end") == k, spot(k)(F.floor(F.col("start") / size(k)))) for k in widths])
    placed = windows.select("chrom", at.alias("_at"), F.col("start").alias("ws"), F.col("end").alias("we")).repartition(tasks, "chrom", "_at").distinct()
    last = F.greatest(F.col("start"), F.col("end") - 1)
    spots = [F.transform(F.sequence(F.floor((F.col("start") - width) / size(k)), F.floor(last / size(k))), spot(k)) for k, width in widths.items()]
    listed = variants.select(
        "chrom", F.explode(F.concat(*spots)).alias("_at"), F.col("start").alias("vs"), (F.col("end") - F.col("start")).alias("v"), F.col("alt_len").alias("a"), F.col("entropy").alias("h"), F.greatest("ref_len", "alt_len").alias("n")
    )
    listed = listed.repartition(tasks, "chrom", "_at")
    met = placed.join(listed.hint("merge"), ["chrom", "_at"]).withColumn("ve", F.col("vs") + F.col("v")).where("vs < we and ws < ve")
    keys = ["chrom", "_at", "ws", "we"]
    reach = F.max("ve").over(Window.partitionBy(*keys).orderBy("vs").rowsBetween(Window.unboundedPreceding, -1))
    # of closed spans: what this one adds to those before it
    met = met.withColumn("_new", F.greatest(F.lit(0), F.col("ve") - F.greatest(F.col("vs") - 1, reach)))
    sums = met.groupBy(*keys).agg(F.sum(F.col("h") * F.col("a")).alias("h"), F.sum("a").alias("weight"), F.sum("n").alias("n"), F.sum("_new").alias("uniq"), F.min("vs").alias("lo"), F.max("ve").alias("hi"))
    match = F.greatest("we", "hi") - F.least("ws", "lo") + 1 - F.col("uniq")
    return sums.select(
        "chrom", F.col("ws").alias("start"), F.col("we").alias("end"), F.try_divide("h", "weight").alias("entropy"), "weight", F.try_divide(match, match + F.col("n")).alias("win_sim")
    )


def window_diversity(windows: DataFrame, variants: DataFrame) -> DataFrame:
    """chrom, start, end, entropy (mean over the window's variants, weighted by the longest allele), weight (the sum of those) and win_sim (share of positions that no variant changes) of windows with variants."""
    windows, level = windows.select(*PLACE), intervals.level_of("start", "end")
    widest = windows.where("start is not null and end is not null").groupBy(level.alias("k")).agg(F.max(F.col("end") - F.col("start")).alias("w")).collect()
    widths = {r.k: max(1, r.w) for r in widest if r.w <= WIDE}
    wide = F.col("end") - F.col("start") > WIDE
    parts = [_diversity_by_blocks(windows.where(~wide), variants, widths)] if widths else []
    if len(widths) < len(widest) or not parts:
        parts.append(_diversity_of_wide(windows.where(wide).distinct(), variants))
    return reduce(DataFrame.unionByName, parts)


def haplotype_similarity(haplotypes: DataFrame, segments: DataFrame, k: int = 31) -> DataFrame:
    """chrom, start, end, sample, sim: the share of the k-mers of each sample's sequence of a window (haplotypes: window columns, sample, seq) that the duplicated segments (seq)
    hold; sequences without k-mers have no row."""
    rows = haplotypes.select(F.struct(*PLACE, "sample").alias("_w"), "seq")
    return kmers.sequence_share(rows, "_w", F.col("seq"), k, segments, F.col("seq")).select("_w.*", F.col("share").alias("sim"))


def homology_variation(similarities: DataFrame) -> DataFrame:
    """sd_max (the largest similarity of any sample) and sd_var (trimmed sd over the samples) of each window."""
    most = stats.row_max(similarities, PLACE, "sim").withColumnRenamed("row_max", "sd_max")
    return most.join(stats.trimmed_stats(similarities, PLACE, "sim").select(*PLACE, F.col("sd").alias("sd_var")), PLACE)


def element_variation(deltas: DataFrame) -> DataFrame:
    """TEgini: trimmed Gini coefficient of the samples' element lengths (delta) in each window; 0 where it is undefined. Windows of which trimming leaves no sample have no row."""
    return stats.trimmed_stats(deltas, PLACE, "delta").where("n > 0").select(*PLACE, F.coalesce("gini", F.lit(0.0)).alias("TEgini"))


def repeat_variation(windows: DataFrame, copies: DataFrame) -> DataFrame:
    """vntr_cov (1 if a tandem repeat lies in the window, else 0) and vntr_gini_max: the largest trimmed Gini coefficient over the samples of the window's loci (chrom, start, end, sample, copies).
    Loci of which trimming leaves no sample do not count."""
    loci = stats.trimmed_stats(copies, PLACE, "copies").where("n > 0").select(*PLACE, "gini")
    spots = windows.select(*PLACE).distinct()
    met = intervals.overlap_join(spots, loci).groupBy("chrom", "start_a", "end_a").agg(F.max("gini_b").alias("_g"), F.sum("overlap").alias("_n"))
    met = met.withColumnsRenamed({"start_a": "start", "end_a": "end"})
    cov = F.when(F.col("_n") > 0, 1.0).otherwise(0.0)
    return spots.join(met, PLACE, "left").select(*PLACE, cov.alias("vntr_cov"), F.coalesce("_g", F.lit(0.0)).alias("vntr_gini_max"))


def bubble_features(windows: DataFrame, bubbles: DataFrame) -> DataFrame:
    """sim_bubble and com_bubble of windows that lie whole in a bubble region (chrom, start, end, poly, polyratio, simple, pathratio); of several regions the larger values count."""
    few = F.when(F.col("pathratio") < 0.5, 1).otherwise(0)
    scored = bubbles.dropna().select(
        *PLACE, (stats.sigmoid(F.col("simple"), 3, 3) + few).alias("sim"),
        (2 * stats.sigmoid(stats.sigmoid(F.col("polyratio"), 100, 0.1) * F.col("poly"), 3, 3) + few).alias("com"),
    )
    met = intervals.overlap_join(windows.select(*PLACE).distinct(), scored, min_frac_a=1.0)
    best = met.groupBy("chrom", "start_a", "end_a").agg(F.max("sim_b").alias("sim_bubble"), F.max("com_b").alias("com_bubble"))
    return best.withColumnsRenamed({"start_a": "start", "end_a": "end"})


def region_features(diversity: DataFrame, elements: DataFrame, homology: DataFrame, repeats: DataFrame, bubbles: DataFrame) -> DataFrame:
    """The windows of the diversity branch with the model's features, as far as none is null."""
    tables = [elements, homology, repeats, bubbles]
    rows = model.assemble(diversity, tables, PLACE, drop_null=False)
    rows = rows.fillna(NO_BUBBLE, ["sim_bubble", "com_bubble"]).withColumn("Vscore", model.vscore(F.col("win_sim"), F.col("entropy")))
    return rows.dropna().select(*PLACE, *model.FEATURES)


def class_regions(features: DataFrame, mean: list[float], std: list[float], layers: list[tuple[np.ndarray, np.ndarray]], centroids: list[list[float]]) -> DataFrame:
    """chrom, start, end, cluster and the probability of each class, from features and fitted parameters."""
    x = features.select(*PLACE, model.scale(F.array(*[F.col(c).cast("double") for c in model.FEATURES]), mean, std).alias("x"))
    z = model.encode(x, "x", layers).withColumn("q", model.soft_assign(F.col("z"), centroids))
    labels = model.LABELS[: len(centroids)]
    each = [F.col("q")[k].alias(label) for label, k in sorted((c, k) for k, c in enumerate(labels) if c != "simple")]
    return z.select(*PLACE, model.argmax_label(F.col("q"), labels).alias("cluster"), F.col("q")[0].alias("simple"), *each)


def decompose(spark: SparkSession, folder: str, inputs: dict[str, str], fitted: dict, width: int = 1000, step: int = 500, k: int = 31) -> tuple[DataFrame, Run]:
    """The whole plan from files, in stages that can be taken up again. inputs: bed (regions), vcf, and Parquet tables haplotypes (window, sample, seq), segments
    (seq), deltas (window, sample, delta), copies (locus, sample, copies), bubbles. fitted: mean, std, layers, centroids."""
    run = Run(spark, folder, inputs)
    read = spark.read.parquet
    cut = lambda path, width, step: intervals.make_windows(intervals.merge_intervals(formats.read_bed(spark, path)).drop("n"), width, step)
    run.stage("windows", cut, inputs=["bed"], width=width, step=step)
    run.stage("variants", lambda path: variants_of(formats.read_vcf(spark, path)), inputs=["vcf"])
    run.stage("diversity", window_diversity, ["windows", "variants"])
    run.stage("similarity", lambda haps, segments, k: haplotype_similarity(read(haps), read(segments), k), inputs=["haplotypes", "segments"], k=k)
    run.stage("homology", homology_variation, ["similarity"])
    run.stage("elements", lambda path: element_variation(read(path)), inputs=["deltas"])
    run.stage("repeats", lambda windows, path: repeat_variation(windows, read(path)), ["windows"], ["copies"])
    run.stage("bubbles", lambda windows, path: bubble_features(windows, read(path)), ["windows"], ["bubbles"])
    run.stage("features", region_features, ["diversity", "elements", "homology", "repeats", "bubbles"])
    plain = {n: [[np.asarray(a).tolist() for a in x] for x in v] if n == "layers" else v for n, v in fitted.items()}
    done = run.stage("classes", lambda features, **p: class_regions(features, p["mean"], p["std"], p["layers"], p["centroids"]), ["features"], **plain)
    return done, run
