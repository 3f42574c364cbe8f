"""Statistics of rows and groups.

Defined cases: null values do not count, and a group of nulls only has null or zero statistics; a null group key is a group; repeated rows
count each; empty tables give none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.intervals import union_width
from spanweave.scratch import Scratch


def normalized_entropy(df: DataFrame, by: list[str], value: str, drop: tuple = (".",)) -> DataFrame:
    """entropy: Shannon entropy of the values over log2 of their number, both rounded to 5 places; 0 if
    there is one value."""
    counts = df.where(F.col(value).isNotNull() & ~F.col(value).isin(*drop)).groupBy(*by, value).agg(F.count("*").alias("c"))
    # sum p log2 p from partial sums: log2 n - sum(c log2 c) / n
    sums = counts.groupBy(*by).agg(F.sum("c").alias("_n"), F.sum(F.col("c") * F.log2("c")).alias("_s"), F.count("*").alias("_k"))
    h = F.round(F.log2("_n") - F.col("_s") / F.col("_n"), 5)
    return sums.select(*by, F.when((F.col("_k") < 2) | (h == 0), 0.0).otherwise(h / F.round(F.log2("_k"), 5)).alias("entropy"))


def entropy_of(values: Column, drop: tuple = (".",)) -> Column:
    """``normalized_entropy`` of an array column, row by row; 0 where nothing is left."""
    kept = F.filter(values, lambda x: x.isNotNull() & ~x.isin(*drop))
    counts = F.transform(F.array_distinct(kept), lambda x: F.size(F.filter(kept, lambda y: y == x)))
    n, k = F.size(kept), F.size(counts)
    part = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * F.log2(c))
    h = F.round(F.log2(n) - part / n, 5)
    return F.when((k < 2) | (h == 0), 0.0).otherwise(h / F.round(F.log2(k), 5))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def window_similarity(variants: DataFrame) -> DataFrame:
    """Rows window columns (chrom, wstart, wend) and a variant's closed span and lengths (vstart, vend,
    ref_len, alt_len): positions of the window no variant touches over these plus the variants' lengths."""
    keys = ["chrom", "wstart", "wend"]
    spans = variants.select(*keys, F.col("vstart").alias("start"), F.col("vend").alias("end"))
    uniq = union_width(spans, keys, closed=True)
    size = variants.groupBy(*keys).agg(F.min("vstart").alias("lo"), F.max("vend").alias("hi"), F.sum(F.greatest("ref_len", "alt_len")).alias("alignlen"))
    rows = size.join(uniq, keys)
    first, last = F.least("wstart", "lo"), F.greatest("wend", "hi")
    match = last - first + 1 - F.col("width")
    return rows.select(*keys, F.col("width").alias("uniq"), match.alias("match"), "alignlen", F.try_divide(match, match + F.col("alignlen")).alias("sim"))


def trimmed_stats(df: DataFrame, by: list[str], value: str, prop: float = 0.05) -> DataFrame:
    """sd (sample) and gini (uncorrected) of the values between the exact ``prop`` and 1 - ``prop`` quantiles, null where fewer than two are left, and
    n, how many are left (of two different values none)."""
    rows = df.where(F.col(value).isNotNull())
    cut = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(prop), F.lit(1 - prop))).alias("_q"))
    kept = rows.join(cut, by).where((F.col(value) >= F.col("_q")[0]) & (F.col(value) <= F.col("_q")[1]))
    order = Window.partitionBy(*by).orderBy(value)
    ranked = kept.withColumn("_i", F.row_number().over(order))
    sums = ranked.groupBy(*by).agg(F.count("*").alias("_n"), F.stddev_samp(value).alias("_sd"), F.sum(value).alias("_t"), F.sum(F.col("_i") * F.col(value)).alias("_r"))
    gini = F.try_divide(2 * F.col("_r") - (F.col("_n") + 1) * F.col("_t"), F.col("_n") * F.col("_t"))
    return cut.select(*by).join(sums, by, "left").select(*by, F.when(F.col("_n") >= 2, F.col("_sd")).alias("sd"), F.when(F.col("_n") >= 2, gini).alias("gini"), F.coalesce("_n", F.lit(0)).alias("n"))


def row_max(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max(value).alias("row_max"))


def class_counts(df: DataFrame, by: list[str], kind: str, classes: list[str], prefix: str = "n_") -> DataFrame:
    """One column for each class of a fixed list with the number of rows."""
    return df.groupBy(*by).agg(*[F.count(F.when(F.col(kind) == c, 1)).alias(prefix + c) for c in classes])


def sigmoid(x: Column, k: float, c: float) -> Column:
    return 1 / (1 + F.exp(-k * (x - c)))


def bubble_score(df: DataFrame) -> DataFrame:
    """com_bubble from the columns poly, polyrefine, simple and pathratio, normalised over all rows."""
    poly = sigmoid(F.col("poly"), 100, 0.1)
    score = 2 * sigmoid(F.col("polyrefine") * poly, 3, 3) + sigmoid(F.col("simple"), 3, 3) + F.when(F.col("pathratio") < 0.5, 1).otherwise(0)
    return min_max(df.withColumn("bubble", score), "bubble", "norm_bubble")


def min_max(df: DataFrame, value: str, name: str) -> DataFrame:
    """The value on a scale of 0 to 1 over all rows (0 if it is constant); the one-row range is broadcast."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    return df.join(F.broadcast(span)).withColumn(name, F.when(width == 0, 0.0).otherwise((F.col(value) - F.col("_lo")) / width)).drop("_lo", "_hi")


def group_frequency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count of each value in a group, the group's total and their ratio."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*by))
    return counts.withColumn("total", total).withColumn("freq", F.col("count") / F.col("total"))


def odds_ratio(df: DataFrame, exposed: Column, case: Column) -> DataFrame:
    """One row: the 2x2 counts, their cross-product ratio and its 95 % log-normal interval."""
    n = [F.count(F.when(e & c, 1)) for e, c in ((exposed, case), (exposed, ~case), (~exposed, case), (~exposed, ~case))]
    rows = df.agg(*[x.alias(k) for x, k in zip(n, "abcd")])
    ratio = F.try_divide(F.col("a") * F.col("d"), F.col("b") * F.col("c"))
    se = F.sqrt(sum((F.try_divide(F.lit(1), F.col(k)) for k in "bcd"), F.try_divide(F.lit(1), F.col("a"))))
    return rows.select("a", "b", "c", "d", ratio.alias("odds_ratio"), F.exp(F.log(ratio) - 1.96 * se).alias("low"), F.exp(F.log(ratio) + 1.96 * se).alias("high"))


#: Chromosomes of targets up to which they are broadcast, so that intervals on others are not shuffled.
MOST_CHROMS = 100_000


def enrichment(targets: DataFrame, observed: DataFrame, shuffled: DataFrame, ratio: float) -> DataFrame:
    """Named targets covered beyond ``ratio``: number with the observed intervals, with each of the shuffles (column
    shuffle_id), and p = (1 + shuffles with at least as many) / (1 + shuffles). Only intervals are there once for each replicate: targets meet the unions of all replicates at once, and as
    a union's intervals are apart, what they cover of a name's targets is a sum over the pairs."""
    from spanweave.operators.intervals import merge_intervals, overlap_join

    tmp = Scratch(targets.sparkSession, "enrichment")
    chroms = tmp.save(targets.select("chrom").where("chrom is not null").distinct(), "chroms")
    here = F.broadcast(chroms) if chroms.count() <= MOST_CHROMS else chroms
    whose = F.lit(-1).cast(shuffled.schema["shuffle_id"].dataType).alias("shuffle_id")
    place = ["shuffle_id", "chrom", "start", "end"]
    every = observed.select(whose, "chrom", "start", "end").unionByName(shuffled.select(*place)).join(here, "chrom", "left_semi")
    union = tmp.save(merge_intervals(every, ["shuffle_id", "chrom"]).select(*place), "union")
    met = overlap_join(targets.select("chrom", "start", "end", "name"), union)
    covered = met.groupBy(F.col("shuffle_id_b").alias("shuffle_id"), F.col("name_a").alias("name")).agg(F.sum("overlap").alias("covered"))
    ids = shuffled.select("shuffle_id").distinct().unionByName(observed.limit(1).select(whose))
    total = targets.groupBy("name").agg(F.sum(F.col("end") - F.col("start")).alias("length")).join(F.broadcast(ids))
    named = covered.unionByName(total, allowMissingColumns=True).groupBy("shuffle_id", "name")
    named = named.agg(F.try_divide(F.coalesce(F.sum("covered"), F.lit(0)), F.sum("length")).alias("ratio"))
    counts = named.groupBy("shuffle_id").agg(F.count(F.when(F.col("ratio") > ratio, 1)).alias("count"))
    seen = counts.where("shuffle_id = -1").select(F.col("count").alias("observed"))
    return counts.where("shuffle_id <> -1").join(F.broadcast(seen)).groupBy("observed").agg(
        F.count("*").alias("shuffles"), ((1 + F.count(F.when(F.col("count") >= F.col("observed"), 1))) / (1 + F.count("*"))).alias("p")
    )


def best_metrics(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """The largest value of two metrics in each group; nulls do not count."""
    return df.groupBy(*by).agg(F.max(a).alias(a), F.max(b).alias(b))


def mean_and_members(df: DataFrame, by: list[str], value: str, listed: str, sep: str = ",") -> DataFrame:
    """For each group the mean of ``value`` and the distinct members, in order, of the lists (text) in ``listed``."""
    every = F.flatten(F.collect_list(F.split(listed, sep)))
    members = F.array_join(F.array_sort(F.filter(F.array_distinct(every), lambda x: x != "")), sep)
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), members.alias("members"))


def most_common(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The commonest value of each group and how often it occurs (ties: the smallest value); nulls do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value), F.max("n").alias("n"))


def passing_groups(df: DataFrame, by: list[str], part: str, whole: str, ratio: float) -> DataFrame:
    """One row, groups: how many groups have sum(part) / sum(whole) above ``ratio``."""
    each = df.groupBy(*by).agg(F.try_divide(F.sum(part), F.sum(whole)).alias("r"))
    return each.agg(F.count(F.when(F.col("r") > ratio, 1)).alias("groups"))


def sample_support(df: DataFrame, node: str = "node", sample: str = "sample") -> DataFrame:
    """node, support: in how many different samples it occurs."""
    return df.groupBy(node).agg(F.countDistinct(sample).alias("support"))


def dense_ids(df: DataFrame, *cols: str) -> DataFrame:
    """Adds ``id``: the rank of the row's values of ``cols`` among the distinct ones, from 1."""
    from spanweave.operators.tables import number_rows

    ids = number_rows(df.select(*cols).distinct(), *cols, name="id").withColumnsRenamed({c: f"_v{k}" for k, c in enumerate(cols)})
    on = [F.col(c).eqNullSafe(F.col(f"_v{k}")) for k, c in enumerate(cols)]
    return df.join(ids, reduce(lambda a, b: a & b, on)).drop(*[f"_v{k}" for k in range(len(cols))])


def continuity(df: DataFrame, least: int = 500_000, most_span: int = 1_500_000) -> DataFrame:
    """sample, covered, contigs, span, good for places (sample, chrom, start, end): good if more than ``least`` positions are covered, on one contig, within
    ``most_span``."""
    width = union_width(df, ["sample", "chrom"]).groupBy("sample").agg(F.sum("width").alias("covered"))
    hull = df.groupBy("sample").agg(F.countDistinct("chrom").alias("contigs"), (F.max("end") - F.min("start")).alias("span"))
    good = (F.col("covered") > least) & (F.col("contigs") == 1) & (F.col("span") <= most_span)
    return width.join(hull, "sample").select("sample", "covered", "contigs", "span", good.alias("good"))
