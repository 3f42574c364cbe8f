"""Paths through a sequence graph: steps (path, ord, orient, node), their sequences, alleles, matches and projections.

Orientation is ``>`` or ``+`` for the forward strand, ``<`` or ``-`` for the other. Path strings are steps such as ``>12<13``.

Defined cases: steps with a null path or node are left out unless an operator says otherwise; a node without a sequence counts as ``N`` * 21 where
it is the missing node and as empty elsewhere; repeated steps count each; empty tables give none; clashing other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.sequences import revcomp
from spanweave.operators.ranking import rank_lists
from spanweave.operators.running import TASK_ROWS

# fixed values: the node that stands for a missing allele, and the sequence of what is unknown
MISSING_NODE = "00000"
UNKNOWN = "N" * 21


def oriented_sequences(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, seq: the sequences of a path's steps (path, ord, orient, node) in order, reverse complements on the other strand. nodes: node, seq."""
    known = nodes.select("node", F.col("seq").alias("_seq"))
    rows = steps.select("path", "ord", "orient", "node").where("path is not null").join(known, "node", "left")
    seq = F.when(F.col("node") == MISSING_NODE, UNKNOWN).otherwise(F.coalesce("_seq", F.lit("")))
    turned = F.when(F.col("orient").isin("<", "-"), revcomp(seq)).otherwise(seq)
    listed = F.array_sort(F.collect_list(F.struct("ord", turned.alias("s"))))
    return rows.groupBy("path").agg(F.array_join(F.transform(listed, lambda x: x["s"]), "").alias("seq"))


def substitute_alleles(path: Column, changes: Column) -> Column:
    """A path string with each old traversal replaced by its new one, in the order of ``changes`` (array<struct<old, new>>). Steps are compared
    whole, so ``>1`` is no part of ``>12``."""
    marked = lambda t: F.regexp_replace(t, r"([<>][^<>]+)", "$1;")
    done = F.aggregate(changes, marked(path), lambda text, c: F.when(F.length(c["old"]) > 0, F.replace(text, marked(c["old"]), marked(c["new"]))).otherwise(text))
    return F.replace(done, F.lit(";"), F.lit(""))


def chained_traversals(rows: DataFrame) -> DataFrame:
    """group, ord, chain: traversals (group, ord, traversal; ord unique in a group) put together where one's last step is another's first, until no two go together.

    Of the traversals of a group that end with a step and those that begin with it, in their order, the first goes on in the first, the second in the second, and so
    on (one that ends as it begins does not go on in itself; a ring begins at its first traversal). A chain has the ord of the traversal it begins with. Empty
    traversals are left out."""
    steps = F.regexp_extract_all(F.col("traversal"), F.lit(r"[<>][^<>]+"), F.lit(0))
    own = rows.select("group", "ord", steps.alias("steps")).where((F.size("steps") > 0) & F.col("ord").isNotNull()).withColumn("id", F.struct("group", "ord"))
    own = own.withColumn("first", F.element_at("steps", 1)).withColumn("last", F.element_at("steps", -1))
    nth = lambda c: F.row_number().over(Window.partitionBy("group", c).orderBy("ord"))
    ends = own.select("group", F.col("last").alias("step"), nth("last").alias("n"), F.col("id").alias("prev"))
    begins = own.select("group", F.col("first").alias("step"), nth("first").alias("n"), "id")
    links = begins.join(ends, ["group", "step", "n"]).where("id <> prev").select("id", "prev")
    longest = own.groupBy("group").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    ranked = rank_lists(own.select("id").join(links, "id", "left"), longest).join(own.select("id", "steps"), "id")
    parts = F.array_sort(F.collect_list(F.struct("place", F.when(F.col("place") > 0, F.slice("steps", 2, F.size("steps"))).otherwise(F.col("steps")).alias("s"))))
    joined = F.array_join(F.flatten(F.transform(parts, lambda x: x["s"])), "")
    return ranked.groupBy("head").agg(joined.alias("chain")).select("head.group", "head.ord", "chain")


def _null_safe(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def haplotype_paths(genotypes: DataFrame, alleles: DataFrame, reference: Column, missing: str = ".", most_missing: float = 0.5) -> DataFrame:
    """group, status, path. genotypes: group, variant, gt (text); alleles: variant, allele (int; 0 is the reference's), traversal.

    A group with more than ``most_missing`` of its genotypes missing is ``unknown`` (path null); with all 0 it has the reference's path. Else the
    reference's traversals are replaced by the alleles' in the order of the variants, and then those of missing genotypes, chained where they
    go on in each other, by the missing node."""
    rows = genotypes.select("group", "variant", "gt")
    old = alleles.where("allele = 0").select("variant", F.col("traversal").alias("old"))
    new = alleles.select("variant", F.col("allele").cast("string").alias("gt"), F.col("traversal").alias("new"))
    both = rows.join(old, "variant", "left").join(new, ["variant", "gt"], "left")
    gone = F.col("gt") == missing
    change = F.struct("variant", "old", "new")
    found = both.groupBy("group").agg(
        F.avg(F.when(gone, 1.0).otherwise(0.0)).alias("share"),
        F.array_sort(F.collect_list(F.when(~gone & (F.col("gt") != "0") & F.col("new").isNotNull(), change))).alias("changes"),
    )
    chains = chained_traversals(both.where(gone).select(F.struct("group").alias("group"), F.col("variant").alias("ord"), F.col("old").alias("traversal")))
    lost = chains.groupBy(F.col("group.group").alias("group")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chain"))), lambda c: c["chain"]).alias("_lost"))
    changes = F.concat(
        F.transform("changes", lambda c: F.struct(c["old"].alias("old"), c["new"].alias("new"))),
        F.transform("_lost", lambda t: F.struct(t.alias("old"), F.lit(">" + MISSING_NODE).alias("new"))),
    )
    unknown = F.col("share") > most_missing
    text = F.array().cast("array<string>")
    out = _null_safe(found, lost, "group").withColumn("_lost", F.coalesce("_lost", text))
    return out.select("group", F.when(unknown, "unknown").otherwise("known").alias("status"), F.when(~unknown, substitute_alleles(reference, changes)).alias("path"))


def unmatched_paths(paths: DataFrame, reference: DataFrame) -> DataFrame:
    """path of those that share no node with a reference path. Both: path, node."""
    known = reference.select("node").distinct()
    hit = paths.join(known, "node", "left_semi").select("path").distinct()
    return paths.select("path").distinct().join(hit, "path", "left_anti")


def disjoint_paths(paths: DataFrame, nodes: DataFrame, disjoint: bool = True) -> DataFrame:
    """Rows of paths (path, node, ...) whose path has no node in common with ``nodes`` (node), or, if not ``disjoint``, has one."""
    hit = paths.join(nodes.select("node").distinct(), "node", "left_semi").select("path").distinct()
    return paths.join(hit, "path", "left_anti" if disjoint else "left_semi")


def consumed_matches(paths: DataFrame, reference: DataFrame) -> DataFrame:
    """ref_path, path: reference paths in order (path, rank) each take the paths that share a node with them and that none before took."""
    # of a node's reference paths only the first can take a path, so no list of paths meets another
    first = reference.groupBy("node").agg(F.min(F.struct("rank", F.col("path").alias("ref_path"))).alias("_r"))
    both = paths.select("path", "node").distinct().join(first, "node")
    return both.groupBy("path").agg(F.min("_r").alias("_r")).select("_r.ref_path", "path")


def drop_repeated_paths(paths: DataFrame) -> DataFrame:
    """path, kept: of the paths with the same first node and the same length (path, first_node, len) the smallest stays for all."""
    over = Window.partitionBy("first_node", "len")
    return paths.select("path", F.min("path").over(over).alias("kept"))


def anchored_paths(steps: DataFrame, k: int = 20, edge: int = 10) -> DataFrame:
    """region, path, a, b: the anchor pair of each region, and the paths that have its two nodes on opposite ends (among the first ``edge`` steps
    the one, among the last the other)."""
    from spanweave.operators.blocks import anchor_pair

    pair = anchor_pair(steps, k, edge).select("region", "a", "b")
    n = F.max("ord").over(Window.partitionBy("region", "path"))
    low = F.min("ord").over(Window.partitionBy("region", "path"))
    ends = steps.select("region", "path", "ord", "node").withColumn("_n", n).withColumn("_l", low)
    first, last = F.col("ord") < F.col("_l") + edge, F.col("ord") > F.col("_n") - edge
    marked = ends.join(pair, "region").groupBy("region", "path", "a", "b").agg(
        F.max((first & (F.col("node") == F.col("a"))).cast("int")).alias("af"), F.max((last & (F.col("node") == F.col("b"))).cast("int")).alias("bl"),
        F.max((first & (F.col("node") == F.col("b"))).cast("int")).alias("bf"), F.max((last & (F.col("node") == F.col("a"))).cast("int")).alias("al"),
    )
    return marked.where("(af = 1 and bl = 1) or (bf = 1 and al = 1)").select("region", "path", "a", "b")


def project_regions(regions: DataFrame, steps: DataFrame, placed: DataFrame, least_ratio: float = 0.5, density: bool = False) -> DataFrame:
    """Regions on reference paths carried over to sample paths.

    regions: region, path, start, end (1-based on the path, end included). steps: path, ord, orient, node, pos_s, pos_e (likewise, of the
    reference paths). placed: sample, chrom, node, start, end, orient (0-based and half-open places of the nodes on sample paths).

    Each step inside a region gives, for each place of its node in a sample, the part of that place which the region covers, counted from the
    other end if the strands differ. A row for the hull of a sample's places on one chromosome if its ratio (the smaller over the larger of its and the
    region's length) is over ``least_ratio``. Else the places are clustered, and each cluster whose own ratio is over it gives a row; if there is none, the hull does. Clusters are runs
    whose gaps are at most half the region's length, or, if ``density``, those of ``density_clusters`` over the merged places (at
    least two, by the distance of their starts and ends, epsilon half the region's length). region, sample, chrom, start, end, ratio, share (the part of the
    region that lies on nodes the sample has)."""
    from spanweave.operators.intervals import overlap_join

    spots = regions.select(F.col("path").alias("chrom"), (F.col("start") - 1).alias("start"), F.col("end"), "region")
    line = steps.select(F.col("path").alias("chrom"), (F.col("pos_s") - 1).alias("start"), F.col("pos_e").alias("end"), "ord", "orient", "node")
    inside = overlap_join(line, spots).select(
        F.col("region_b").alias("region"), F.col("orient_a").alias("orient"), F.col("node_a").alias("node"), F.col("ord_a").alias("ord"),
        (F.greatest("start_a", "start_b") - F.col("start_a")).alias("from"), (F.least("end_a", "end_b") - F.col("start_a")).alias("to"),
        (F.col("end_a") - F.col("start_a")).alias("len"), (F.col("end_b") - F.col("start_b")).alias("size"),
    )
    places = placed.select("sample", "chrom", "node", F.col("start").alias("at"), F.col("orient").alias("turn"))
    same = F.col("orient") == F.col("turn")
    hit = inside.join(places, "node").select(
        "region", "sample", "chrom", "size", "ord", "from", "to",
        F.when(same, F.col("at") + F.col("from")).otherwise(F.col("at") + F.col("len") - F.col("to")).alias("start"),
        F.when(same, F.col("at") + F.col("to")).otherwise(F.col("at") + F.col("len") - F.col("from")).alias("end"),
    )
    if not density:
        return _projected(hit, _number_of_hits(inside, places), least_ratio)
    share = hit.select("region", "sample", "size", "ord", (F.col("to") - F.col("from")).alias("w")).distinct()
    share = share.groupBy("region", "sample").agg((F.sum("w") / F.max("size")).alias("share"))
    # a region's places in a sample are as many as its steps: one group of the window is a region, not a chromosome
    keys = ["region", "sample", "chrom"]
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    runs = hit.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    runs = runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("size").alias("size"))
    runs = _density_runs(runs, keys)
    width = F.col("end") - F.col("start")
    ratio = F.least(width, F.col("size")) / F.greatest(width, F.col("size"))
    runs = runs.select(*keys, "start", "end", "size", ratio.alias("ratio"))
    hull = hit.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("size").alias("size")).withColumn("ratio", ratio)
    near = hull.where(F.col("ratio") > least_ratio)
    split = runs.where(F.col("ratio") > least_ratio).join(near.select(*keys), keys, "left_anti")
    whole = hull.join(split.select(*keys).distinct(), keys, "left_anti")
    return whole.unionByName(split).join(share, ["region", "sample"]).select("region", "sample", "chrom", "start", "end", "ratio", "share")


def _number_of_hits(inside: DataFrame, places: DataFrame) -> int:
    """Rows that the steps of regions and the places of samples have by their nodes; counted by node, without the rows."""
    both = inside.groupBy("node").agg(F.count("*").alias("n")).join(places.groupBy("node").agg(F.count("*").alias("m")), "node")
    return both.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def _projected(hit: DataFrame, rows: int, least_ratio: float) -> DataFrame:
    """``project_regions`` of the hits with runs as clusters. They are dealt once, by region and sample, to tasks of about ``TASK_ROWS``; all that follows stays there."""
    tasks = max(int(hit.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    pair, keys = ["region", "sample"], ["region", "sample", "chrom"]
    hit = hit.where("region is not null and sample is not null").select(*keys, "size", "ord", "start", (F.col("end") - F.col("start")).alias("w")).repartition(tasks, *pair)
    # a step counts once for the share, however many places it has; the part of it that lies in the region is as long as each
    again = Window.partitionBy(*pair, "size", "ord", "w").orderBy("start")
    hit = hit.withColumn("_own", F.when(F.row_number().over(again) == 1, F.col("w"))).withColumn("end", F.col("start") + F.col("w"))
    # a region's places in a sample are as many as its steps: one group of the window is a region, not a chromosome
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") - reach > F.col("size") / 2), 1).otherwise(0)
    runs = hit.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    runs = runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("size").alias("size"), F.sum("_own").alias("_own"))
    ratio = lambda a, b: F.least(b - a, F.col("size")) / F.greatest(b - a, F.col("size"))
    whole, every = Window.partitionBy(*keys), Window.partitionBy(*pair)
    low, high = F.min("start").over(whole), F.max("end").over(whole)
    runs = runs.withColumns({"_low": low, "_high": high, "size": F.max("size").over(whole), "_share": F.sum("_own").over(every) / F.max("size").over(every)})
    runs = runs.withColumns({"ratio": ratio(F.col("start"), F.col("end")), "_whole": ratio(F.col("_low"), F.col("_high"))})
    good = (F.col("ratio") > least_ratio) & (F.col("_whole") <= least_ratio)
    runs = runs.withColumn("_good", good).withColumn("_any", F.max(good).over(whole))
    shown = runs.where("_good or (not _any and _run = 1)")
    side = lambda own, hull: F.when(F.col("_good"), F.col(own)).otherwise(F.col(hull))
    return shown.select(*keys, side("start", "_low").alias("start"), side("end", "_high").alias("end"), side("ratio", "_whole").alias("ratio"), F.col("_share").alias("share"))


def _density_runs(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Hulls of the density clusters of merged places (keys, _run, start, end, size). Merged places follow each other with both their ends, so the lightest
    spanning tree of a group links each one to the next: no pairs are needed to find it, and with one sample a core distance is no more than a link."""
    from spanweave.operators.density import density_clusters
    from spanweave.operators.tables import number_rows

    rows = number_rows(merged.withColumn("_key", F.struct(*keys)), "_key", "start", name="id").drop("_key")
    over = Window.partitionBy(*keys).orderBy("start")
    after = lambda c: F.lead(c).over(over)
    far = F.sqrt(F.pow((after("start") - F.col("start")).cast("double"), 2) + F.pow((after("end") - F.col("end")).cast("double"), 2))
    links = rows.select(F.col("id").alias("a"), after("id").alias("b"), far.alias("w"), (F.col("size") / 2).alias("epsilon")).where("b is not null")
    found = rows.join(density_clusters(rows, links), "id").where("cluster is not null")
    return found.groupBy(*keys, "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("size").alias("size"))


def unit_steps(steps: DataFrame, unit: int = 10) -> DataFrame:
    """Steps longer than ``unit`` letters as so many whole units of it; others stay as they are. Adds part (from 0)."""
    n = F.when(F.col("len") > unit, F.floor(F.col("len") / unit)).otherwise(1)
    return steps.select("*", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("part"))

