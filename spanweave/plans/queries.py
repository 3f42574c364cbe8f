"""Registered queries over the driver's tables and their oracle SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions import kmers, textpairs
from spanweave.functions import sequences as seq
from spanweave.operators import blocks, chunked, clustering, intervals, model, ordered, pairs, paths, setjoin, stats, tables
from spanweave.operators.components import connected_components
from spanweave.plans import regions
from spanweave.plans import views as v
from spanweave.scratch import Scratch
from spanweave.sources import fasta

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def _shown(df, *more):
    return df.select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), *more)


# --- interval algebra -------------------------------------------------------------------------


@query(
    "enrich_observed",
    f"""WITH {v.IV}, {v.TGT}, {v.merged_sql("iv", "m")},
c AS (SELECT t.name, t.s, t.e, t.chrom, coalesce(sum(CASE WHEN m.s IS NULL THEN 0 ELSE least(t.e, m.e) - greatest(t.s, m.s) END), 0) AS cov
      FROM (SELECT *, row_number() OVER () AS id FROM tgt) t LEFT JOIN m ON t.chrom = m.chrom AND t.s < m.e AND m.s < t.e GROUP BY t.id, t.name, t.s, t.e, t.chrom)
SELECT name, CAST(sum(cov) AS BIGINT) AS covered, CAST(sum(e - s) AS BIGINT) AS total, round(sum(cov) / sum(e - s), 6) AS ratio, sum(cov) / sum(e - s) > 0.64 AS over_ratio
FROM c GROUP BY name""",
)
def enrich_observed(spark, d):
    done = intervals.coverage(v.targets(spark, d), v.intervals(spark, d))
    ratio = F.sum("covered") / F.sum("length")
    return done.groupBy("name").agg(F.sum("covered").alias("covered"), F.sum("length").alias("total"), F.round(ratio, 6).alias("ratio"), (ratio > 0.64).alias("over_ratio"))


@query(
    "make_windows",
    f"WITH {v.IV}, {v.merged_sql('iv', 'm', 2)}, w AS (SELECT chrom, e, unnest(generate_series(s, e - 1, 20)) AS s0 FROM m) SELECT chrom, s0 AS s, least(s0 + 40, e) AS e FROM w",
)
def make_windows(spark, d):
    return _shown(intervals.make_windows(intervals.merge_intervals(v.intervals(spark, d), max_gap=2).drop("n"), 40, 20))


_JOIN = "FROM tgt a JOIN iv b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e"


@query("iv_overlap", f"WITH {v.IV}, {v.TGT} SELECT a.chrom, a.s AS a_s, a.e AS a_e, a.name AS a_name, b.s AS b_s, b.e AS b_e, b.name AS b_name {_JOIN}")
def iv_overlap(spark, d):
    j = intervals.overlap_join(v.targets(spark, d), v.intervals(spark, d))
    return j.select("chrom", F.col("start_a").alias("a_s"), F.col("end_a").alias("a_e"), F.col("name_a").alias("a_name"), F.col("start_b").alias("b_s"), F.col("end_b").alias("b_e"), F.col("name_b").alias("b_name"))


@query("iv_overlap_clip", f"WITH {v.IV}, {v.TGT} SELECT a.chrom, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e {_JOIN}")
def iv_overlap_clip(spark, d):
    j = intervals.overlap_join(v.targets(spark, d), v.intervals(spark, d))
    return j.select("chrom", F.greatest("start_a", "start_b").alias("s"), F.least("end_a", "end_b").alias("e"))


@query("iv_contain", f"WITH {v.IV}, {v.TGT} SELECT a.chrom, a.s, a.e, b.s AS b_s, b.e AS b_e {_JOIN} AND b.s <= a.s AND a.e <= b.e")
def iv_contain(spark, d):
    j = intervals.overlap_join(v.targets(spark, d), v.intervals(spark, d), min_frac_a=1.0)
    return j.select("chrom", F.col("start_a").alias("s"), F.col("end_a").alias("e"), F.col("start_b").alias("b_s"), F.col("end_b").alias("b_e"))


_SELF = "FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e AND (least(a.e, b.e) - greatest(a.s, b.s)) >= 0.8 * (a.e - a.s) AND (least(a.e, b.e) - greatest(a.s, b.s)) >= 0.8 * (b.e - b.s)"


@query("iv_reciprocal", f"WITH {v.IV} SELECT a.chrom, a.s, a.e, CAST(count(*) AS BIGINT) AS partners {_SELF} GROUP BY a.chrom, a.s, a.e")
def iv_reciprocal(spark, d):
    iv = v.intervals(spark, d)
    j = intervals.overlap_join(iv, iv, min_frac_a=0.8, reciprocal=True)
    return j.groupBy("chrom", F.col("start_a").alias("s"), F.col("end_a").alias("e")).agg(F.count("*").alias("partners"))


@query("iv_closed", f"WITH {v.IV}, {v.TGT} SELECT a.chrom, a.s, CAST(count(*) AS BIGINT) AS n FROM tgt a JOIN iv b ON a.chrom = b.chrom AND a.s <= b.e AND b.s <= a.e GROUP BY a.chrom, a.s")
def iv_closed(spark, d):
    j = intervals.overlap_join(v.targets(spark, d), v.intervals(spark, d), closed=True)
    return j.groupBy("chrom", F.col("start_a").alias("s")).agg(F.count("*").alias("n"))


@query("iv_semi", f"WITH {v.IV}, {v.TGT} SELECT chrom, s, e, name FROM tgt a WHERE EXISTS (SELECT 1 FROM iv b WHERE a.chrom = b.chrom AND a.s < b.e AND b.s < a.e)")
def iv_semi(spark, d):
    return _shown(intervals.overlap_join(v.targets(spark, d), v.intervals(spark, d), "semi"), "name")


@query("iv_anti", f"WITH {v.IV}, {v.TGT} SELECT chrom, s, e, name FROM tgt a WHERE NOT EXISTS (SELECT 1 FROM iv b WHERE a.chrom = b.chrom AND a.s < b.e AND b.s < a.e)")
def iv_anti(spark, d):
    return _shown(intervals.subtract(v.targets(spark, d), v.intervals(spark, d), whole=True), "name")


@query("iv_left", f"WITH {v.IV}, {v.TGT} SELECT a.chrom, a.s, a.name, b.s AS b_s FROM tgt a LEFT JOIN iv b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e")
def iv_left(spark, d):
    j = intervals.overlap_join(v.targets(spark, d), v.intervals(spark, d), "left")
    return j.select("chrom", F.col("start_a").alias("s"), F.col("name_a").alias("name"), F.col("start_b").alias("b_s"))


@query(
    "iv_subtract",
    f"""WITH {v.IV}, {v.TGT}, {v.merged_sql("iv", "m")}, t AS (SELECT *, row_number() OVER () AS id FROM tgt),
c AS (SELECT id, m.s, m.e FROM t JOIN m ON t.chrom = m.chrom AND t.s < m.e AND m.s < t.e),
b AS (SELECT id, s AS p FROM t UNION ALL SELECT id, e FROM c), x AS (SELECT id, e AS p FROM t UNION ALL SELECT id, s FROM c),
f AS (SELECT b.id, b.p AS s, (SELECT min(x.p) FROM x WHERE x.id = b.id AND x.p > b.p) AS e FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = b.id AND c.s <= b.p AND b.p < c.e))
SELECT t.chrom, f.s, f.e, t.name FROM f JOIN t USING (id) WHERE f.s < f.e AND f.s < t.e""",
)
def iv_subtract(spark, d):
    return _shown(intervals.subtract(v.targets(spark, d), v.intervals(spark, d)), "name")


@query("iv_merge", f"WITH {v.IV}, {v.merged_sql('iv', 'm')} SELECT chrom, s, e, CAST(n AS BIGINT) AS n FROM m")
def iv_merge(spark, d):
    return _shown(intervals.merge_intervals(v.intervals(spark, d)), "n")


@query("iv_merge_gap", f"WITH {v.IV}, {v.merged_sql('iv', 'm', 3)} SELECT chrom, s, e, CAST(n AS BIGINT) AS n FROM m")
def iv_merge_gap(spark, d):
    return _shown(intervals.merge_intervals(v.intervals(spark, d), max_gap=3), "n")


@query("iv_merge_collapse", f"WITH {v.IV}, {v.merged_sql('iv', 'm')} SELECT chrom, min(s) AS s, max(e) AS e, string_agg(name, ',' ORDER BY name) AS items FROM m_g GROUP BY chrom, isl")
def iv_merge_collapse(spark, d):
    return _shown(intervals.merge_intervals(v.intervals(spark, d), collect="name"), F.array_join("items", ",").alias("items"))


@query(
    "iv_coverage",
    f"""WITH {v.IV}, {v.TGT}, {v.merged_sql("iv", "m")}, t AS (SELECT *, row_number() OVER () AS id FROM tgt),
r AS (SELECT id, count(*) AS n FROM t JOIN iv b ON t.chrom = b.chrom AND t.s < b.e AND b.s < t.e GROUP BY id),
c AS (SELECT id, sum(least(t.e, m.e) - greatest(t.s, m.s)) AS covered FROM t JOIN m ON t.chrom = m.chrom AND t.s < m.e AND m.s < t.e GROUP BY id)
SELECT chrom, s, e, name, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(covered, 0) AS BIGINT) AS covered, round(coalesce(covered, 0) / (e - s), 6) AS fraction
FROM t LEFT JOIN r USING (id) LEFT JOIN c USING (id)""",
)
def iv_coverage(spark, d):
    return _shown(intervals.coverage(v.targets(spark, d), v.intervals(spark, d)), "name", "n", "covered", F.round("fraction", 6).alias("fraction"))


@query("iv_union_width", f"WITH {v.IV}, c AS (SELECT chrom, s, e + 1 AS e FROM iv), {v.merged_sql('c', 'm')} SELECT chrom, CAST(sum(e - s) AS BIGINT) AS width FROM m GROUP BY chrom")
def iv_union_width(spark, d):
    return intervals.union_width(v.intervals(spark, d), closed=True)


@query("group_hull", f"WITH {v.IV} SELECT chrom, name, min(s) AS s, max(e) AS e FROM iv GROUP BY chrom, name")
def group_hull(spark, d):
    h = intervals.group_hull(v.intervals(spark, d), ["chrom", "name"])
    return h.select("chrom", "name", F.col("start").alias("s"), F.col("end").alias("e"))


@query(
    "expand_overhang",
    f"""WITH {v.IV}, {v.TGT}, h AS (SELECT a.chrom, a.s, a.e, min(b.s) AS bs, max(b.e) AS be FROM (SELECT DISTINCT chrom, s, e FROM tgt) a JOIN iv b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e GROUP BY a.chrom, a.s, a.e)
SELECT t.chrom, least(t.s, coalesce(bs, t.s)) AS s, greatest(t.e, coalesce(be, t.e)) AS e, name FROM tgt t LEFT JOIN h ON t.chrom = h.chrom AND t.s = h.s AND t.e = h.e""",
)
def expand_overhang(spark, d):
    return _shown(intervals.expand_by_overhang(v.targets(spark, d), v.intervals(spark, d)), "name")


@query("clamp", f"WITH {v.IV}, l AS (SELECT chrom, max(e) - 20 AS n FROM iv GROUP BY chrom) SELECT chrom, greatest(s, 1) AS s, least(e, n) AS e, name FROM iv JOIN l USING (chrom)")
def clamp(spark, d):
    iv = v.intervals(spark, d)
    return _shown(intervals.clamp(iv, iv.groupBy("chrom").agg((F.max("end") - 20).alias("length"))), "name")


@query(
    "redistribute",
    f"""WITH {v.IV}, {v.merged_sql("iv", "m", 2)}, w AS (SELECT chrom, e AS me, unnest(generate_series(s, e - 1, 20)) AS s0 FROM m),
b AS (SELECT DISTINCT chrom, s0 AS s, least(s0 + 20, me) AS e FROM w),
j AS (SELECT b.chrom, b.s, b.e, m.n / count(*) OVER (PARTITION BY m.chrom, m.s, m.e) AS value FROM b JOIN m ON b.chrom = m.chrom AND m.s <= b.s AND b.e <= m.e)
SELECT chrom, s, e, round(value, 6) AS value FROM j""",
)
def redistribute(spark, d):
    merged = Scratch(spark, "merged").save(intervals.merge_intervals(v.intervals(spark, d), max_gap=2).withColumnRenamed("n", "value"), "merged")
    base = intervals.make_windows(merged.drop("value"), 20, 20).distinct()
    return _shown(intervals.redistribute(base, merged, "value"), F.round("value", 6).alias("value"))


@query(
    "grow_to_fixpoint",
    f"""WITH {v.IV}, {v.TGT}, b AS (SELECT chrom, s, e, 1 AS w FROM tgt UNION ALL SELECT chrom, s, e, 0 FROM iv),
p AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM p)
SELECT chrom, min(s) AS s, max(e) AS e FROM g GROUP BY chrom, i HAVING max(w) = 1""",
)
def grow_to_fixpoint(spark, d):
    return _shown(intervals.grow_to_fixpoint(v.targets(spark, d), v.intervals(spark, d)))


@query(
    "region_strings",
    f"WITH {v.IV} SELECT DISTINCT concat(chrom, ':', s, '-', e) AS region, regexp_extract(concat(chrom, ':', s, '-', e), '^(.*):(\\d+)-(\\d+)$', 1) AS chrom, CAST(regexp_extract(concat(chrom, ':', s, '-', e), '^(.*):(\\d+)-(\\d+)$', 2) AS BIGINT) AS s FROM iv",
)
def region_strings(spark, d):
    rows = v.intervals(spark, d).select(seq.format_region(F.col("chrom"), F.col("start"), F.col("end")).alias("region")).distinct()
    return rows.withColumn("p", seq.parse_region(F.col("region"))).select("region", F.col("p.chrom").alias("chrom"), F.col("p.start").alias("s"))


# --- pairs ------------------------------------------------------------------------------------

_CANON = "CASE WHEN (chrom1, start1, end1) <= (chrom2, start2, end2) THEN {0}1 ELSE {0}2 END AS {0}1, CASE WHEN (chrom1, start1, end1) <= (chrom2, start2, end2) THEN {0}2 ELSE {0}1 END AS {0}2"


@query("pair_canonical", f"WITH {v.PAIRS} SELECT DISTINCT {', '.join(_CANON.format(c) for c in ('chrom', 'start', 'end'))} FROM pr")
def pair_canonical(spark, d):
    return pairs.distinct_unordered(v.pairs(spark, d))


@query("pair_sorted_fields", f"WITH {v.PAIRS} SELECT DISTINCT array_to_string(list_sort([chrom1, CAST(start1 AS VARCHAR), CAST(end1 AS VARCHAR), chrom2, CAST(start2 AS VARCHAR), CAST(end2 AS VARCHAR)]), '|') AS fields FROM pr")
def pair_sorted_fields(spark, d):
    return pairs.distinct_sorted_fields(v.pairs(spark, d))


@query("pair_unpivot", f"WITH {v.PAIRS} SELECT chrom1 AS chrom, start1 AS s, end1 AS e FROM pr UNION ALL SELECT chrom2, start2, end2 FROM pr")
def pair_unpivot(spark, d):
    return _shown(pairs.unpivot_sides(v.pairs(spark, d)))


_TOUCH = "(chrom1 = chrom2 AND start1 <= end2 AND start2 <= end1)"


@query("pair_no_self_overlap", f"WITH {v.PAIRS} SELECT pair FROM pr WHERE NOT {_TOUCH}")
def pair_no_self_overlap(spark, d):
    return pairs.drop_self_overlaps(v.pairs(spark, d)).select("pair")


@query("pair_threshold", f"WITH {v.PAIRS} SELECT pair FROM pr WHERE CASE WHEN {_TOUCH} THEN score > 0.6 ELSE score >= 0.1 END")
def pair_threshold(spark, d):
    return pairs.overlap_dependent_threshold(v.pairs(spark, d), "score").select("pair")


_BOTH = "p.chrom1 = q.chrom{0} AND p.start1 < q.end{0} AND q.start{0} < p.end1 AND p.chrom2 = q.chrom{1} AND p.start2 < q.end{1} AND q.start{1} < p.end2"


@query(
    "pair_both_overlap",
    f"WITH {v.PAIRS}, j AS (SELECT p.pair AS a, q.pair AS b FROM pr p JOIN pr q ON {_BOTH.format(1, 2)} UNION SELECT p.pair, q.pair FROM pr p JOIN pr q ON {_BOTH.format(2, 1)}) SELECT a AS pair_p, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY a",
)
def pair_both_overlap(spark, d):
    p = v.pairs(spark, d)
    return pairs.pair_overlap(p, p).groupBy("pair_p").agg(F.count("*").alias("n"))


_RECIP = "(least(p.end{0}, q.end{1}) - greatest(p.start{0}, q.start{1})) >= 0.8 * greatest(p.end{0} - p.start{0}, q.end{1} - q.start{1})"


@query(
    "pair_known_anti",
    f"""WITH {v.PAIRS}, k AS (SELECT * FROM pr WHERE score >= 0.5), n AS (SELECT * FROM pr WHERE score < 0.5),
j AS (SELECT p.pair FROM n p JOIN k q ON {_BOTH.format(1, 2)} AND {_RECIP.format(1, 1)} AND {_RECIP.format(2, 2)} UNION SELECT p.pair FROM n p JOIN k q ON {_BOTH.format(2, 1)} AND {_RECIP.format(1, 2)} AND {_RECIP.format(2, 1)})
SELECT pair FROM n WHERE pair NOT IN (SELECT pair FROM j)""",
)
def pair_known_anti(spark, d):
    p = v.pairs(spark, d)
    return pairs.drop_known(p.where("score < 0.5"), p.where("score >= 0.5")).select("pair")


@query(
    "pair_contained",
    f"WITH {v.PAIRS} SELECT q.pair AS outer_pair, p.pair AS inner_pair FROM pr p JOIN pr q ON p.chrom1 = q.chrom1 AND p.chrom2 = q.chrom2 AND q.start1 <= p.start1 AND p.end1 <= q.end1 AND q.start2 <= p.start2 AND p.end2 <= q.end2 AND p.pair <> q.pair",
)
def pair_contained(spark, d):
    return pairs.contained_pairs(v.pairs(spark, d)).select(F.col("outer").alias("outer_pair"), F.col("inner").alias("inner_pair"))


@query("ambiguous_nulling", "SELECT l_partkey AS k, CASE WHEN count(*) = 1 THEN min(l_orderkey) END AS v FROM lineitem GROUP BY l_partkey")
def ambiguous_nulling(spark, d):
    rows = v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("v"))
    return pairs.null_ambiguous(rows, ["k"], ["v"])


@query("last_per_key", "SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_per_key(spark, d):
    rows = v.table(spark, d, "events").select("user_id", "event_id", "event_type")
    return pairs.last_per_key(rows, ["user_id"], "event_id").select("user_id", "event_type")


@query("set_ops", "SELECT k, CAST(sum(u) AS BIGINT) AS times, max(o) AS in_orders, max(p) AS in_parts FROM (SELECT l_partkey AS k, 1 AS u, 0 AS o, 1 AS p FROM lineitem UNION ALL SELECT o_custkey, 1, 1, 0 FROM orders) GROUP BY k")
def set_ops(spark, d):
    a = v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.lit(1).alias("u"), F.lit(0).alias("o"), F.lit(1).alias("p"))
    b = v.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("u"), F.lit(1).alias("o"), F.lit(0).alias("p"))
    return a.unionByName(b).groupBy("k").agg(F.sum("u").alias("times"), F.max("o").alias("in_orders"), F.max("p").alias("in_parts"))


# --- statistics -------------------------------------------------------------------------------


@query(
    "entropy_norm",
    """WITH c AS (SELECT l_partkey AS variant, l_returnflag AS g, count(*) AS c FROM lineitem GROUP BY 1, 2), s AS (SELECT variant, sum(c) AS n, sum(c * log2(c)) AS s, count(*) AS k FROM c GROUP BY 1)
SELECT variant, round(CASE WHEN k < 2 OR round(log2(n) - s / n, 5) = 0 THEN 0 ELSE round(log2(n) - s / n, 5) / round(log2(k), 5) END, 5) AS entropy FROM s""",
)
def entropy_norm(spark, d):
    return stats.normalized_entropy(v.genotypes(spark, d), ["variant"], "gt").select("variant", F.round("entropy", 5).alias("entropy"))


@query("weighted_mean", "SELECT l_suppkey AS k, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def weighted_mean(spark, d):
    rows = v.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "k")
    return stats.weighted_mean(rows, ["k"], "l_extendedprice", "l_quantity").select("k", F.round("mean", 4).alias("mean"))


@query(
    "win_similarity",
    f"""WITH v AS (SELECT CAST(l_suppkey AS VARCHAR) AS c, l_orderkey // 1000 * 1000 AS ws, l_orderkey AS vs, l_orderkey + CAST(l_quantity AS BIGINT) AS ve, l_linenumber AS r, CAST(l_quantity AS BIGINT) AS a FROM lineitem),
k AS (SELECT concat(c, '|', ws) AS chrom, vs AS s, ve + 1 AS e FROM v), {v.merged_sql("k", "m")}, u AS (SELECT chrom, sum(e - s) AS uniq FROM m GROUP BY chrom),
z AS (SELECT c, ws, min(vs) AS lo, max(ve) AS hi, sum(greatest(r, a)) AS al FROM v GROUP BY c, ws),
x AS (SELECT z.*, uniq, greatest(ws + 1000, hi) - least(ws, lo) + 1 - uniq AS ma FROM z JOIN u ON u.chrom = concat(c, '|', ws))
SELECT c AS chrom, ws AS wstart, CAST(uniq AS BIGINT) AS uniq, CAST(ma AS BIGINT) AS match, round(ma / (ma + al), 6) AS sim FROM x""",
)
def win_similarity(spark, d):
    t = v.table(spark, d, "lineitem")
    start = F.floor(F.col("l_orderkey") / 1000) * 1000
    rows = t.select(
        F.col("l_suppkey").cast("string").alias("chrom"), start.alias("wstart"), (start + 1000).alias("wend"), F.col("l_orderkey").alias("vstart"),
        (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("vend"), F.col("l_linenumber").alias("ref_len"), F.col("l_quantity").cast("long").alias("alt_len"),
    )
    return stats.window_similarity(rows).select("chrom", "wstart", "uniq", "match", F.round("sim", 6).alias("sim"))


@query(
    "trimmed_stats",
    """WITH q AS (SELECT l_partkey AS k, quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem GROUP BY 1),
t AS (SELECT l.l_partkey AS k, l.l_extendedprice AS x, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem l JOIN q ON q.k = l.l_partkey WHERE l_extendedprice BETWEEN lo AND hi)
SELECT q.k, CASE WHEN max(n) >= 2 THEN round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) END AS gini, CASE WHEN max(n) >= 2 THEN round(stddev_samp(x), 4) END AS sd FROM q LEFT JOIN t USING (k) GROUP BY q.k""",
)
def trimmed_stats(spark, d):
    rows = v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("x"))
    return stats.trimmed_stats(rows, ["k"], "x").select("k", F.round("gini", 6).alias("gini"), F.round("sd", 4).alias("sd"))


@query("row_max", "SELECT l_partkey AS k, max(l_extendedprice) AS row_max FROM lineitem GROUP BY 1")
def row_max(spark, d):
    return stats.row_max(v.table(spark, d, "lineitem").withColumnRenamed("l_partkey", "k"), ["k"], "l_extendedprice")


@query("class_pivot", "SELECT user_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE event_type = '{c}') AS BIGINT) AS n_{c}" for c in ("click", "view", "purchase")) + " FROM events GROUP BY user_id")
def class_pivot(spark, d):
    return stats.class_counts(v.table(spark, d, "events"), ["user_id"], "event_type", ["click", "view", "purchase"])


@query(
    "bubble_score",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS poly, l_quantity / 10 AS polyrefine, l_tax * 50 AS simple, l_discount * 8 AS pathratio FROM lineitem),
b AS (SELECT *, 2 / (1 + exp(-3 * (polyrefine / (1 + exp(-100 * (poly - 0.1))) - 3))) + 1 / (1 + exp(-3 * (simple - 3))) + CASE WHEN pathratio < 0.5 THEN 1 ELSE 0 END AS v FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS norm_bubble FROM b""",
)
def bubble_score(spark, d):
    t = v.table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = t.select(*keys, F.col("l_discount").alias("poly"), (F.col("l_quantity") / 10).alias("polyrefine"), (F.col("l_tax") * 50).alias("simple"), (F.col("l_discount") * 8).alias("pathratio"))
    return stats.bubble_score(rows).select(*keys, F.round("norm_bubble", 6).alias("norm_bubble"))


@query("hap_freq", "SELECT l_suppkey AS k, l_returnflag AS hap, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey), 6) AS freq FROM lineitem GROUP BY 1, 2")
def hap_freq(spark, d):
    rows = v.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("hap"))
    return stats.group_frequency(rows, ["k"], "hap").select("k", "hap", F.col("count").alias("n"), F.round("freq", 6).alias("freq"))


@query(
    "odds_ratio",
    """WITH n AS (SELECT count(*) FILTER (WHERE e AND c) AS a, count(*) FILTER (WHERE e AND NOT c) AS b, count(*) FILTER (WHERE NOT e AND c) AS c, count(*) FILTER (WHERE NOT e AND NOT c) AS d FROM (SELECT l_quantity > 25 AS e, l_returnflag = 'R' AS c FROM lineitem))
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, round(a * d / (b * c), 6) AS odds_ratio, round(exp(ln(a * d / (b * c)) - 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS low FROM n""",
)
def odds_ratio(spark, d):
    out = stats.odds_ratio(v.table(spark, d, "lineitem"), F.col("l_quantity") > 25, F.col("l_returnflag") == "R")
    return out.select("a", "b", "c", "d", F.round("odds_ratio", 6).alias("odds_ratio"), F.round("low", 6).alias("low"))


# --- ordered rows -----------------------------------------------------------------------------

_EV = "SELECT user_id, event_id, event_type FROM events"


@query(
    "islands_1d",
    "WITH g AS (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 40 THEN 1 ELSE 0 END AS n FROM events) SELECT user_id, event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM g",
)
def islands_1d(spark, d):
    return ordered.islands_1d(v.table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 40)


@query(
    "run_lengths",
    f"""WITH e AS ({_EV}), g AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM g) SELECT user_id, CAST(run AS BIGINT) AS run, event_type, CAST(count(*) AS BIGINT) AS length, min(event_id) AS first FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
)
def run_lengths(spark, d):
    return ordered.run_lengths(v.table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", 2)


@query(
    "consecutive_runs",
    "WITH e AS (SELECT DISTINCT l_suppkey AS k, l_orderkey AS i FROM lineitem), g AS (SELECT k, i, i - row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM e) SELECT k, min(i) AS first, max(i) AS last, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY k, r",
)
def consecutive_runs(spark, d):
    rows = v.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("i"))
    return ordered.consecutive_runs(rows, ["k"], "i")


@query("gaps_to_next", f"WITH {v.IV}, {v.merged_sql('iv', 'm')} SELECT chrom, s, e, lead(s) OVER (PARTITION BY chrom ORDER BY s, e) - e AS gap FROM m")
def gaps_to_next(spark, d):
    return _shown(ordered.gaps_to_next(intervals.merge_intervals(v.intervals(spark, d)), ["chrom"], "start", "end"), "gap")


_SUP = "SELECT l_suppkey AS k, l_partkey AS node, CAST(sum(l_quantity) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2"


def _support(spark, d):
    return v.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("node")).agg(F.sum("l_quantity").cast("long").alias("w"))


@query(
    "cum_share",
    f"WITH s AS ({_SUP}), c AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY w DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, sum(w) OVER (PARTITION BY k) AS t FROM s) SELECT k, node, w FROM c WHERE coalesce(b, 0) <= 0.9 * t",
)
def cum_share(spark, d):
    return ordered.cumulative_share(_support(spark, d), ["k"], "w", "node")


@query("topk_support", f"WITH s AS ({_SUP}), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY w DESC, node) AS rank FROM s) SELECT k, node, w, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def topk_support(spark, d):
    return ordered.top_k(_support(spark, d), ["k"], "w", "node", 20)


@query("equal_slices", "SELECT user_id, event_id, ntile(5) OVER (PARTITION BY user_id ORDER BY event_id) AS slice FROM events")
def equal_slices(spark, d):
    return ordered.equal_slices(v.table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5)


@query(
    "asof_both",
    f"""WITH {v.TGT}, p AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS chrom, l_orderkey AS pos FROM lineitem),
x AS (SELECT t.chrom, t.s, t.e, t.name, (SELECT max(pos) FROM p WHERE p.chrom = t.chrom AND pos < t.s) AS l, (SELECT min(pos) FROM p WHERE p.chrom = t.chrom AND pos >= t.e) AS r FROM tgt t)
SELECT chrom, s, e, name, l AS left_pos, r AS right_pos FROM x WHERE r - l <= 1000000""",
)
def asof_both(spark, d):
    points = v.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("chrom"), F.col("l_orderkey").alias("pos")).distinct()
    return _shown(ordered.asof_both(points, v.targets(spark, d)), "name", F.col("left").alias("left_pos"), F.col("right").alias("right_pos"))


# --- paths ------------------------------------------------------------------------------------

_ST = "st AS (SELECT conv_id AS path, turn AS ord, coalesce(string_split(text, ' ')[1], '') AS node, CAST(length(text) AS BIGINT) AS len, role FROM conversations)"


@query("walk_positions", f"WITH {_ST}, n AS (SELECT node, min(len) AS len FROM st GROUP BY node) SELECT path, ord, CAST(sum(n.len) OVER w AS BIGINT) AS pos_e, CAST(sum(n.len) OVER w - n.len + 1 AS BIGINT) AS pos_s FROM st JOIN n USING (node) WINDOW w AS (PARTITION BY path ORDER BY ord ROWS UNBOUNDED PRECEDING)")
def walk_positions(spark, d):
    st = v.steps(spark, d)
    nodes = st.groupBy("node").agg(F.min("len").alias("len"))
    return ordered.walk_positions(st.drop("len"), nodes, closed=True).select("path", "ord", "pos_e", "pos_s")


@query("path_string", f"WITH {_ST} SELECT path, string_agg(node, '>' ORDER BY ord, node) AS string FROM st GROUP BY path")
def path_string(spark, d):
    return ordered.path_string(v.steps(spark, d), ["path"], "ord", "node", ">")


@query("hap_string", f"WITH {_ST} SELECT path, string_agg(CASE WHEN role = 'user' THEN lower(upper(left(node, 1))) ELSE upper(left(node, 1)) END, '' ORDER BY ord) AS string FROM st GROUP BY path")
def hap_string(spark, d):
    st = v.steps(spark, d).withColumn("letter", F.upper(F.substring("node", 1, 1))).withColumn("strand", F.when(F.col("role") == "user", "-").otherwise("+"))
    return ordered.haplotype_string(st, ["path"], "ord", "letter", "strand")


@query(
    "path_share",
    f"WITH {_ST}, q AS (SELECT DISTINCT path, node FROM st WHERE path % 2 = 1), r AS (SELECT DISTINCT path AS ref_path, node, ord FROM st WHERE path % 2 = 0) SELECT path, min_by(ref_path, (ord, ref_path)) AS ref_path FROM q JOIN r USING (node) GROUP BY path",
)
def path_share(spark, d):
    st = v.steps(spark, d)
    return ordered.path_share(st.where("path % 2 = 1"), st.where("path % 2 = 0"))


@query(
    "weighted_overlap",
    """WITH m AS (SELECT DISTINCT l_suppkey % 10 AS g, l_suppkey AS path, l_partkey AS node, l_partkey % 7 + 1 AS len FROM lineitem), t AS (SELECT g, path, sum(len) AS total FROM m GROUP BY 1, 2),
s AS (SELECT a.g, a.path AS a, b.path AS b, sum(a.len) AS shared FROM m a JOIN m b ON a.g = b.g AND a.node = b.node AND a.path < b.path GROUP BY 1, 2, 3)
SELECT s.a, s.b, round(shared / greatest(x.total, y.total), 6) AS ratio FROM s JOIN t x ON x.g = s.g AND x.path = s.a JOIN t y ON y.g = s.g AND y.path = s.b""",
)
def weighted_overlap(spark, d):
    m = v.table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("group"), F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("node"), (F.col("l_partkey") % 7 + 1).alias("len"))
    return ordered.weighted_overlap(m).select("a", "b", F.round("ratio", 6).alias("ratio"))


@query(
    "pattern_groups",
    """WITH e AS (SELECT l_partkey % 50 AS w, l_suppkey AS sample, string_agg(concat_ws('=', CAST(l_partkey AS VARCHAR), l_returnflag), ',' ORDER BY l_partkey, l_returnflag) AS pattern FROM lineitem GROUP BY 1, 2)
SELECT w AS window_id, pattern, string_agg(CAST(sample AS VARCHAR), ',' ORDER BY CAST(sample AS VARCHAR)) AS samples FROM e GROUP BY 1, 2""",
)
def pattern_groups(spark, d):
    return ordered.pattern_groups(v.genotypes(spark, d)).withColumnRenamed("window", "window_id")


# --- sequences --------------------------------------------------------------------------------

@query("revcomp", "SELECT doc_id, md5(reverse(translate(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), 'ACGT', 'TGCA'))) AS rc FROM documents")
def revcomp(spark, d):
    acgt = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return v.table(spark, d, "documents").select("doc_id", F.md5(seq.revcomp(acgt)).alias("rc"))


_T = "lower(translate(lower(text), 'bdefhijklmnopqrsuvwxyz', 'acgtacgtacgtacgtacgtac'))"
_K = f"k AS (SELECT DISTINCT doc_id, least(x, reverse(translate(x, 'acgt', 'tgca'))) AS kmer FROM (SELECT doc_id, unnest(list_transform(range(1, length(t) - 10 + 1), lambda i: t[i:i+10])) AS x FROM (SELECT doc_id, {_T} AS t FROM documents)) WHERE NOT contains(x, 'n'))"


def _sequences(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.translate(F.lower("text"), "bdefhijklmnopqrsuvwxyz", "acgtacgtacgtacgtacgtac").alias("seq"))


@query("kmer_count", f"WITH {_K}, c AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id) SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM documents LEFT JOIN c USING (doc_id)")
def kmer_count(spark, d):
    return kmers.kmer_counts(_sequences(spark, d), F.col("seq"), 11).drop("seq")


@query("kmer_share", f"WITH {_K}, b AS (SELECT DISTINCT kmer, 1 AS hit FROM k WHERE doc_id % 2 = 0) SELECT doc_id, round(count(hit) / count(*), 6) AS share FROM k LEFT JOIN b USING (kmer) GROUP BY doc_id")
def kmer_share(spark, d):
    rows, s = _sequences(spark, d), F.col("seq")
    return kmers.sequence_share(rows, "doc_id", s, 11, rows.where("doc_id % 2 = 0"), s).select("doc_id", F.round("share", 6).alias("share"))


@query("edit_distance", "WITH t AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS x FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x)), 6) AS dist FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def edit_distance(spark, d):
    t = v.table(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", "[^ -~]", ""))
    a, b = t.select(F.col("item_id").alias("a"), F.col("text").alias("x")), t.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("text").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(seq.normalized_edit_distance(F.col("x"), F.col("y")), 6).alias("dist"))


_G = "g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(length(text) - 29 + 1, 1)), lambda i: text[i:i+29])) AS x FROM documents), z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)"


@query(
    "minhash_lsh",
    f"""WITH {_G}, j AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS s FROM g p JOIN g q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2)
SELECT a, b, round(s / (m.n + o.n - s), 6) AS jaccard FROM j JOIN z m ON m.doc_id = a JOIN z o ON o.doc_id = b WHERE s / (m.n + o.n - s) >= 0.4""",
)
def minhash_lsh(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id", "text")
    return textpairs.text_pairs(rows, "doc_id", "text", 30, least=0.4).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(
    "similar_sets",
    """WITH g AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT min(c) AS c FROM (SELECT c, list(p ORDER BY p) AS l FROM g GROUP BY c) GROUP BY l), k AS (SELECT g.* FROM g JOIN r USING (c)), z AS (SELECT c, count(*) AS n FROM k GROUP BY c),
j AS (SELECT x.c AS a, y.c AS b, count(*) AS s FROM k x JOIN k y ON x.p = y.p AND x.c < y.c GROUP BY 1, 2)
SELECT a, b, s AS shared, round(s / (m.n + o.n - s), 6) AS jaccard FROM j JOIN z m ON m.c = a JOIN z o ON o.c = b WHERE s / (m.n + o.n - s) >= 0.05""",
)
def similar_sets(spark, d):
    """Customers by the parts that they ordered."""
    orders = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = v.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey")
    return setjoin.similar_sets(rows, "o_custkey", ["l_partkey"], 0.05).withColumn("jaccard", F.round("jaccard", 6))


_CHUNK = 500


@query(
    "chunk_fetch",
    "SELECT l_orderkey AS order_key, l_linenumber AS line, doc_id, md5(substr(text, CAST(l_partkey AS BIGINT) + 1, CAST(l_quantity AS BIGINT) * 40)) AS part FROM lineitem JOIN documents ON doc_id = l_suppkey WHERE length(text) > l_partkey",
)
def chunk_fetch(spark, d):
    """Ranges of documents, as sequences in chunks, by their suppliers' lines."""
    chunks = fasta.chunk_sequences(v.table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("seq")), _CHUNK)
    t = v.table(spark, d, "lineitem")
    at = F.col("l_partkey").cast("long")
    ranges = t.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("chrom"), at.alias("start"), (at + F.col("l_quantity").cast("long") * 40).alias("end"))
    found = fasta.fetch(chunks, ranges, _CHUNK).where("seq is not null")
    return found.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("chrom").alias("doc_id"), F.md5("seq").alias("part"))


# --- clusters ---------------------------------------------------------------------------------

_EDGES = "e AS (SELECT DISTINCT o_custkey * 2 AS a, o_orderkey * 2 + 1 AS b FROM orders UNION SELECT c_custkey * 2, c_custkey * 2 + 2 FROM customer WHERE c_custkey % 7 <> 0)"


@query(
    "components",
    f"WITH RECURSIVE {_EDGES}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS n, a AS m FROM s UNION SELECT s.b, r.m FROM r JOIN s ON s.a = r.n) SELECT n AS node, min(m) AS component FROM r GROUP BY n",
)
def components(spark, d):
    """Customers (even nodes) with their orders (odd ones), and chains of customers."""
    own = v.table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("src"), (F.col("o_orderkey") * 2 + 1).alias("dst"))
    chain = v.table(spark, d, "customer").where("c_custkey % 7 <> 0").select((F.col("c_custkey") * 2).alias("src"), (F.col("c_custkey") * 2 + 2).alias("dst"))
    return connected_components(own.unionByName(chain).distinct())


@query("components_all")
def components_all(spark, d):
    """Over every row of lineitem; parts are even nodes, orders odd ones. Without SQL: the recursion above keeps a row for every pair of connected nodes."""
    t = v.table(spark, d, "lineitem")
    return connected_components(t.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_orderkey") * 2 + 1).alias("dst")))


@query(
    "eps_clusters",
    """WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_custkey % 20 AS g, o_orderkey AS x, CAST(floor(o_totalprice / 100) AS BIGINT) AS y FROM orders),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.g = b.g AND abs(a.x - b.x) <= 30 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900),
r AS (SELECT a AS n, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n) SELECT x AS order_key, c AS first_key FROM (SELECT n, min(m) AS m FROM r GROUP BY n) JOIN p ON p.id = n JOIN (SELECT id, x AS c FROM p) q ON q.id = m""",
)
def eps_clusters(spark, d):
    rows = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("g"), F.col("o_orderkey").alias("x"), F.floor(F.col("o_totalprice") / 100).alias("y"))
    return clustering.eps_clusters(rows, ["g"], ["x", "y"], 30.0).select(F.col("id").alias("order_key"), F.col("cluster").alias("first_key"))


@query("greedy_dedup")
def greedy_dedup(spark, d):
    iv = v.intervals(spark, d).distinct()
    group = intervals.mark_islands(iv, ["chrom"]).withColumnRenamed("island", "_s")
    return _shown(clustering.greedy_dedup(group, ["chrom", "_s"]), "name")


# --- features and model -----------------------------------------------------------------------

#: Parameters that stand for fitted ones: three centroids on 64 coordinates, by a rule.
CENTROIDS = [[((i * (k + 2) + k) % 5 - 2) / 10 for i in range(64)] for k in range(3)]
_Q = [f"list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - ((((i - 1) * {k + 2} + {k}) % 5 - 2) / 10)) ** 2))" for k in range(3)]


@query(
    "student_t_assign",
    f"WITH q AS (SELECT vec_id, {', '.join(f'1 / (1 + {x}) AS q{i}' for i, x in enumerate(_Q))} FROM embeddings) SELECT vec_id, round(q0 / (q0 + q1 + q2), 6) AS p0, round(q1 / (q0 + q1 + q2), 6) AS p1, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 'simple' WHEN q1 >= q2 THEN 'CC4' ELSE 'CC1' END AS label FROM q",
)
def student_t_assign(spark, d):
    rows = v.table(spark, d, "embeddings").select("vec_id", model.soft_assign(F.col("embedding").cast("array<double>"), CENTROIDS).alias("q"))
    return rows.select("vec_id", F.round(F.col("q")[0], 6).alias("p0"), F.round(F.col("q")[1], 6).alias("p1"), model.argmax_label(F.col("q"), model.LABELS[:3]).alias("label"))


@query("encoder")
def encoder(spark, d):
    import numpy as np

    rng = np.random.default_rng(0)
    weights = [(rng.normal(0, 0.1, (a, b)), np.zeros(b)) for a, b in ((64, 128), (128, 128), (128, 256), (256, 10))]
    rows = v.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return model.encode(rows, "x", weights).select("vec_id", F.transform("z", lambda x: F.round(x, 4)).alias("z"))


@query(
    "feature_assembly",
    """SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.n_chars IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL""",
)
def feature_assembly(spark, d):
    return model.assemble(v.table(spark, d, "documents").select("doc_id", "n_chars"), [v.table(spark, d, "labels")], ["doc_id"])


_WIN = "w AS (SELECT chrom, unnest(generate_series(s, e - 1, 500)) AS s0, e FROM (SELECT chrom, min(s) AS s, max(e) AS e FROM iv GROUP BY chrom))"
_VAR = """vr AS (SELECT CAST(l_suppkey AS VARCHAR) AS chrom, l_orderkey AS s, l_orderkey + l_linenumber AS e, l_linenumber AS r, CAST(l_quantity AS BIGINT) AS a,
  CASE len(list_distinct([l_returnflag, l_linestatus, 'N'])) WHEN 1 THEN 0.0 WHEN 2 THEN 0.9183 ELSE 1.0 END AS entropy FROM lineitem)"""


def _variants(spark, d):
    size = F.col("l_linenumber").cast("long")
    return v.table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("chrom"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + size).alias("end"),
        size.alias("ref_len"), F.col("l_quantity").cast("long").alias("alt_len"), stats.entropy_of(F.array("l_returnflag", "l_linestatus", F.lit("N"))).alias("entropy"),
    )


def _windows(spark, d):
    hulls = v.intervals(spark, d).groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return intervals.make_windows(hulls, 1000, 500)


_MET = """met AS (SELECT w.chrom, w.s0 AS ws, least(w.s0 + 1000, w.e) AS we, vr.s AS vs, vr.e AS ve, r, a, entropy FROM w JOIN vr ON vr.chrom = w.chrom AND vr.s < least(w.s0 + 1000, w.e) AND w.s0 < vr.e)"""
_DIVERSITY = f"""{_MET}, k AS (SELECT concat(chrom, '|', ws) AS chrom, vs AS s, ve + 1 AS e FROM met), {v.merged_sql("k", "um")}, u AS (SELECT chrom, sum(e - s) AS uniq FROM um GROUP BY chrom),
sz AS (SELECT chrom, ws, we, least(ws, min(vs)) AS lo, greatest(we, max(ve)) AS hi, sum(greatest(r, a)) AS al, sum(a * CAST(entropy AS DOUBLE)) / sum(a) AS entropy, CAST(sum(a) AS BIGINT) AS weight FROM met GROUP BY chrom, ws, we),
dv AS (SELECT sz.chrom, ws, we, entropy, weight, (hi - lo + 1 - uniq) / (hi - lo + 1 - uniq + al) AS win_sim FROM sz JOIN u ON u.chrom = concat(sz.chrom, '|', ws))"""


@query(
    "window_diversity",
    f"WITH {v.IV}, {_WIN}, {_VAR}, {_DIVERSITY} SELECT chrom, ws AS s, we AS e, round(entropy * weight, 4) AS weighted, weight, round(win_sim, 6) AS win_sim FROM dv",
)
def window_diversity(spark, d):
    done = regions.window_diversity(_windows(spark, d), _variants(spark, d))
    return _shown(done, F.round(F.col("entropy") * F.col("weight"), 4).alias("weighted"), "weight", F.round("win_sim", 6).alias("win_sim"))


#: Parameters that stand for fitted ones, by a rule: mean and deviation of each feature, two dense layers (8 to 3 to 2), three centroids.
_MEAN, _STD = [i / 10 for i in range(8)], [1 + i / 4 for i in range(8)]
_LAYERS = [([[((3 * i + 5 * j) % 7 - 3) / 4 for j in range(b)] for i in range(a)], [(j - 1) / 5 for j in range(b)]) for a, b in ((8, 3), (3, 2))]
_MIDDLES = [[((i * (k + 2) + k) % 5 - 2) / 2 for i in range(2)] for k in range(3)]


def _scored_sql() -> str:
    unit = [f"(({c}) - {m}) / {s}" for c, m, s in zip(model.FEATURES, _MEAN, _STD)]
    dense = lambda xs, layer, j: " + ".join([f"({x}) * ({layer[0][i][j]})" for i, x in enumerate(xs)] + [f"({layer[1][j]})"])
    hidden = ", ".join(f"greatest({dense(unit, _LAYERS[0], j)}, 0) AS h{j}" for j in range(3))
    code = ", ".join(f"{dense(['h0', 'h1', 'h2'], _LAYERS[1], j)} AS z{j}" for j in range(2))
    kernel = ", ".join(f"1 / (1 + (z0 - ({a})) ** 2 + (z1 - ({b})) ** 2) AS q{k}" for k, (a, b) in enumerate(_MIDDLES))
    gini = "2 * sum(i * x) / nullif(n * sum(x), 0) - (n + 1.0) / nullif(n, 0)"
    trimmed = lambda source, x: f"""(SELECT chrom, s, e, max(x) AS most, stddev_samp(x) FILTER (x BETWEEN lo AND hi) AS sd FROM (SELECT *, {x} AS x, quantile_cont({x}, 0.05) OVER (PARTITION BY chrom, s, e) AS lo,
  quantile_cont({x}, 0.95) OVER (PARTITION BY chrom, s, e) AS hi FROM {source}) GROUP BY chrom, s, e HAVING count(*) FILTER (x BETWEEN lo AND hi) > 0)"""  # noqa: E731
    ginied = lambda source, x: f"""(SELECT chrom, s, e, CASE WHEN n >= 2 THEN {gini} END AS gini FROM (SELECT *, row_number() OVER (PARTITION BY chrom, s, e ORDER BY x) AS i, count(*) OVER (PARTITION BY chrom, s, e) AS n
  FROM (SELECT *, CAST({x} AS DOUBLE) AS x, quantile_cont({x}, 0.05) OVER (PARTITION BY chrom, s, e) AS lo, quantile_cont({x}, 0.95) OVER (PARTITION BY chrom, s, e) AS hi FROM {source}) WHERE x BETWEEN lo AND hi)
  GROUP BY chrom, s, e, n)"""  # noqa: E731
    return f"""WITH {v.IV}, {_WIN}, {_VAR}, {_DIVERSITY}, sp AS (SELECT w.chrom, w.s0 AS s, least(w.s0 + 1000, w.e) AS e, l_discount, l_extendedprice, l_tax, l_quantity FROM w
  JOIN lineitem ON chrom = CAST(l_suppkey AS VARCHAR) AND l_orderkey BETWEEN w.s0 AND least(w.s0 + 1000, w.e) - 1),
lc AS (SELECT CAST(l_suppkey AS VARCHAR) AS chrom, l_orderkey // 400 * 400 AS s, l_orderkey // 400 * 400 + 100 AS e, CAST(l_quantity AS BIGINT) AS copies FROM lineitem),
lg AS {ginied("lc", "copies")}, vn AS (SELECT w.chrom, w.s0 AS s, max(gini) AS g FROM w JOIN lg ON lg.chrom = w.chrom AND lg.s < least(w.s0 + 1000, w.e) AND w.s0 < lg.e GROUP BY 1, 2),
bb AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS chrom, o_orderkey AS s, o_orderkey + 3000 AS e, (o_orderkey % 90) / 100 AS ratio FROM orders WHERE o_orderkey % 7 = 0),
bw AS (SELECT w.chrom, w.s0 AS s, max(1 / (1 + exp(-3 * (ratio - 3))) + CASE WHEN ratio < 0.5 THEN 1 ELSE 0 END) AS sb,
  max(2 / (1 + exp(-3 * (1 / (1 + exp(-100 * (ratio - 0.1))) * ratio - 3))) + CASE WHEN ratio < 0.5 THEN 1 ELSE 0 END) AS cb
  FROM w JOIN bb ON bb.chrom = w.chrom AND bb.s <= w.s0 AND least(w.s0 + 1000, w.e) <= bb.e GROUP BY 1, 2),
f AS (SELECT dv.chrom, ws AS s, we AS e, hm.most AS sd_max, hm.sd AS sd_var, coalesce(sb, 0.01) AS sim_bubble, coalesce(cb, 0.01) AS com_bubble, (1 - win_sim) + entropy AS Vscore, coalesce(el.gini, 0) AS TEgini,
  CASE WHEN vn.chrom IS NULL THEN 0.0 ELSE 1.0 END AS vntr_cov, coalesce(vn.g, 0) AS vntr_gini_max
  FROM dv JOIN {trimmed("sp", "l_discount")} hm ON hm.chrom = dv.chrom AND hm.s = ws AND hm.e = we AND hm.sd IS NOT NULL JOIN {ginied("sp", "l_quantity")} el ON el.chrom = dv.chrom AND el.s = ws AND el.e = we
  LEFT JOIN vn ON vn.chrom = dv.chrom AND vn.s = ws LEFT JOIN bw ON bw.chrom = dv.chrom AND bw.s = ws),
h AS (SELECT chrom, s, e, {hidden} FROM f), z AS MATERIALIZED (SELECT chrom, s, e, {code} FROM h), q AS (SELECT chrom, s, e, {kernel} FROM z)
SELECT chrom, s, e, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 'simple' WHEN q1 >= q2 THEN 'CC4' ELSE 'CC1' END AS cluster, round(q0 / (q0 + q1 + q2), 4) AS p0, round(q1 / (q0 + q1 + q2), 4) AS p1 FROM q"""


@query("classed_regions", _scored_sql())
def classed_regions(spark, d):
    """The five branches of windows of lineitem and orders, joined, scaled, encoded and classed."""
    t, w, key = v.table(spark, d, "lineitem"), _windows(spark, d), F.col("l_suppkey").cast("string").alias("chrom")
    spots = t.select(key, F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + 1).alias("end"), "l_discount", "l_quantity")
    met = intervals.overlap_join(w, spots).select("chrom", F.col("start_a").alias("start"), F.col("end_a").alias("end"), F.col("l_discount_b").alias("sim"), F.col("l_quantity_b").alias("delta"))
    at = F.floor(F.col("l_orderkey") / 400) * 400
    copies = t.select(key, at.alias("start"), (at + 100).alias("end"), F.col("l_quantity").cast("long").alias("copies"))
    orders = v.table(spark, d, "orders").where("o_orderkey % 7 = 0")
    ratio = (F.col("o_orderkey") % 90) / 100
    bubbles = orders.select((F.col("o_custkey") % 100).cast("string").alias("chrom"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 3000).alias("end"), *[ratio.alias(c) for c in ("poly", "polyratio", "simple", "pathratio")])
    features = regions.region_features(
        regions.window_diversity(w, _variants(spark, d)), regions.element_variation(met), regions.homology_variation(met),
        regions.repeat_variation(w, copies), regions.bubble_features(w, bubbles),
    )
    done = regions.class_regions(features, _MEAN, _STD, _LAYERS, _MIDDLES)
    return _shown(done, "cluster", F.round("simple", 4).alias("p0"), F.round("CC4", 4).alias("p1"))


# --- the rest of the inventory ------------------------------------------------------------------


@query(
    "nonrepeat_filter",
    f"""WITH {v.IV}, {v.TGT}, {v.merged_sql("iv", "m")}, t AS (SELECT *, row_number() OVER () AS id FROM tgt),
c AS (SELECT id, sum(least(t.e, m.e) - greatest(t.s, m.s)) AS covered FROM t JOIN m ON t.chrom = m.chrom AND t.s < m.e AND m.s < t.e GROUP BY id)
SELECT chrom, s, e, name FROM t LEFT JOIN c USING (id) WHERE e - s - coalesce(covered, 0) >= 3""",
)
def nonrepeat_filter(spark, d):
    return _shown(intervals.nonrepeat_filter(v.targets(spark, d), v.intervals(spark, d), 3), "name")


@query(
    "except_intersect",
    "SELECT k, 'only' AS side FROM (SELECT l_partkey AS k FROM lineitem EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT k, 'both' FROM (SELECT l_partkey AS k FROM lineitem INTERSECT SELECT o_custkey FROM orders)",
)
def except_intersect(spark, d):
    a = v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    b = v.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return a.subtract(b).select("k", F.lit("only").alias("side")).unionByName(a.intersect(b).select("k", F.lit("both").alias("side")))


@query("first_per_group", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_per_group(spark, d):
    return pairs.first_per_group(v.table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query(
    "length_ratio_class",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount * 10 >= 0.8 AND l_tax * 12 >= 0.8 THEN 'both' WHEN l_discount * 10 >= 0.95 OR l_tax * 12 >= 0.95 THEN 'either' ELSE 'none' END AS ratio_class FROM lineitem",
)
def length_ratio_class(spark, d):
    rows = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("reflenratio"), (F.col("l_tax") * 12).alias("quelenratio"))
    return pairs.length_ratio_class(rows).drop("reflenratio", "quelenratio")


@query(
    "shorter_overlap",
    f"WITH {v.IV}, {v.TGT} SELECT a.chrom, a.s, b.s AS b_s, b.e AS b_e, round((least(a.e, b.e) - greatest(a.s, b.s) + 1) / least(a.e - a.s + 1, b.e - b.s + 1), 6) AS share FROM tgt a JOIN iv b ON a.chrom = b.chrom AND a.s <= b.e AND b.s <= a.e",
)
def shorter_overlap(spark, d):
    j = intervals.overlap_join(v.targets(spark, d), v.intervals(spark, d), closed=True)
    share = seq.shorter_overlap(F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b"))
    return j.select("chrom", F.col("start_a").alias("s"), F.col("start_b").alias("b_s"), F.col("end_b").alias("b_e"), F.round(share, 6).alias("share"))


@query(
    "clip_steps",
    f"""WITH {_ST}, p AS (SELECT path, ord, node, CAST(sum(len) OVER w AS BIGINT) AS pos_e, CAST(sum(len) OVER w AS BIGINT) - len AS pos_s FROM st WINDOW w AS (PARTITION BY path ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT path, ord, greatest(pos_s, 50) - pos_s AS from_pos, least(pos_e, 400) - pos_s AS to_pos, greatest(pos_s, 50) - 50 AS at_pos FROM p WHERE pos_s < 400 AND 50 < pos_e""",
)
def clip_steps(spark, d):
    from pyspark.sql import Window

    st = v.steps(spark, d)
    end = F.sum("len").over(Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    st = st.withColumn("pos_e", end).withColumn("pos_s", F.col("pos_e") - F.col("len"))
    regions = st.select("path").distinct().select("path", F.lit(50).cast("long").alias("start"), F.lit(400).cast("long").alias("end"))
    return ordered.clip_steps(st, regions).select("path", "ord", F.col("from").alias("from_pos"), F.col("to").alias("to_pos"), F.col("at").alias("at_pos"))


@query(
    "enrichment_p",
    f"""WITH {v.IV}, {v.TGT}, sh AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS k), x AS (SELECT concat(k, '|', chrom) AS chrom, s + greatest(k, 0) * 17 AS s, e + greatest(k, 0) * 17 AS e FROM iv, sh), {v.merged_sql("x", "m")},
t AS (SELECT concat(k, '|', chrom) AS chrom, s, e, name, k, row_number() OVER () AS id FROM tgt, sh),
c AS (SELECT t.id, t.k, t.name, t.e - t.s AS len, sum(CASE WHEN m.s IS NULL THEN 0 ELSE least(t.e, m.e) - greatest(t.s, m.s) END) AS cov FROM t LEFT JOIN m ON t.chrom = m.chrom AND t.s < m.e AND m.s < t.e GROUP BY ALL),
n AS (SELECT k, count(*) FILTER (WHERE r > 0.64) AS n FROM (SELECT k, name, sum(cov) / sum(len) AS r FROM c GROUP BY 1, 2) GROUP BY k), o AS (SELECT n AS observed FROM n WHERE k = -1)
SELECT observed, count(*) AS shuffles, (1 + count(*) FILTER (WHERE n >= observed)) / (1 + count(*)) AS p FROM n, o WHERE k <> -1 GROUP BY observed""",
)
def enrichment_p(spark, d):
    iv = v.intervals(spark, d)
    shuffles = spark.range(5).select(F.col("id").cast("int").alias("shuffle_id"))
    moved = iv.join(F.broadcast(shuffles)).select("shuffle_id", "chrom", (F.col("start") + F.col("shuffle_id") * 17).alias("start"), (F.col("end") + F.col("shuffle_id") * 17).alias("end"))
    return stats.enrichment(v.targets(spark, d), iv, moved, 0.64)


@query("motif_copy_number")
def motif_copy_number(spark, d):
    from spanweave.operators import motif

    acgt = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz ,.", "ACGTACGTACGTACGTACGTACGTACGTA")
    rows = v.table(spark, d, "benchmark").select("item_id", acgt.alias("sequence")).withColumn("unit", F.substring("sequence", 1, 4))
    # a small file of repeated texts is one split, and its rows long work of one task
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return motif.with_copy_number(rows, "unit", "sequence").drop("sequence")


@query("region_blocks")
def region_blocks(spark, d):
    return blocks.region_blocks(v.steps(spark, d).withColumn("region", F.col("path") % 10))


@query("chunked_blocks")
def chunked_blocks(spark, d):
    """Documents of a language as paths of sentences: the blocks that copies share. Rounds of changes to all paths have no SQL."""
    sentences = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "[.!?\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    rows = v.table(spark, d, "documents").select(F.col("lang").alias("region"), F.col("doc_id").alias("path"), F.posexplode(sentences).alias("ord", "node"))
    found, nodes = chunked.chunked_blocks(rows.withColumn("len", F.length("node")))
    kept = found.groupBy("region").agg(F.countDistinct("path").alias("paths"), F.sum(F.col("last") - F.col("first") + 1).alias("steps"))
    return chunked.block_summary(found, nodes).join(kept, "region", "left").withColumn("polyratio", F.round("polyratio", 6))


_AP = f"""{_ST}, x AS (SELECT path % 10 AS region, *, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY ord) AS r FROM st),
u AS (SELECT region, node, count(DISTINCT path) AS s FROM x GROUP BY 1, 2), t AS (SELECT region, node FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY s DESC, node) AS k FROM u) WHERE k <= 20),
h AS (SELECT DISTINCT region, path, node AS a FROM x JOIN t USING (region, node) WHERE r <= 10), l AS (SELECT DISTINCT region, path, node AS b FROM x JOIN t USING (region, node) WHERE r > n - 10),
c AS (SELECT region, a, b, count(DISTINCT path) AS paths FROM h JOIN l USING (region, path) WHERE a <> b GROUP BY 1, 2, 3)"""


@query("anchor_pair", f"WITH {_AP} SELECT region, m.a AS a, m.b AS b, m.paths AS paths FROM (SELECT region, max_by(c, (paths, a, b)) AS m FROM c GROUP BY region)")
def anchor_pair(spark, d):
    return blocks.anchor_pair(v.steps(spark, d).withColumn("region", F.col("path") % 10))


@query(
    "anchored_paths",
    f"""WITH {_AP}, m AS (SELECT region, arg_max(a, (paths, a, b)) AS a, arg_max(b, (paths, a, b)) AS b FROM c GROUP BY region),
e AS (SELECT region, path, node, ord < min(ord) OVER (PARTITION BY path) + 10 AS f, ord > max(ord) OVER (PARTITION BY path) - 10 AS l FROM x)
SELECT region, path, a, b FROM e JOIN m USING (region) GROUP BY ALL HAVING (bool_or(f AND node = a) AND bool_or(l AND node = b)) OR (bool_or(f AND node = b) AND bool_or(l AND node = a))""",
)
def anchored_paths(spark, d):
    return paths.anchored_paths(v.steps(spark, d).withColumn("region", F.col("path") % 10))


@query(
    "structural_runs",
    f"""WITH {_ST}, r AS (SELECT path, ord, len, CASE WHEN role = 'assistant' THEN ord * 100 END AS p FROM st),
x AS (SELECT *, sum(CASE WHEN p IS NULL THEN 0 ELSE 1 END) OVER w AS on_, sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) OVER w AS off_,
  last_value(p IGNORE NULLS) OVER b AS bs, last_value(p + len IGNORE NULLS) OVER b AS be, first_value(p IGNORE NULLS) OVER a AS s1, first_value(p + len IGNORE NULLS) OVER a AS e1 FROM r
  WINDOW w AS (PARTITION BY path ORDER BY ord ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY path ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
i AS (SELECT path, min(ord) AS first, max(ord) AS last, sum(len) AS inserted, any_value(bs) AS bs, any_value(be) AS be, any_value(s1) AS s1, any_value(e1) AS e1 FROM x WHERE p IS NULL GROUP BY path, on_),
o AS (SELECT path, off_, ord, p AS s, p + len AS e, max(p + len) OVER (PARTITION BY path, off_ ORDER BY p, p + len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM x WHERE p IS NOT NULL),
g AS (SELECT path, off_, pe, s FROM o WHERE s > pe + 20), f AS (SELECT path, off_, min(ord) AS first, max(ord) AS last FROM o GROUP BY 1, 2)
SELECT path, 'INS' AS kind, first, last, be AS left_end, s1 AS right_pos, CAST(inserted AS BIGINT) AS inserted, 0 AS deleted FROM i
WHERE inserted > 20 OR coalesce(s1, -2) - coalesce(be, -1) > 20 OR coalesce(bs, -1) - coalesce(e1, -2) > 20
UNION ALL SELECT path, 'DEL', first, last, pe, s, 0, s - pe FROM g JOIN f USING (path, off_)""",
)
def structural_runs(spark, d):
    off = F.when(F.col("role") == "assistant", F.col("ord").cast("long") * 100)
    return blocks.structural_runs(v.steps(spark, d).withColumn("ref_pos", off))


@query(
    "element_delta",
    "SELECT user_id, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END ELSE 0 END) AS BIGINT) AS delta FROM events GROUP BY user_id",
)
def element_delta(spark, d):
    e = v.table(spark, d, "events").withColumnRenamed("user_id", "window")
    counts = e.select("window", F.when(F.col("event_id") % 3 == 0, "SDR").otherwise("REF").alias("source"), F.col("event_type").alias("kind"), F.lit(1).cast("long").alias("n"))
    out = blocks.element_delta(e.select("window").distinct(), counts, ["click", "view"])
    return out.select(F.col("window").alias("user_id"), F.col("delta").cast("long").alias("delta"))


# --- paths through a graph ----------------------------------------------------------------------

_SEQ = "translate(lower(node), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


@query("oriented_sequence", f"WITH {_ST} SELECT path, md5(string_agg(CASE WHEN role = 'user' THEN {_SEQ} ELSE reverse(translate({_SEQ}, 'ACGT', 'TGCA')) END, '' ORDER BY ord)) AS seq FROM st GROUP BY path")
def oriented_sequence(spark, d):
    st = v.steps(spark, d).withColumn("orient", F.when(F.col("role") == "user", ">").otherwise("<"))
    acgt = F.translate(F.lower("node"), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return paths.oriented_sequences(st, st.select("node", acgt.alias("seq")).distinct()).select("path", F.md5("seq").alias("seq"))


_POS = f"{_ST}, n AS (SELECT node, min(len) AS len FROM st GROUP BY node), p AS (SELECT path, ord, node, role, n.len AS len, CAST(sum(n.len) OVER w AS BIGINT) AS pos_e, CAST(sum(n.len) OVER w - n.len + 1 AS BIGINT) AS pos_s FROM st JOIN n USING (node) WINDOW w AS (PARTITION BY path ORDER BY ord ROWS UNBOUNDED PRECEDING))"


def _positions(spark, d):
    st = v.steps(spark, d)
    return ordered.walk_positions(st.drop("len"), st.groupBy("node").agg(F.min("len").alias("len")), closed=True)


@query(
    "asof_path",
    f"""WITH {_POS}, x AS (SELECT path, max(pos_s) FILTER (WHERE pos_s <= 50) AS l, min(pos_e) FILTER (WHERE pos_e >= 120) AS r FROM p GROUP BY path),
f AS (SELECT path, min(ord) AS first_ord FROM p JOIN x USING (path) WHERE pos_s = l GROUP BY path), g AS (SELECT path, min(ord) AS last_ord FROM p JOIN x USING (path) WHERE pos_e = r GROUP BY path)
SELECT path, first_ord, last_ord FROM x LEFT JOIN f USING (path) LEFT JOIN g USING (path)""",
)
def asof_path(spark, d):
    p = _positions(spark, d)
    regions = p.select("path").distinct().select("path", F.lit(50).cast("long").alias("start"), F.lit(120).cast("long").alias("end"))
    return ordered.asof_path(regions, p).select("path", "first_ord", "last_ord")


@query("unmatched_paths", f"WITH {_ST} SELECT DISTINCT path FROM st q WHERE path % 2 = 1 AND NOT EXISTS (SELECT 1 FROM st x JOIN st r ON x.node = r.node WHERE x.path = q.path AND r.path % 2 = 0)")
def unmatched_paths(spark, d):
    st = v.steps(spark, d)
    return paths.unmatched_paths(st.where("path % 2 = 1"), st.where("path % 2 = 0"))


_COMMON = "c AS (SELECT node FROM st GROUP BY node HAVING count(DISTINCT path) >= 3)"


@query("disjoint_paths", f"WITH {_ST}, {_COMMON} SELECT path, ord, EXISTS (SELECT 1 FROM st x JOIN c USING (node) WHERE x.path = st.path) AS meets FROM st")
def disjoint_paths(spark, d):
    st = v.steps(spark, d)
    common = stats.sample_support(st, sample="path").where("support >= 3")
    sides = [paths.disjoint_paths(st, common, x).select("path", "ord", F.lit(not x).alias("meets")) for x in (True, False)]
    return sides[0].unionByName(sides[1])


@query("consumed_matches", f"WITH {_ST} SELECT q.path AS path, min(r.path) AS ref_path FROM st q JOIN st r ON q.node = r.node WHERE q.path % 2 = 1 AND r.path % 2 = 0 GROUP BY q.path")
def consumed_matches(spark, d):
    st = v.steps(spark, d)
    return paths.consumed_matches(st.where("path % 2 = 1"), st.where("path % 2 = 0").withColumn("rank", F.col("path")))


@query("repeated_paths", f"WITH {_ST}, a AS (SELECT path, arg_min(node, ord) AS f, count(*) AS n FROM st GROUP BY path) SELECT path, min(path) OVER (PARTITION BY f, n) AS kept FROM a")
def repeated_paths(spark, d):
    whole = v.steps(spark, d).groupBy("path").agg(F.min_by("node", "ord").alias("first_node"), F.count("*").alias("len"))
    return paths.drop_repeated_paths(whole)


@query("haplotype_paths")
def haplotype_paths(spark, d):
    """Genotypes of suppliers at 50 sites of one reference path; no SQL: what is missing is chained to a fixpoint."""
    t = v.table(spark, d, "lineitem")
    site = (F.col("l_partkey") % 50).alias("variant")
    gt = F.when(F.col("l_returnflag") == "A", ".").when(F.col("l_returnflag") == "R", "1").otherwise("0")
    genotypes = t.groupBy(F.col("l_suppkey").alias("group"), site).agg(F.max(gt).alias("gt"))
    sites = spark.range(50).select(F.col("id").alias("variant"))
    own = F.format_string(">%d>%d>%d", F.col("variant") * 2, F.col("variant") * 2 + 1, F.col("variant") * 2 + 2)
    other = F.format_string(">%d>9%d>%d", F.col("variant") * 2, F.col("variant"), F.col("variant") * 2 + 2)
    alleles = sites.select("variant", F.lit(0).alias("allele"), own.alias("traversal")).unionByName(sites.select("variant", F.lit(1).alias("allele"), other.alias("traversal")))
    return paths.haplotype_paths(genotypes, alleles, F.lit("".join(f">{k}" for k in range(101))))


@query(
    "project_regions",
    f"""WITH {_POS}, i AS (SELECT path AS region, node, ord, role, greatest(pos_s - 1, 19) - (pos_s - 1) AS f, least(pos_e, 150) - (pos_s - 1) AS t, len FROM p WHERE path % 2 = 0 AND pos_s - 1 < 150 AND 19 < pos_e AND len > 0),
h AS (SELECT region, s.path AS sample, i.ord, f, t, CASE WHEN i.role = s.role THEN s.pos_s - 1 + f ELSE s.pos_s - 1 + i.len - t END AS s, CASE WHEN i.role = s.role THEN s.pos_s - 1 + t ELSE s.pos_s - 1 + i.len - f END AS e FROM i JOIN p s ON s.node = i.node AND s.path % 2 = 1),
sh AS (SELECT region, sample, sum(w) / 131 AS share FROM (SELECT DISTINCT region, sample, ord, t - f AS w FROM h) GROUP BY 1, 2),
r AS (SELECT *, max(e) OVER (PARTITION BY region, sample ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM h),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > 131 / 2 THEN 1 ELSE 0 END) OVER (PARTITION BY region, sample ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM r),
q AS (SELECT region, sample, min(s) AS s, max(e) AS e, least(max(e) - min(s), 131) / greatest(max(e) - min(s), 131) AS ratio FROM g GROUP BY region, sample, run),
w AS (SELECT region, sample, min(s) AS s, max(e) AS e, least(max(e) - min(s), 131) / greatest(max(e) - min(s), 131) AS ratio FROM h GROUP BY 1, 2),
k AS (SELECT q.* FROM q JOIN w USING (region, sample) WHERE q.ratio > 0.5 AND w.ratio <= 0.5),
o AS (SELECT * FROM k UNION ALL SELECT * FROM w ANTI JOIN k USING (region, sample))
SELECT region, sample, s, e, round(ratio, 6) AS ratio, round(share, 6) AS share FROM o JOIN sh USING (region, sample)""",
)
def project_regions(spark, d):
    p = _positions(spark, d).withColumn("orient", F.col("role"))
    reference, sample = p.where("path % 2 = 0 and len > 0"), p.where("path % 2 = 1")
    regions = reference.select("path").distinct().select(F.col("path").alias("region"), "path", F.lit(20).cast("long").alias("start"), F.lit(150).cast("long").alias("end"))
    placed = sample.select(F.col("path").alias("sample"), F.lit("c").alias("chrom"), "node", (F.col("pos_s") - 1).alias("start"), F.col("pos_e").alias("end"), "orient")
    return paths.project_regions(regions, reference, placed).select("region", "sample", F.col("start").alias("s"), F.col("end").alias("e"), F.round("ratio", 6).alias("ratio"), F.round("share", 6).alias("share"))


@query("unit_steps", f"WITH {_ST} SELECT path, ord, CAST(unnest(generate_series(0, CASE WHEN len > 10 THEN len // 10 ELSE 1 END - 1)) AS INTEGER) AS part FROM st")
def unit_steps(spark, d):
    return paths.unit_steps(v.steps(spark, d)).select("path", "ord", "part")


# --- windows, tables and the small ones -----------------------------------------------------------


@query(
    "adjacent_windows",
    f"""WITH {v.IV}, l AS (SELECT chrom, s, e, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM iv WINDOW w AS (PARTITION BY chrom ORDER BY s, e)),
n AS (SELECT *, sum(CASE WHEN ps IS NULL OR NOT ((s >= ps AND e <= pe) OR least(e, pe) - greatest(s, ps) > 15) THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT chrom, s, e, min(s) OVER (PARTITION BY chrom, g) AS cluster FROM n""",
)
def adjacent_windows(spark, d):
    return _shown(intervals.adjacent_windows(v.intervals(spark, d), 15), "cluster")


@query("carry_hulls")
def carry_hulls(spark, d):
    """A window's hull depends on the one before it in turn, which SQL's windows cannot carry."""
    w = v.targets(spark, d).withColumns({"hull_start": F.col("start") - F.col("start") % 50, "hull_end": F.col("end") + F.col("start") % 70})
    return _shown(intervals.carry_hulls(w), "name", "hull_start", "hull_end", "extended")


@query(
    "overlap_clusters",
    f"""WITH RECURSIVE {v.PAIRS}, i AS (SELECT pair, row_number() OVER (ORDER BY pair) AS id, chrom1, start1, end1, chrom2, start2, end2 FROM (SELECT DISTINCT * EXCLUDE (score) FROM pr)),
e AS (SELECT p.id AS a, q.id AS b FROM i p JOIN i q ON p.id <> q.id AND p.chrom1 = q.chrom1 AND p.chrom2 = q.chrom2 AND p.start1 <= q.end1 AND q.start1 <= p.end1 AND p.start2 <= q.end2 AND q.start2 <= p.end2),
r AS (SELECT id AS n, id AS m FROM i UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n) SELECT n AS pair, min(m) AS cluster FROM r GROUP BY n""",
)
def overlap_clusters(spark, d):
    rows = tables.number_rows(v.pairs(spark, d).drop("score").distinct(), "pair")
    return pairs.overlap_clusters(rows.drop("pair").withColumnRenamed("row", "pair"))


@query("row_selection", "SELECT event_id, row FROM (SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS row FROM events) WHERE row IN (SELECT l_partkey FROM lineitem)")
def row_selection(spark, d):
    rows = tables.number_rows(v.table(spark, d, "events").select("event_id"), "event_id")
    picked = v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("row"))
    return tables.select_rows(rows, picked, "event_id")


@query(
    "paste",
    "SELECT event_id, c_custkey FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) FULL JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS n FROM customer) USING (n)",
)
def paste(spark, d):
    a, b = v.table(spark, d, "events").select("event_id"), v.table(spark, d, "customer").select("c_custkey", (-F.col("c_custkey")).alias("o"))
    return tables.paste(a, b, ["event_id"], ["o"]).select("event_id", "c_custkey")


@query("dense_ids", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(dense_rank() OVER (ORDER BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey)) AS BIGINT) AS id FROM lineitem")
def dense_ids(spark, d):
    t = v.table(spark, d, "lineitem").withColumns({"lo": F.least("l_partkey", "l_suppkey"), "hi": F.greatest("l_partkey", "l_suppkey")})
    return stats.dense_ids(t, "lo", "hi").select("l_orderkey", "l_linenumber", "l_partkey", "id")


@query("union_distinct", "SELECT l_partkey AS k FROM lineitem UNION SELECT o_custkey FROM orders")
def union_distinct(spark, d):
    return tables.union_distinct(v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), v.table(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query(
    "with_precedence",
    "SELECT l_orderkey AS k, l_quantity AS x FROM lineitem UNION ALL SELECT o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def with_precedence(spark, d):
    a = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("double").alias("x"))
    b = v.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").cast("double").alias("x"))
    return tables.with_precedence(a, b, ["k"])


@query("coordinate_sort", f"WITH {v.IV} SELECT chrom, s, e, CAST(row_number() OVER (ORDER BY chrom, s, e) AS BIGINT) AS row FROM iv")
def coordinate_sort(spark, d):
    iv = v.intervals(spark, d).select("chrom", "start", "end")
    return _shown(tables.number_rows(tables.coordinate_sort(iv), "chrom", "start", "end"), "row")


@query("class_texts", "SELECT event_id, event_type LIKE '%i%' AS has_i FROM events")
def class_texts(spark, d):
    e = v.table(spark, d, "events").select("event_id", "event_type")
    return reduce(DataFrame.unionByName, [tables.by_class(e, "event_type", ["i"], k).select("event_id", F.lit(k).alias("has_i")) for k in (True, False)])


@query("best_metrics", "SELECT l_partkey AS k, max(l_quantity) AS q, max(l_discount) AS x FROM lineitem GROUP BY 1")
def best_metrics(spark, d):
    return stats.best_metrics(v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("x")), ["k"], "q", "x")


@query(
    "mean_and_members",
    "SELECT k, round(avg(l_quantity), 6) AS mean, string_agg(DISTINCT m, ',' ORDER BY m) AS members FROM (SELECT l_partkey AS k, l_quantity, unnest([l_returnflag, l_linestatus]) AS m FROM lineitem) GROUP BY k",
)
def mean_and_members(spark, d):
    t = v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_quantity", F.concat_ws(",", "l_returnflag", "l_linestatus").alias("m"))
    return stats.mean_and_members(t, ["k"], "l_quantity", "m").withColumn("mean", F.round("mean", 6))


@query("most_common", "SELECT k, arg_min(x, (-n, x)) AS x, max(n) AS n FROM (SELECT l_suppkey AS k, l_linenumber AS x, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY k")
def most_common(spark, d):
    return stats.most_common(v.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("x")), ["k"], "x")


@query("passing_groups", "SELECT count(*) FILTER (WHERE r > 0.05) AS groups FROM (SELECT sum(l_discount) / sum(l_tax + l_discount + 0.5) AS r FROM lineitem GROUP BY l_partkey)")
def passing_groups(spark, d):
    t = v.table(spark, d, "lineitem").select("l_partkey", F.col("l_discount").alias("a"), (F.col("l_tax") + F.col("l_discount") + 0.5).alias("b"))
    return stats.passing_groups(t, ["l_partkey"], "a", "b", 0.05)


@query("sample_support", "SELECT l_partkey AS node, count(DISTINCT l_suppkey) AS support FROM lineitem GROUP BY 1")
def sample_support(spark, d):
    return stats.sample_support(v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("sample")))


@query(
    "continuity",
    f"""WITH {v.IV}, x AS (SELECT name || '|' || chrom AS chrom, s, e FROM iv), {v.merged_sql("x", "m")}, c AS (SELECT split_part(chrom, '|', 1) AS sample, sum(e - s) AS covered FROM m GROUP BY 1),
h AS (SELECT name AS sample, count(DISTINCT chrom) AS contigs, max(e) - min(s) AS span FROM iv GROUP BY 1) SELECT sample, CAST(covered AS BIGINT) AS covered, contigs, span, covered > 1000 AND contigs = 1 AND span <= 100000 AS good FROM c JOIN h USING (sample)""",
)
def continuity(spark, d):
    return stats.continuity(v.intervals(spark, d).withColumnRenamed("name", "sample"), 1000, 100_000)


@query("size_ratio", "SELECT l_orderkey, l_linenumber, l_partkey, least(l_partkey, l_suppkey) / greatest(l_partkey, l_suppkey) AS r FROM lineitem")
def size_ratio(spark, d):
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", seq.size_ratio(F.col("l_partkey"), F.col("l_suppkey")).alias("r"))


@query(
    "region_scores",
    "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_linenumber / 7 * 100) / 100 AS pathratio, floor(least(l_partkey, l_suppkey + 5) / greatest(l_partkey, l_suppkey + 5) * 100) / 100 AS lenratio FROM lineitem",
)
def region_scores(spark, d):
    t = v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").alias("kept_paths"), F.lit(7).alias("all_paths"), F.col("l_partkey").alias("node_len"), F.lit(0).alias("start"), (F.col("l_suppkey") + 5).alias("end")
    )
    return blocks.region_scores(t).select("l_orderkey", "l_linenumber", "l_partkey", "pathratio", "lenratio")


@query(
    "transfer_overhang",
    f"""WITH {v.IV}, {v.PAIRS}, o AS (SELECT p.pair, p.start1, p.end1, p.start2, p.end2, min(b.s) AS bs, max(b.e) AS be FROM pr p LEFT JOIN iv b ON b.chrom = p.chrom1 AND p.start1 < b.e AND b.s < p.end1 GROUP BY ALL)
SELECT pair, greatest(0, start2 - 2 * greatest(0, start1 - coalesce(bs, start1))) AS grown_start, least(5000, end2 + 2 * greatest(0, coalesce(be, end1) - end1)) AS grown_end FROM o""",
)
def transfer_overhang(spark, d):
    lengths = spark.range(10).select(F.col("id").cast("string").alias("chrom"), F.lit(5000).cast("long").alias("length"))
    p = v.pairs(spark, d).drop("score").distinct()
    return intervals.transfer_overhang(p, v.intervals(spark, d), lengths, 2).select("pair", "grown_start", "grown_end")


@query("accepted_pairs", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE 1 - l_discount >= 0.95 AND l_quantity * 100 >= 1000 AND l_tax * 10 >= 0.5")
def accepted_pairs(spark, d):
    t = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (1 - F.col("l_discount")).alias("identity"), (F.col("l_quantity") * 100).alias("align_len"), (F.col("l_tax") * 10).alias("matchindel"))
    return pairs.accepted(t, identity=0.95).select("l_orderkey", "l_linenumber", "l_partkey")


@query("cluster_kinds", "SELECT o_custkey AS cluster, count(*) AS n, CASE WHEN count(*) = 1 THEN 'nointe' WHEN count(*) >= 12 THEN 'large' ELSE 'inte' END AS kind FROM orders GROUP BY 1")
def cluster_kinds(spark, d):
    return clustering.cluster_kind(v.table(spark, d, "orders").select(F.col("o_custkey").alias("cluster")), 12)


@query("representatives", "SELECT o_custkey AS component, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def representatives(spark, d):
    t = v.table(spark, d, "orders").select(F.col("o_custkey").alias("component"), "o_orderkey", "o_totalprice")
    return clustering.representatives(t, "o_orderkey", "o_totalprice").select("component", "o_orderkey")


@query("grouped_components", f"WITH RECURSIVE {_EDGES}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS n, a AS m FROM s UNION SELECT s.b, r.m FROM r JOIN s ON s.a = r.n) SELECT k, coalesce(min(m), k) AS component FROM (SELECT c_custkey * 2 AS k FROM customer) LEFT JOIN r ON r.n = k GROUP BY k")
def grouped_components(spark, d):
    own = v.table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("src"), (F.col("o_orderkey") * 2 + 1).alias("dst"))
    customers = v.table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("k"), "c_custkey")
    chain = customers.where("c_custkey % 7 <> 0").select(F.col("k").alias("src"), (F.col("k") + 2).alias("dst"))
    return clustering.grouped_components(own.unionByName(chain).distinct(), customers.select("k"), "k")


@query("rescale", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(ceil(l_orderkey + l_quantity * l_discount) AS BIGINT) AS at FROM lineitem")
def rescale(spark, d):
    t = v.table(spark, d, "lineitem")
    at = seq.rescale(F.col("l_orderkey"), F.col("l_orderkey") + F.col("l_quantity"), F.col("l_discount"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", at.cast("long").alias("at"))


@query("subsequence", "SELECT doc_id, substr(text, 11, 20) AS half_open, substr(text, 10, 21) AS closed FROM documents")
def subsequence(spark, d):
    at = lambda closed: seq.subsequence(F.col("text"), F.lit(10), F.lit(30), closed)
    return v.table(spark, d, "documents").select("doc_id", at(False).alias("half_open"), at(True).alias("closed"))
