"""Interval pairs: columns chrom1, start1, end1, chrom2, start2, end2 and any others.

Defined cases: a pair with a null in its places overlaps nothing and no filter keeps it, but for those that name it; repeated
pairs count each, except where an operator says distinct; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.components import connected_components
from spanweave.operators.intervals import both_sides_join

SIDE1, SIDE2 = ["chrom1", "start1", "end1"], ["chrom2", "start2", "end2"]


def swap_sides(df: DataFrame) -> DataFrame:
    other = dict(zip(SIDE1 + SIDE2, SIDE2 + SIDE1))
    return df.select(*[F.col(other.get(c, c)).alias(c) for c in df.columns])


def unpivot_sides(df: DataFrame) -> DataFrame:
    """Both intervals of each pair as rows chrom, start, end, with the pair's other columns."""
    ends = [F.struct(*[F.col(f"{c}{k}").alias(c) for c in ("chrom", "start", "end")]) for k in (1, 2)]
    rest = [c for c in df.columns if c not in SIDE1 + SIDE2]
    return df.select(F.explode(F.array(*ends)).alias("_i"), *rest).select("_i.*", *rest)


def canonical_pair(df: DataFrame) -> DataFrame:
    """The smaller interval (chrom, start, end) first."""
    a, b = (F.struct(*[F.col(f"{c}{k}").alias(c) for c in ("chrom", "start", "end")]) for k in (1, 2))
    rows = df.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"), *[c for c in df.columns if c not in SIDE1 + SIDE2])
    return rows.select(*[F.col(f"_{'a' if c[-1] == '1' else 'b'}.{c[:-1]}").alias(c) if c in SIDE1 + SIDE2 else F.col(c) for c in df.columns])


def distinct_unordered(df: DataFrame) -> DataFrame:
    return canonical_pair(df.select(*SIDE1, *SIDE2)).distinct()


def distinct_sorted_fields(df: DataFrame) -> DataFrame:
    """One row for each multiset of the six fields as text; coarser than ``distinct_unordered``."""
    fields = F.array_join(F.array_sort(F.array(*[F.col(c).cast("string") for c in SIDE1 + SIDE2])), "|")
    return df.select(fields.alias("fields")).distinct()


def _touch(s1, e1, s2, e2) -> Column:
    return (F.col(s1) <= F.col(e2)) & (F.col(s2) <= F.col(e1))


def drop_self_overlaps(df: DataFrame) -> DataFrame:
    """Pairs whose sides do not touch each other (closed)."""
    return df.where((F.col("chrom1") != F.col("chrom2")) | ~_touch("start1", "end1", "start2", "end2"))


def overlap_dependent_threshold(df: DataFrame, score: str, apart: float = 0.1, touching: float = 0.6) -> DataFrame:
    """Keep a pair from ``apart`` on if its sides are apart, above ``touching`` if they touch."""
    near = (F.col("chrom1") == F.col("chrom2")) & _touch("start1", "end1", "start2", "end2")
    return df.where(F.when(near, F.col(score) > touching).otherwise(F.col(score) >= apart))


def accepted(df: DataFrame, identity: float = 0.9, length: int = 1000, indel: float = 0.5) -> DataFrame:
    return df.where((F.col("identity") >= identity) & (F.col("align_len") >= length) & (F.col("matchindel") >= indel))


def length_ratio_class(df: DataFrame, both: float = 0.8, either: float = 0.95) -> DataFrame:
    """Adds ``ratio_class``: both, either or none, from the columns reflenratio and quelenratio."""
    a, b = F.col("reflenratio"), F.col("quelenratio")
    return df.withColumn("ratio_class", F.when((a >= both) & (b >= both), "both").when((a >= either) | (b >= either), "either").otherwise("none"))


def pair_overlap(p: DataFrame, q: DataFrame, min_recip: float | None = None, allow_swap: bool = True) -> DataFrame:
    """pair_p, pair_q of pairs (with a column ``pair``) that overlap on both sides, if asked reciprocally, in either orientation. One
    join by bins of both sides."""
    own = ["pair", *SIDE1, *SIDE2]
    turns = q.select(*own)
    if allow_swap:
        turns = turns.unionByName(swap_sides(turns))
    hit = both_sides_join(p.select(*own), turns)
    if min_recip is not None:
        for k in ("1", "2"):
            for side in ("p", "q"):
                hit = hit.where(F.col(f"overlap{k}") >= (F.col(f"end{k}_{side}") - F.col(f"start{k}_{side}")) * min_recip)
    # dealt by one side, which what is counted or joined by it afterwards can go on from
    return hit.select("pair_p", "pair_q").repartition("pair_p").distinct()


def overlap_clusters(df: DataFrame) -> DataFrame:
    """pair, cluster: components of the pairs (id ``pair`` long) that overlap on both sides in the same orientation (closed); the
    cluster of a pair without a partner is its own id."""
    hit = both_sides_join(df.select("pair", *SIDE1, *SIDE2), df.select("pair", *SIDE1, *SIDE2), closed=True).where("pair_p < pair_q")
    found = connected_components(hit, "pair_p", "pair_q").withColumnsRenamed({"node": "pair", "component": "cluster"})
    return df.select("pair").distinct().join(found, "pair", "left").select("pair", F.coalesce("cluster", "pair").alias("cluster"))


def drop_known(p: DataFrame, known: DataFrame, min_recip: float = 0.8) -> DataFrame:
    """Pairs without a reciprocal overlap on both sides with a known pair, in either orientation."""
    hit = pair_overlap(p, known, min_recip).select(F.col("pair_p").alias("pair"))
    return p.join(hit, "pair", "left_anti")


def contained_pairs(df: DataFrame) -> DataFrame:
    """outer, inner: pairs of which one contains the other on both sides (and is not the same)."""
    rows = df.select("pair", *SIDE1, *SIDE2)
    hit = both_sides_join(rows, rows)
    inside = [(F.col(f"start{k}_q") <= F.col(f"start{k}_p")) & (F.col(f"end{k}_p") <= F.col(f"end{k}_q")) for k in ("1", "2")]
    return hit.where(inside[0] & inside[1] & (F.col("pair_p") != F.col("pair_q"))).select(F.col("pair_q").alias("outer"), F.col("pair_p").alias("inner"))


def null_ambiguous(df: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row for each key; the values of a key with several rows are null."""
    one = F.count("*") == 1
    return df.groupBy(*key).agg(one.alias("_one"), *[F.min(v).alias(v) for v in values]).select(
        *key, *[F.when(F.col("_one"), F.col(v)).alias(v) for v in values]
    )


def merge_check(before: DataFrame, after: DataFrame, share: float = 0.95) -> DataFrame:
    """cluster, replaced: whether the merged pairs of a cluster cover ``share`` of its widths on both sides."""
    from spanweave.operators.intervals import union_width

    def widths(df, side, name):
        rows = df.select("cluster", *[F.col(f"{c}{side}").alias(c) for c in ("chrom", "start", "end")])
        return union_width(rows, ["cluster", "chrom"]).groupBy("cluster").agg(F.sum("width").alias(name))

    out = widths(before, 1, "b1").join(widths(before, 2, "b2"), "cluster")
    out = out.join(widths(after, 1, "a1"), "cluster", "left").join(widths(after, 2, "a2"), "cluster", "left")
    good = (F.coalesce("a1", F.lit(0)) >= share * F.col("b1")) & (F.coalesce("a2", F.lit(0)) >= share * F.col("b2"))
    return out.select("cluster", good.alias("replaced"))


def refine_pairs(df: DataFrame, align, seed: int = 0, identity: float = 0.9, length: int = 1000) -> DataFrame:
    """Near-miss pairs (SIDE1, SIDE2, identity, align_len) whose ends are moved about until an aligner is content: adds refined_start1, refined_end1, refined_start2,
    refined_end2, refined_identity. For steps of growing size, up to the length of the pair's alignment, each pattern of moves is tried on
    the pair; the first alignment of at least ``identity`` and ``length`` is taken, one that is no worse than the best so far is
    where the next moves begin. Pairs without success are left out.

    align(chrom1, start1, end1, chrom2, start2, end2) -> (identity, length, start1, end1, start2, end2) or None. The draws of a pair follow
    from ``seed`` and its places."""
    import random

    import pandas as pd

    # fixed values: the steps, and the patterns of moves of the four ends
    steps = [0, 100, 200, 500, 1000, 2000, 3000, 4000, 5000]
    moves = [(-1, 0), (-1, 1), (0, 1), (1, 0), (0, -1), (1, -1)]
    patterns = [(*m, 0, 0) for m in moves] + [(0, 0, *m) for m in moves] + [m + m for m in moves]

    def refined(row) -> tuple | None:
        draw = random.Random(f"{seed}|{[row[c] for c in SIDE1 + SIDE2]}")
        ends, best = [row["start1"], row["end1"], row["start2"], row["end2"]], row["identity"]
        for low, high in zip(steps, steps[1:]):
            if high > row["align_len"]:
                return None
            size = draw.randint(low, high)
            for pattern in patterns:
                s1, e1, s2, e2 = (e + k * size for e, k in zip(ends, pattern))
                if min(s1, s2) < 0 or s1 >= e1 or s2 >= e2:
                    continue
                got = align(row["chrom1"], s1, e1, row["chrom2"], s2, e2)
                if got is None or got[0] < best:
                    continue
                best, ends = got[0], list(got[2:6])
                if got[0] >= identity and got[1] >= length:
                    return (*ends, best)
        return None

    names = ["refined_start1", "refined_end1", "refined_start2", "refined_end2", "refined_identity"]

    def run(frames):
        for pdf in frames:
            found = [refined(row) for row in pdf.to_dict("records")]
            keep = [f is not None for f in found]
            more = pd.DataFrame([f for f in found if f is not None], columns=names, index=pdf.index[keep])
            yield pd.concat([pdf[keep], more], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, schema + "".join(f", {n} {'double' if n.endswith('identity') else 'long'}" for n in names))


def last_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key that comes last in ``order`` (ties: the largest row)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_r")).select(*key, "_r.*")


def first_per_group(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    over = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")
