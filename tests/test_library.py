"""Literal rows with answers worked out by hand, and brute-force versions for the custom operators."""

import numpy as np
from pyspark.sql import functions as F
import pytest

from spanweave.functions import sequences as seq
from spanweave.operators import blocks, clustering, intervals, model, motif, ordered, pairs, stats
from spanweave.operators.components import connected_components, local_roots
from spanweave.sources import formats


def iv(spark, rows, more=""):
    return spark.createDataFrame(rows, "chrom string, start long, end long" + more)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_windows(spark):
    got = intervals.make_windows(iv(spark, [("c", 0, 2300), ("d", 5, 5)]))
    assert rows_of(got, "start", "end") == [(0, 1000), (500, 1500), (1000, 2000), (1500, 2300), (2000, 2300)]
    assert rows_of(intervals.make_windows(iv(spark, [("c", 0, 600)]), compat_shift=True), "start", "end") == [(1, 600), (501, 600)]


def test_merge_and_coverage(spark):
    df = iv(spark, [("c", 0, 10), ("c", 5, 20), ("c", 20, 30), ("c", 35, 40)])
    assert rows_of(intervals.merge_intervals(df)) == [("c", 0, 30, 3), ("c", 35, 40, 1)]
    assert rows_of(intervals.merge_intervals(df, max_gap=5)) == [("c", 0, 40, 4)]
    assert rows_of(intervals.coverage(iv(spark, [("c", 0, 50), ("x", 0, 9)]), df), "n", "covered", "length", "fraction") == [(0, 0, 9, 0.0), (4, 35, 50, 0.7)]
    assert intervals.merge_intervals(df.limit(0)).count() == 0


def test_overlap_kinds(spark):
    a, b = iv(spark, [("c", 0, 100)]), iv(spark, [("c", 20, 110)])
    assert intervals.overlap_join(a, b, min_frac_a=0.8, reciprocal=True).count() == 1
    assert intervals.overlap_join(a, b, min_frac_a=0.81).count() == 0
    c = iv(spark, [("c", 100, 120)])
    assert intervals.overlap_join(a, c).count() == 0 and intervals.overlap_join(a, c, closed=True).count() == 1
    cut = iv(spark, [("c", 20, 30), ("c", 50, 60)])
    assert rows_of(intervals.subtract(a, cut)) == [("c", 0, 20), ("c", 30, 50), ("c", 60, 100)]
    assert intervals.subtract(a, cut, whole=True).count() == 0


@pytest.mark.parametrize("closed", [False, True])
def test_overlap_join_is_complete(spark, closed):
    rng = np.random.default_rng(2)
    rows = [(str(rng.integers(2)), int(s := rng.integers(0, 500)), int(s + rng.integers(1, 200))) for _ in range(120)]
    df = iv(spark, rows)
    one = int(closed)
    want = sorted((a, b) for i, a in enumerate(rows) for b in rows if a[0] == b[0] and a[1] < b[2] + one and b[1] < a[2] + one)
    for width in (1, 7, 1000):
        j = intervals.overlap_join(df, df, closed=closed, bin=width)
        assert sorted(((r.chrom, r.start_a, r.end_a), (r.chrom, r.start_b, r.end_b)) for r in j.collect()) == want


def test_pairs(spark):
    cols = "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long, score double"
    df = spark.createDataFrame([("chr1", 100, 200, "chr1", 150, 300, 0.5), ("chr1", 100, 200, "chr2", 150, 300, 0.1), ("chr2", 150, 300, "chr1", 100, 200, 0.05)], cols)
    assert pairs.drop_self_overlaps(df).count() == 2
    assert pairs.distinct_unordered(df).count() == 2
    assert rows_of(pairs.overlap_dependent_threshold(df, "score"), "score") == [(0.1,)]
    amb = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    assert rows_of(pairs.null_ambiguous(amb, ["k"], ["v"])) == [("k1", None), ("k2", 3)]


def test_statistics(spark):
    ent = spark.createDataFrame([("a", x) for x in ("0", "0", "1", ".", "-1")] + [("b", "0")] * 3, "k string, v string")
    got = dict(rows_of(stats.normalized_entropy(ent, ["k"], "v")))
    assert abs(got["a"] - 0.946396) < 1e-5 and got["b"] == 0
    val = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 10)] + [("s", 1.0)], "k string, v double")
    sd = {r.k: (r.sd, r.gini) for r in stats.trimmed_stats(val, ["k"], "v").collect()}
    assert sd["a"][0] == 1.0 and abs(sd["a"][1] - 0.148148) < 1e-6 and sd["s"] == (None, None)
    var = spark.createDataFrame([("c", 0, 1000, 100, 103, 3, 1), ("c", 0, 1000, 500, 501, 1, 4)], "chrom string, wstart long, wend long, vstart long, vend long, ref_len long, alt_len long")
    sim = stats.window_similarity(var).first()
    assert (sim.uniq, sim.match, sim.alignlen) == (6, 995, 7) and abs(sim.sim - 0.993014) < 1e-6
    two = spark.createDataFrame([(True, True)] * 73 + [(True, False)] * 271 + [(False, True)] * 56 + [(False, False)] * 116, "e boolean, c boolean")
    from pyspark.sql import functions as F

    assert abs(stats.odds_ratio(two, F.col("e"), F.col("c")).first().odds_ratio - 0.557986) < 1e-6


def test_enrichment(spark):
    targets = iv(spark, [("c", 0, 10, "A"), ("c", 20, 30, "B")], ", name string")
    observed = iv(spark, [("c", 0, 10)])
    shuffled = spark.createDataFrame([(1, "c", 0, 30), (2, "c", 50, 60), (3, "c", 18, 29)], "shuffle_id int, chrom string, start long, end long")
    assert rows_of(stats.enrichment(targets, observed, shuffled, 0.8)) == [(1, 3, 0.75)]


def test_ordered(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 5, 25, 46)], "k string, p long")
    assert [r.island for r in ordered.islands_1d(df, ["k"], "p", 20).orderBy("p").collect()] == [0, 0, 0, 1]
    share = spark.createDataFrame([("a", n, w) for n, w in (("w", 0.5), ("x", 0.3), ("y", 0.15), ("z", 0.05))], "k string, node string, w double")
    assert rows_of(ordered.cumulative_share(share, ["k"], "w", "node"), "node") == [("w",), ("x",), ("y",)]
    points = spark.createDataFrame([("c", p) for p in (0, 10, 25, 40)], "chrom string, pos long")
    assert rows_of(ordered.asof_both(points, iv(spark, [("c", 12, 30), ("c", 0, 30)])), "start", "left", "right") == [(12, 10, 40)]
    hap = spark.createDataFrame([("s", k, x[0], x[1]) for k, x in enumerate(["A+", "B+", "C+", "B-", "C+", "A-"])], "s string, o int, l string, d string")
    assert rows_of(ordered.haplotype_string(hap, ["s"], "o", "l", "d"), "string") == [("ABCbCa",)]
    nodes = spark.createDataFrame([("g", "A", n, w) for n, w in ((1, 10), (2, 20), (3, 5))] + [("g", "B", n, w) for n, w in ((2, 20), (3, 5), (4, 30))], "group string, path string, node int, len int")
    assert abs(ordered.weighted_overlap(nodes).first().ratio - 25 / 55) < 1e-9


def test_sequences(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("ACGTN", "ACGTAC", "chr-1:x:5-9", "DP=1;AT=>1>2;X=3")], "a string, b string, r string, i string").select(
        seq.revcomp(F.col("a")).alias("rc"), seq.canonical_kmers(F.col("b"), 3).alias("k"), seq.parse_region(F.col("r")).alias("p"), seq.info_value(F.col("i"), "AT").alias("at"), seq.max_allele_length(F.lit("A,ACG")).alias("m")
    ).first()
    assert row.rc == "NACGT" and sorted(row.k) == ["acg", "gta"] and tuple(row.p) == ("chr-1:x", 5, 9) and row["at"] == ">1>2" and row.m == 3
    sets = spark.createDataFrame([(list("abcd"), list("abef"), list("ace"))], "w array<string>, s array<string>, d array<string>")
    assert tuple(sets.select(*seq.three_way(F.col("w"), F.col("s"), F.col("d"))).first()) == (0.25, 0.5, 0.5)
    sims = spark.createDataFrame([(None, None), (None, 0.3), (0.8, 0.5)], "a double, b double").select(seq.combined_similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in sims] == [None, 0.3, 1.0]
    starts = spark.createDataFrame([("12", 100), ("34", 200)], "node string, start long")
    got = seq.bubble_interval("id", starts, spark.createDataFrame([(">12>34",)], "id string")).first()
    assert (got.start, got.end) == (100, 200)
    docs = spark.createDataFrame([(1, list("abcdefgh")), (2, list("abcdefgx")), (3, list("qrst")), (4, [])], "k long, s array<string>")
    assert rows_of(seq.lsh_pairs(docs, "k", "s", least=0.5), "a", "b") == [(1, 2)]
    rng = np.random.default_rng(1)
    sets = [[int(x) for x in rng.choice(60, 20, replace=False)] for _ in range(60)] + [[1, 2, 3], [1, 2, 3], []]
    df = spark.createDataFrame([(k, [f"x{i}" for i in x]) for k, x in enumerate(sets)], "k int, s array<string>")
    for least in (0.1, 0.3, 0.6):
        jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
        want = [(a, b) for a in range(63) for b in range(a + 1, 63) if sets[a] and sets[b] and jac(sets[a], sets[b]) >= least]
        assert rows_of(seq.lsh_pairs(df, "k", "s", least=least), "a", "b") == want


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9), (None, 4)], "src long, dst long")
    assert rows_of(connected_components(edges)) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (9, 9)]
    assert connected_components(edges.limit(0)).count() == 0
    node, root = local_roots(np.arange(50), np.arange(1, 51))
    assert (root == 0).all() and len(node) == 51


def test_components_of_all_rows(spark, tmp_path):
    from spanweave.plans.queries import QUERIES

    rng = np.random.default_rng(6)
    keys = [(int(p), int(o)) for p, o in zip(rng.integers(1, 300, 400), rng.integers(1, 300, 400))] + [(2_000_000, 1), (1_000_001, 999), (None, 5)]
    rows = [(p, o, float(k % 50 + 1), k % 11 / 100) for k, (p, o) in enumerate(keys)]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for p, o in keys:
        if p is not None:
            a, b = find(2 * p), find(2 * o + 1)
            root[max(a, b)] = min(a, b)
    got = rows_of(QUERIES["components_all"](spark, str(tmp_path)), "node", "component")
    assert got == sorted((x, find(x)) for x in root) and len({c for _, c in got}) < len(got) / 4


def test_clusters(spark):
    df = spark.createDataFrame([("c", 0, 100), ("c", 5, 100), ("c", 90, 200)], "chrom string, start long, end long")
    assert rows_of(clustering.greedy_dedup(df, ["chrom"])) == [("c", 0, 100), ("c", 90, 200)]
    pts = spark.createDataFrame([(1, 0, 0), (2, 3, 4), (3, 9, 9), (4, 3, 9)], "id long, x long, y long").selectExpr("*", "'g' as g")
    assert dict(rows_of(clustering.eps_clusters(pts, ["g"], ["x", "y"], 5.0), "id", "cluster")) == {1: 1, 2: 1, 3: 3, 4: 1}


def test_model(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([([0.0, 0.0],)], "z array<double>").select(model.soft_assign(F.col("z"), [[0.0, 0.0], [1.0, 0.0]]).alias("q")).first()
    assert abs(row.q[0] - 2 / 3) < 1e-9 and abs(row.q[1] - 1 / 3) < 1e-9
    q = spark.createDataFrame([([0.0] * 5 + [1.0, 0.0, 0.0],)], "q array<double>").select(model.argmax_label(F.col("q"), model.LABELS)).first()
    assert q[0] == "CC2"
    df = spark.createDataFrame([([1.0, -2.0],), ([0.5, 3.0],)], "x array<double>")
    w = [(np.array([[1.0, -1], [2, 0]]), np.array([0.0, 1])), (np.array([[1.0], [3]]), np.array([0.5]))]
    want = [float((np.maximum(np.array(r.x) @ w[0][0] + w[0][1], 0) @ w[1][0] + w[1][1])[0]) for r in df.collect()]
    assert [r.z[0] for r in model.encode(df, "x", w).collect()] == want


def test_formats(spark, tmp_path):
    paf = "chr1:101-600\t500\t0\t159\t+\tchr2:1-900\t900\t10\t168\t150\t158\t60\tcg:Z:100=2X5I50=1X"
    self_hit = "chr1:1-9\t9\t0\t9\t+\tchr1:1-9\t9\t0\t9\t9\t9\t60\tcg:Z:9="
    got = formats.parse_paf(spark.createDataFrame([(paf,), (self_hit,)], "value string")).collect()
    assert len(got) == 1 and (got[0].mismatch_base, round(got[0].identity, 6), round(got[0].matchindel, 6)) == (3, 0.980392, 0.949367)
    assert (got[0].que_start, got[0].ref_start, got[0].ref_chr) == (100, 10, "chr2")
    (tmp_path / "g.gfa").write_text("S\t12\tACG\tSN:Z:x\nS\t13\tTT\nW\ts1\t0\tctg\t5\t10\t>12<13\n")
    assert rows_of(formats.read_segments(spark, str(tmp_path / "g.gfa")), "node", "len") == [("12", 3), ("13", 2)]
    assert rows_of(formats.read_walks(spark, str(tmp_path / "g.gfa")), "sample", "ord", "orient", "node") == [("s1", 0, ">", "12"), ("s1", 1, "<", "13")]
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\nc\t7\t>1>2\tA\tC\t.\t.\t.\tGT\t1\t.\nc\t9\t>2>3\tA\tC\t.\t.\t.\tGT\t-1\t0\n")
    melted = formats.melt_genotypes(formats.read_vcf(spark, str(tmp_path / "v.vcf")))
    assert rows_of(melted.na.fill(-9), "POS", "sample", "gt", "status") == [(7, "a", 1, "CALLED"), (7, "b", -9, "MISSING"), (9, "a", -1, "ABSENT"), (9, "b", 0, "CALLED")]
    (tmp_path / "f.fa").write_text(">c1 x\nACGT\nAC\n>c2\nTTTT\n")
    fasta = formats.read_fasta(spark, str(tmp_path / "f.fa"))
    assert rows_of(fasta) == [("c1", "ACGTAC"), ("c2", "TTTT")]
    assert rows_of(formats.mask_sequences(fasta, iv(spark, [("c1", 1, 3), ("c1", 2, 4)]))) == [("c1", "ANNNAC"), ("c2", "TTTT")]
    (tmp_path / "t.dat").write_text("@chrA desc\n5 20 3 5.0 3 100 0 30 1 2 3 4 1.5 ACG ACGACG\n@chrB\n1 9 2 4 2 90 0 20 1 1 1 1 1.0 AT ATAT\n")
    assert rows_of(formats.read_trf(spark, str(tmp_path / "t.dat")), "chrom", "start", "end", "Motif") == [("chrA", 4, 20, "ACG"), ("chrB", 0, 9, "AT")]
    (tmp_path / "r.out").write_text("   SW perc\nscore\n\n 463 1.3 0.6 1.7 chr1 10 50 (9) + L1 LINE/L1 1 2 3 1\n 20 1 1 1 chr1 60 70 (9) C (A)n Simple_repeat 1 2 3 2\n")
    assert rows_of(formats.read_repeats(spark, str(tmp_path / "r.out")), "chrom", "start", "end", "kind") == [("chr1", 9, 50, "LINE/L1")]
    formats.write_table(iv(spark, [("c", 1, 2)]), str(tmp_path / "out"), by=["chrom"], header=False)
    assert spark.read.csv(str(tmp_path / "out" / "chrom=c"), sep="\t").count() == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_motifs(spark):
    rng = np.random.default_rng(4)
    for _ in range(15):
        m, t = ("".join(rng.choice(list("ACGT"), n)) for n in (rng.integers(2, 6), rng.integers(3, 14)))
        want = [min(edits(m, t[k:e]) for k in range(e + 1)) for e in range(len(t) + 1)]
        assert motif.infix_distances(m, t).tolist() == want
        d, places = motif.best_hits(m, t)
        s, e = places[0] if places else (0, 0)
        assert d == min(want) and edits(m, t[s:e]) == d
    assert motif.copy_number("ACGTC", "TT" + "ACGTC" * 4 + "GG")[0] == 4
    assert motif.oriented_copy_number("AACCC", "GGGTT" * 3)["strand"] == "-"
    assert motif.purity([(0, 5), (5, 10)]) == 1.0 and motif.purity([(0, 6), (4, 10)]) == 0.8 and motif.copy_number("ACG", "") == (0, 0, 0)
    df = spark.createDataFrame([("ACGTC", "ACGTC" * 3), (None, "A"), ("A", None)], "m string, s string")
    assert [r.copies for r in motif.with_copy_number(df, "m", "s").collect()] == [3, 0, 0]


def test_blocks(spark):
    paths = {"p": ["1", "2", "3", "4"], "q": ["1", "2", "4"], "r": ["4", "2", "1"]}
    rows = [("g", p, k, n, 300 if n != "3" else 250) for p, nodes in paths.items() for k, n in enumerate(nodes)]
    df = spark.createDataFrame(rows, "region string, path string, ord int, node string, len long")
    assert rows_of(blocks.collinear_runs(df), "node", "run", "place") == [("1", "1", 0), ("2", "1", 1), ("3", "3", 0), ("4", "4", 0)]
    got = blocks.region_blocks(df).first()
    assert (got.blocks, got.kept_len, got.total_len, got.poly) == (2, 900, 1150, 1)
    assert blocks.anchor_pair(df, edge=1).first().paths >= 1
    runs = spark.createDataFrame([("p", 0, 5, 0), ("p", 1, 30, None), ("p", 2, 5, 5), ("p", 3, 2, None), ("p", 4, 5, 100)], "path string, ord int, len long, ref_pos long")
    assert rows_of(blocks.structural_runs(runs), "kind", "first", "left_end", "right_pos", "inserted", "deleted") == [("INS", 1, 5, 5, 30, 0), ("INS", 3, 10, 100, 2, 0)]
    gone = spark.createDataFrame([("p", k, 10, x) for k, x in enumerate([0, 15, 60, 400, None])], "path string, ord int, len long, ref_pos long")
    assert rows_of(blocks.structural_runs(gone), "kind", "first", "last", "left_end", "right_pos", "deleted") == [("DEL", 0, 3, 25, 60, 35), ("DEL", 0, 3, 70, 400, 330), ("INS", 4, 4, 410, None, 0)]


def test_overlap_join_with_nulls(spark):
    a = iv(spark, [("c", 0, 10, None), ("c", 50, 60, "x"), ("c", 90, 95, None), (None, 0, 10, "n"), ("c", None, 10, "n")], ", name string")
    b = iv(spark, [("c", 5, 20, None), ("c", 55, 58, None)], ", name string")
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]), str(r[3]))
    assert sorted(map(tuple, intervals.overlap_join(a, b, "semi").collect()), key=key) == [("c", 0, 10, None), ("c", 50, 60, "x")]
    anti = sorted(map(tuple, intervals.overlap_join(a, b, "anti").collect()), key=key)
    assert anti == sorted([("c", 90, 95, None), (None, 0, 10, "n"), ("c", None, 10, "n")], key=key)
    left = intervals.overlap_join(a, b, "left").collect()
    assert len(left) == 5 and sum(r.start_b is not None for r in left) == 2


def test_overlap_join_of_very_different_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [("c", int(s), int(s + 10 ** rng.integers(0, 6) + rng.integers(0, 5))) for s in rng.integers(0, 10**6, 250)] + [("c", 0, 10**7), ("c", 5, 5)]
    other = [("c", int(s), int(s + 2 ** rng.integers(0, 20))) for s in rng.integers(0, 10**6, 200)]
    a, b = iv(spark, rows), iv(spark, other)
    got = sorted((r.start_a, r.end_a, r.start_b, r.end_b) for r in intervals.overlap_join(a, b).collect())
    assert got == sorted((x[1], x[2], y[1], y[2]) for x in rows for y in other if x[1] < y[2] and y[1] < x[2])
    listed = intervals._listed(a, "start", "end", intervals.levels_of(a), intervals.levels_of(b), True, intervals.SMALLEST, False)
    assert listed.count() <= 3 * intervals.MOST_LEVELS * len(rows)


def test_components_do_not_stop_early(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long").repartition(8)
    assert connected_components(chain, local=0).select("component").distinct().count() == 1
    assert connected_components(chain).select("component").distinct().count() == 1
    with pytest.raises(RuntimeError):
        connected_components(chain.repartition(60), max_iter=0, local=0)


def test_running_equals_one_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from spanweave.operators.running import in_blocks, running

    rng = np.random.default_rng(5)
    rows = [(None if k % 9 == 0 else str(k % 3), int(x), k, None if k % 4 == 0 else int(y)) for k, (x, y) in enumerate(rng.integers(0, 500, (300, 2)))]
    df = spark.createDataFrame(rows, "g string, pos long, k long, v long")
    for kind, f in (("max", F.max), ("sum", F.sum), ("last", lambda c: F.last(c, True))):
        for inclusive in (True, False):
            for reverse in (True, False):
                order = [F.desc(c) if reverse else F.asc(c) for c in ("pos", "k")]
                over = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
                want = {r.k: r.w for r in df.select("k", f("v").over(over).alias("w")).collect()}
                got = running(in_blocks(df, "pos", 37), ["g"], ["pos", "k"], "w", F.col("v"), kind, inclusive, reverse)
                assert {r.k: r.w for r in got.collect()} == want


def test_carried_hulls(spark):
    rng = np.random.default_rng(6)
    rows = sorted((str(c), int(s), int(s + n), int(s - a), int(s + n + b)) for c, s, n, a, b in zip(rng.integers(0, 2, 120), rng.integers(100, 3000, 120), rng.integers(1, 60, 120), rng.integers(0, 90, 120), rng.integers(0, 90, 120)))
    want, low, high, chrom = [], 0, 0, None
    for c, s, e, a, b in rows:
        if c != chrom:
            low = high = None
            chrom = c
        inside = low is not None and s > low and e < high
        low, high = (low, high) if inside else (a, b)
        want.append((c, s, e, low, high, inside))
    df = spark.createDataFrame(rows, "chrom string, start long, end long, hull_start long, hull_end long").repartition(5)
    for block in (4096, 16, 3):
        assert rows_of(intervals.carry_hulls(df, block)) == sorted(want)
    # nested hulls, one run over all blocks: each window's hull ends a little before the one around it
    deep = [("d", k, k + 1, -1 if k % 3 else k, 900 - 2 * k) for k in range(300)] + [("d", 700 + k, 700 + k + k % 5, 0, 10**9 if k == 40 else 705 + k) for k in range(90)]
    want, low, high = [], None, None
    for c, s, e, a, b in sorted(deep):
        inside = low is not None and s > low and e < high
        low, high = (low, high) if inside else (a, b)
        want.append((c, s, e, low, high, inside))
    nested = spark.createDataFrame(deep, "chrom string, start long, end long, hull_start long, hull_end long")
    assert rows_of(intervals.carry_hulls(nested, 7)) == sorted(want) and rows_of(intervals.carry_hulls(nested)) == sorted(want)
    assert any(w[-1] for w in want) and intervals.carry_hulls(df.limit(0)).count() == 0


def test_paths(spark):
    from spanweave.operators import paths

    steps = spark.createDataFrame([(1, 0, ">", "a"), (1, 1, "<", "b"), (1, 2, ">", "00000"), (2, 0, "<", "zz")], "path int, ord int, orient string, node string")
    nodes = spark.createDataFrame([("a", "AAC"), ("b", "GGT")], "node string, seq string")
    assert rows_of(paths.oriented_sequences(steps, nodes)) == [(1, "AAC" + "ACC" + "N" * 21), (2, "")]
    rows = [(0, k, t) for k, t in enumerate([">1>2", ">4>5", ">2>3", ">3>4"])] + [(1, 0, ">1>2"), (1, 1, ">7"), (2, 0, ""), (2, 1, None)]
    got = paths.chained_traversals(spark.createDataFrame(rows, "group int, ord int, traversal string"))
    assert rows_of(got) == [(0, 0, ">1>2>3>4>5"), (1, 0, ">1>2"), (1, 1, ">7")]
    ref = ">1>12>3>4>5>6"
    gts = {"r": "000", "h": "100", "m": "0..", "u": "...", "b": "110"}
    alleles = [(0, 0, ">1>12"), (0, 1, ">1>9"), (1, 0, ">3>4"), (1, 1, ">3<8>4"), (2, 0, ">4>5>6"), (2, 1, ">4>6")]
    geno = spark.createDataFrame([(g, v, x) for g, t in gts.items() for v, x in enumerate(t)], "group string, variant int, gt string")
    from pyspark.sql import functions as F

    got = paths.haplotype_paths(geno, spark.createDataFrame(alleles, "variant int, allele int, traversal string"), F.lit(ref), most_missing=0.7)
    assert dict((r.group, (r.status, r.path)) for r in got.collect()) == {
        "r": ("known", ref), "h": ("known", ">1>9>3>4>5>6"), "m": ("known", ">1>12>00000"), "u": ("unknown", None), "b": ("known", ">1>9>3<8>4>5>6"),
    }
    # the sample has the region's middle reversed, and another place far off
    line = spark.createDataFrame([("r", k, ">", f"n{k}", 10 * k + 1, 10 * k + 10) for k in range(10)], "path string, ord int, orient string, node string, pos_s long, pos_e long")
    region = spark.createDataFrame([("x", "r", 16, 45)], "region string, path string, start long, end long")
    placed = [("s", "c", "n1", 100, 110, ">"), ("s", "c", "n2", 110, 120, "<"), ("s", "c", "n3", 120, 130, ">"), ("s", "c", "n4", 130, 140, "<"), ("s", "c", "n2", 900, 910, ">"), ("t", "c", "n3", 5, 15, "<")]
    got = paths.project_regions(region, line, spark.createDataFrame(placed, "sample string, chrom string, node string, start long, end long, orient string"))
    assert [(r.sample, r.start, r.end, round(r.ratio, 4), round(r.share, 4)) for r in got.orderBy("sample").collect()] == [("s", 105, 140, round(30 / 35, 4), 1.0), ("t", 5, 15, round(1 / 3, 4), round(1 / 3, 4))]
    same = spark.createDataFrame([(3, "a", 5), (1, "a", 5), (2, "b", 5)], "path int, first_node string, len int")
    assert rows_of(paths.drop_repeated_paths(same)) == [(1, 1), (2, 2), (3, 1)]


def test_motif_growth():
    assert motif.best_hits("ACG", "TACGTACG") == (0, [(1, 4), (5, 8)])
    assert motif.grown_chain([(0, 10), (10, 20), (25, 35)], 10) == [(0, 10), (10, 20), (25, 35)]
    assert motif.grown_chain([(0, 10), (10, 20), (90, 100)], 10) == [(0, 10), (10, 20)]
    assert motif.non_redundant([(5, 0, 10), (4, 1, 10), (3, 5, 20), (5, 30, 40)]) == [(5, 30, 40), (5, 0, 10), (3, 5, 20)]


def test_refinement(spark):
    from spanweave.operators import pairs

    def align(c1, s1, e1, c2, s2, e2):
        return (0.95, 1500, s1, e1, s2, e2) if s1 < 4000 else (0.8, 1500, s1, e1, s2, e2)

    df = spark.createDataFrame([("a", 4050, 6000, "b", 5000, 7000, 0.7, 2000), ("a", 9000, 9500, "b", 5000, 7000, 0.7, 50)], "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long, identity double, align_len long")
    got = pairs.refine_pairs(df, align).collect()
    assert len(got) == 1 and got[0].refined_start1 < 4000 and got[0].refined_identity == 0.95
    assert [tuple(r) for r in pairs.refine_pairs(df, align).collect()] == [tuple(r) for r in got]


def test_tables(spark):
    from spanweave.operators import stats, tables

    a = spark.createDataFrame([(k * 7 % 11, f"v{k}") for k in range(11)], "o int, v string").repartition(4)
    assert [(r.o, r.row) for r in tables.number_rows(a, "o").orderBy("row").collect()] == [(k, k + 1) for k in range(11)]
    b = spark.createDataFrame([(9, "x"), (5, "y")], "p int, w string")
    assert rows_of(tables.paste(a.where("o < 3"), b, ["o"], ["p"]), "o", "w") == [(0, "y"), (1, "x"), (2, None)]
    assert rows_of(tables.with_precedence(b, spark.createDataFrame([(9, "z"), (1, "q"), (None, "n")], "p int, w string").where("p is not null"), ["p"])) == [(1, "q"), (5, "y"), (9, "x")]
    assert rows_of(stats.most_common(spark.createDataFrame([("g", 2), ("g", 1), ("g", 1), ("g", 2), ("h", None)], "k string, x int"), ["k"], "x")) == [("g", 1, 2)]


def test_greedy_dedup_by_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = sorted({("c", int(s), int(s + n)) for s, n in zip(rng.integers(0, 200, 80), rng.integers(5, 80, 80))})
    kept = []
    for r in sorted(rows, key=lambda r: (r[1] - r[2], *r)):
        if not any(max(0, min(r[2], k[2]) - max(r[1], k[1]) + 1) / min(r[2] - r[1] + 1, k[2] - k[1] + 1) >= 0.9 for k in kept):
            kept.append(r)
    df = spark.createDataFrame([(*r, 1) for r in [*rows, *rows[:9], (None, 1, 2)]], "chrom string, start long, end long, g int")
    assert rows_of(clustering.greedy_dedup(df, ["g"]), "chrom", "start", "end") == sorted(kept)
    # many rounds: windows of equal length, of which every other one goes
    line = spark.createDataFrame([("c", 5 * k, 5 * k + 99, None) for k in range(60)], "chrom string, start long, end long, g int")
    whole = clustering.greedy_dedup(line, ["g"], thr=0.95)
    assert rows_of(whole, "start") == [(10 * k,) for k in range(30)]
    edges = [(int(a), int(b)) for a, b in np.sort(rng.integers(0, 60, (150, 2)), 1) if a < b]
    gone = set()
    for x in range(60):
        gone |= {x} if any(b == x and a not in gone for a, b in edges) else set()
    table = spark.createDataFrame(edges, "a long, b long")
    for local in (0, 10**6):
        assert {r.id for r in clustering.first_independent(table, local=local).collect()} == gone
    two = sorted({(c, int(s), int(s + n), d, int(t), int(t + m)) for c, s, n, d, t, m in zip(rng.choice(["x", "y"], 90), rng.integers(0, 40, 90), rng.integers(20, 60, 90), rng.choice(["x", "y"], 90), rng.integers(0, 40, 90), rng.integers(20, 60, 90))})
    part = lambda a, b: max(0, min(a[2], b[2]) - max(a[1], b[1]) + 1) / min(a[2] - a[1] + 1, b[2] - b[1] + 1) if a[0] == b[0] else 0
    kept = []
    for r in sorted(two, key=lambda r: (r[1] - r[2] + r[4] - r[5], *r)):
        if not any(all(max(part(side, k[:3]), part(side, k[3:])) >= 0.7 for side in (r[:3], r[3:])) for k in kept):
            kept.append(r)
    df = spark.createDataFrame(two, "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long").withColumn("g", F.lit(None).cast("int"))
    assert rows_of(clustering.greedy_dedup(df, ["g"], 2, 0.7), "chrom1", "start1", "end1", "chrom2", "start2", "end2") == sorted(kept) and len(kept) < len(two)


def test_subtract_ignores_empty_rows(spark):
    a = spark.createDataFrame([("c", 0, 10)], "chrom string, start long, end long")
    b = spark.createDataFrame([("c", 5, 5), ("c", 7, 8)], "chrom string, start long, end long")
    assert rows_of(intervals.subtract(a, b)) == [("c", 0, 7), ("c", 8, 10)]


def test_eps_clusters_in_four_axes_are_split_again(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 3, (60, 4)) for c in (0, 40, 500)])
    df = spark.createDataFrame([(k, "g", *map(float, v)) for k, v in enumerate(x)], "id long, g string, a double, b double, c double, d double")
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))

    def parts(members, eps):
        left, out = set(members), []
        while left:
            stack = [left.pop()]
            own = set(stack)
            while stack:
                i = stack.pop()
                more = {j for j in left if near[i, j] <= eps}
                left -= more
                own |= more
                stack += more
            out.append(own)
        return out

    want = sorted(min(p) for q in parts(range(180), 90.0) for p in (parts(q, 25.0) if len(q) > 100 else [q]))
    got = clustering.eps_clusters(df, ["g"], ["a", "b", "c", "d"], 90.0, ((100, 25.0),))
    assert sorted({r.cluster for r in got.collect()}) == want and len(want) == 3
