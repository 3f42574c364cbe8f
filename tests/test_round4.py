"""What a job may cost as its tables grow: shuffles of running values, broadcasts, lists that meet lists."""

import numpy as np

from spanweave.operators import clustering, intervals, ordered, paths


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def made(df, node: str) -> int:
    """The largest number of rows that a node of this kind gives."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if node in p.nodeName():
            most = max(most, p.metrics().apply("numOutputRows").value())
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return most


def test_a_path_meets_one_reference_of_a_node(spark):
    own = spark.createDataFrame([(2 * k + 1, "x") for k in range(60)], "path long, node string")
    ref = spark.createDataFrame([(2 * k, "x", 60 - k) for k in range(60)], "path long, node string, ord int")
    first = ordered.path_share(own, ref)
    assert made(first, "Join") == 60
    assert {tuple(r) for r in first.collect()} == {(2 * k + 1, 118) for k in range(60)}
    taken = paths.consumed_matches(own, ref.withColumnRenamed("ord", "rank"))
    assert made(taken, "Join") == 60
    assert {tuple(r) for r in taken.collect()} == {(118, 2 * k + 1) for k in range(60)}


def test_small_groups_are_not_cut_into_blocks(spark):
    from spanweave.operators.running import keyed

    df = spark.range(20_000).selectExpr("id % 500 as g", "id as pos")
    assert keyed(df, ["g"], "pos").select("_key").distinct().count() <= 1000
    one = keyed(spark.range(200_000).selectExpr("0 as g", "id as pos"), ["g"], "pos").groupBy("_key").count()
    assert one.agg({"count": "max"}).first()[0] <= 4096


def test_a_merge_shuffles_its_rows_once(spark):
    df = spark.range(1000).selectExpr("cast(id % 7 as string) as chrom", "id as start", "id + 3 as end")
    marked = intervals.mark_islands(df, ["chrom"])
    marked.collect()
    plan = plan_of(marked).split("Initial Plan")[0]
    # dealt by block: the rows, and the blocks' totals of either running value; before, rows were dealt again for each join
    assert plan.count("coalesce(chrom") == 0
    assert sum("hashpartitioning(_key" in x and "ReusedExchange" not in x for x in plan.splitlines()) <= 5


def test_runs_of_repeated_values(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(i)) for g, i in zip(rng.integers(0, 3, 300), rng.integers(0, 200, 300))]
    want = set()
    for g in range(3):
        own = sorted({i for h, i in rows if h == g})
        first = own[0]
        for a, b in zip(own, [*own[1:], 10**6]):
            if b != a + 1:
                want.add((g, first, a, a - first + 1))
                first = b
    got = ordered.consecutive_runs(spark.createDataFrame(rows, "k long, i long"), ["k"], "i").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_listed_rows_are_not_broadcast(spark):
    points = spark.range(50).selectExpr("id", "0 as g", "id as x", "id as y")
    assert "Broadcast" not in plan_of(clustering.eps_graph(points, ["g"], ["x", "y"], 2.0))
    w = spark.range(50).selectExpr("'c' as chrom", "id as start", "id + 9 as end")
    assert "Broadcast" not in plan_of(intervals.overlap_join(w, w))


def test_candidates_bring_texts_and_not_sets(spark):
    from pyspark.sql import functions as F

    from spanweave.functions import sequences as seq

    texts = ["abcdefghij" * 3 + "x", "abcdefghij" * 3 + "y", "abcdefghij" * 3 + "x", "0123456789", None, "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "a long, text string")
    grams = seq.char_kmers(F.col("text"), 5)
    out = seq.lsh_pairs(df, "a", grams, least=0.5)
    want = seq.lsh_pairs(df.select("a", grams.alias("s")), "a", "s", least=0.5)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) == [(0, 1, 10 / 12), (0, 2, 1.0), (1, 2, 10 / 12)]


def test_kmers_are_packed_and_not_joined(spark):
    from pyspark.sql import functions as F

    from spanweave.functions import kmers

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("acgt nry"), 3000)) for _ in range(40)] + [None, "ac", "acgtacgt" * 40]
    texts += [texts[3], texts[5][:1500] + texts[6][1500:]]
    df = spark.createDataFrame([(k, None if k == 7 else f"p{k}", t) for k, t in enumerate(texts)], "id long, name string, s string")
    df = df.withColumn("w", F.struct("id", "name"))
    known = kmers.kmer_rows(df.where("id % 2 = 0"), "id", F.col("s"), 9)
    hits = {(r.hi, r.lo) for r in known.collect()}
    want = {}
    for r in kmers.kmer_rows(df, "id", F.col("s"), 9).collect():
        want.setdefault(r.id, []).append((r.hi, r.lo) in hits)
    want = {k: sum(x) / len(x) for k, x in want.items()}
    assert 41 not in want and want[7] < 1
    for key, of in (("id", lambda r: r.id), ("w", lambda r: r.w.id), ("name", lambda r: int((r.name or "p7")[1:]))):
        rows = kmers.kmer_share(kmers.kmer_rows(df, key, F.col("s"), 9), key, known)
        texts_ = kmers.sequence_share(df, key, F.col("s"), 9, df.where("id % 2 = 0"), F.col("s"))
        for got in (rows, texts_):
            assert "Join" not in plan_of(got)
            out = got.collect()
            assert {of(r): r.share for r in out} == want and len(out) == len(want)


def test_neighbours_of_one_root_do_not_meet_in_one_task(spark):
    from pyspark.sql import functions as F

    from spanweave.operators import components

    star = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(30)] + [(7, 5000), (5000, 5001), (9000, 9000)]
    edges = spark.createDataFrame(star, "u long, v long")
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    met = components._with_least(edges, low, 50)
    assert "BroadcastHashJoin" in plan_of(met) and sorted(met.select("u", "v", "m").collect()) == sorted(edges.join(low, "u").select("u", "v", "m").collect())
    for heavy in (3, 1000):
        got = {r.node: r.component for r in components.connected_components(edges, "u", "v", local=0, heavy=heavy).collect()}
        assert got == {**{k: 0 for k in [*range(400), 5000, 5001]}, **{k: 1000 for k in range(1000, 1031)}, 9000: 9000}
