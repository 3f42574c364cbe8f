"""Literal rows for the small functions and sinks."""

from pyspark.sql import functions as F

from spanweave.functions import sequences as seq
from spanweave.operators import model, motif, pairs
from spanweave.sources import formats


def rows_of(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_readers(spark, tmp_path):
    (tmp_path / "a.bed").write_text("c\t1\t9\tx\nd\t3\tbad\ty\n")
    assert rows_of(formats.read_bed(spark, str(tmp_path / "a.bed"), "name string").na.fill(-1)) == [("c", 1, 9, "x"), ("d", 3, -1, "y")]
    (tmp_path / "a.fai").write_text("c1\t1000\t4\t60\t61\nc2\t7\t1030\t60\t61\n")
    assert rows_of(formats.read_lengths(spark, str(tmp_path / "a.fai"))) == [("c1", 1000), ("c2", 7)]
    assert rows_of(formats.sequence_lengths(spark.createDataFrame([("a", "ACG"), ("b", "")], "name string, seq string"))) == [("a", 3), ("b", 0)]
    tags = [("1", ["SN:Z:ref#0#chr1:1,010-1,025", "x"]), ("2", ["other#0#chr1:5-6"]), ("3", []), ("4", ["ref#0#chrX:1-2", "ref#0#chr2:7-9"])]
    placed = formats.segment_positions(spark.createDataFrame(tags, "node string, tags array<string>"), "ref")
    assert rows_of(placed) == [("chr1", 1010, 1025, "1", ">"), ("chr2", 7, 9, "4", ">"), ("chrX", 1, 2, "4", ">")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 3, "x", 0), ("a", 5, 6, "y", 0), ("a", 1, 2, "z", 0)], "chrom string, start long, end long, name string, more int")
    formats.write_annotation(df, f"{tmp_path}/out", ["chrom", "start", "end", "name"])
    lines = [x for p in sorted((tmp_path / "out").glob("*.csv")) for x in p.read_text().splitlines()]
    assert [x for x in lines if x != "chrom\tstart\tend\tname"] == ["a\t1\t2\tz", "a\t5\t6\ty", "b\t2\t3\tx"]


def test_tables_by_node_join_without_a_shuffle(spark, tmp_path):
    walks = spark.createDataFrame([(f"s{i % 3}", i, f"n{i % 17}") for i in range(200)], "sample string, ord int, node string")
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(17)], "node string, len int")
    formats.save_by_node(walks, "walks_by_node", 4, ["sample"], f"{tmp_path}/walks")
    formats.save_by_node(nodes, "nodes_by_node", 4, path=f"{tmp_path}/nodes")
    joined = spark.table("walks_by_node").hint("merge").join(spark.table("nodes_by_node"), "node")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert rows_of(joined, "sample", "ord", "len") == sorted((f"s{i % 3}", i, i % 17) for i in range(200))
    one = spark.table("walks_by_node").where("sample = 's1'")
    assert one.count() == 67 and "PartitionFilters: [isnotnull(sample" in one._jdf.queryExecution().executedPlan().toString()
    for name in ("walks_by_node", "nodes_by_node"):
        spark.sql(f"DROP TABLE {name}")


def test_candidates_and_merges(spark):
    calls = spark.createDataFrame([(7, 101, 3.0), (6, 500, 9.0), (7, 100, 3.0), (7, 10_000, 3.0), (7, 9_999, 2.9), (50, 9_999, 3.0)], "cons int, len int, copies double")
    assert [r[0] for r in calls.select(motif.is_candidate(F.col("cons"), F.col("len"), F.col("copies"))).collect()] == [True, False, False, False, False, True]
    columns = "cluster int, chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long"
    before = spark.createDataFrame([(1, "a", 0, 100, "b", 0, 100), (1, "a", 50, 200, "b", 100, 200), (2, "a", 0, 100, "b", 0, 100), (3, "a", 0, 10, "b", 0, 10)], columns)
    after = spark.createDataFrame([(1, "a", 0, 195, "b", 5, 200), (2, "a", 0, 100, "b", 0, 94)], columns)
    assert rows_of(pairs.merge_check(before, after)) == [(1, True), (2, False), (3, False)]


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 4.0], 0.75, 0.5)], "v array<double>, sim double, entropy double")
    got = df.select(model.scale(F.col("v"), [0.0, 2.0], [2.0, 4.0]), model.vscore(F.col("sim"), F.col("entropy"))).first()
    assert tuple(got) == ([0.5, 0.5], 0.75)
    base = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "id int, sd_max double")
    tables = [spark.createDataFrame([(1, 1.0), (2, None)], f"id int, {name} double") for name in ("sd_var", "sim_bubble", "com_bubble", "Vscore", "TEgini")]
    assert rows_of(model.assemble(base, tables, ["id"])) == [(1, 10.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    assert model.assemble(base, tables, ["id"], drop_null=False).count() == 3
    sigs = spark.createDataFrame([([1, 2, 3, 4], [1, 9, 3, 4])], "a array<long>, b array<long>")
    assert sigs.select(seq.estimated_jaccard(F.col("a"), F.col("b"))).first()[0] == 0.75
    sets = spark.createDataFrame([([f"x{i}" for i in range(80)], [f"x{i}" for i in range(40, 120)])], "a array<string>, b array<string>")
    near = sets.select(seq.estimated_jaccard(seq.minhash(F.col("a"), 256), seq.minhash(F.col("b"), 256))).first()[0]
    assert abs(near - 1 / 3) < 0.12
    hashed = spark.createDataFrame([("ACGTN", "NACGT")], "a string, b string").select(seq.hash_canonical(F.col("a"), 3).alias("a"), seq.hash_canonical(F.col("b"), 3).alias("b")).first()
    assert set(hashed.a) == set(hashed.b) and len(hashed.a) == 1  # acg and cgt are one another's complements


def test_motif_columns(spark):
    df = spark.createDataFrame([("ACG", "TACGTACG", "ACGACG", "ACGTT"), (None, None, None, None)], "m string, b string, c string, a string")
    got = motif.with_best_places(df, "m", "b").collect()
    assert got[0].edits == 0 and [tuple(p) for p in got[0].places] == [(1, 4), (5, 8)] and (got[1].edits, got[1].places) == (0, [])
    wide = motif.with_flanks(df, "m", "b", "c", "a").collect()
    # the core has two copies, and with both flanks there are two before and one behind
    assert wide[0].flank_copies >= motif.oriented_copy_number("ACG", "ACGACG")["copies"] and wide[0].flank_letters > 0 and (wide[1].flank_copies, wide[1].flank_letters) == (0, 0)
    calls = spark.createDataFrame([("l", 5.0, 0, 10), ("l", 4.0, 1, 10), ("l", 3.0, 5, 20), ("k", 1.0, 0, 10), ("k", None, 0, 10)], "locus string, score double, start int, end int")
    assert rows_of(motif.non_redundant_calls(calls, ["locus"], "score")) == [("k", 1.0, 0, 10), ("l", 3.0, 5, 20), ("l", 5.0, 0, 10)]


def test_motif_search_does_not_read_the_text_again_for_each_place(monkeypatch):
    """Before, a place of the motif cost a turn of all the text before it, and each stretch between two places an alignment."""
    aligned = []
    plain, turned = motif.infix_distances, motif.infix_distances_from_end
    monkeypatch.setattr(motif, "infix_distances", lambda m, t: aligned.append(len(t)) or plain(m, t))
    monkeypatch.setattr(motif, "infix_distances_from_end", lambda m, t: aligned.append(len(t)) or turned(m, t))
    text = "GATTACAGATTACATTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTGATTACATTTTTTTTTTTTTTTTTTTTTT" * 30
    hits = motif.motif_hits("GATTACA", text)
    assert len(hits) == 90 and all(text[s:e] == "GATTACA" for s, e in hits)
    assert sum(aligned) < 12 * len(text)
    aligned.clear()
    assert len(motif.motif_hits("GATT", text)) == 90 and not aligned
    assert motif.motif_hits("ACGTACG", "ßßacgtacg") == [(2, 9)]
