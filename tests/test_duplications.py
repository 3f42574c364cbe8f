"""The duplication plan against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.plans import duplications

TURN = str.maketrans("ACGT", "TGCA")
PLACE = "chrom string, start long, end long"
SIX = "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long"


def kmers(seq, k):
    parts = [seq[i : i + k] for i in range(len(seq or "") - k + 1)]
    return {min(x, x[::-1].translate(TURN)) for x in parts if "N" not in x}


def genome(rng):
    """Two sequences with a segment that occurs three times, once reversed and once with changes."""
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    part = letters(1500)
    changed = "".join(rng.choice("ACGT") if rng.random() < 0.03 else c for c in part)
    return {"c1": letters(2000) + part + letters(1000) + changed + letters(700), "c2": letters(500) + part[::-1].translate(TURN) + letters(900) + "N" * 400}


def windows_of(sequences, width=200, step=100):
    rows = [(c, s, min(s + width, len(q)), q[s : s + width]) for c, q in sequences.items() for s in range(0, len(q), step)]
    return rows + [("c3", 0, 200, rows[3][3]), ("c3", 900, 1100, rows[3][3]), ("c3", 2000, 2100, None), (None, 0, 200, rows[3][3])]


def touch(a, b):
    return a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]


def pairs_by_hand(rows, k, least):
    sets = {r[:3]: kmers(r[3], k) for r in rows if r[0]}
    out = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= least and (j > 0.6 if touch(a, b) else j >= 0.1):
                    out[a + b] = j
    return out


def regions_by_hand(pairs, gap, eps):
    """Islands of the first sides, then clusters by single links."""
    out = set()
    for key in {(p[0], p[3]) for p in pairs}:
        group, islands, reach = sorted(p for p in pairs if (p[0], p[3]) == key), [], None
        for p in sorted(group, key=lambda p: (p[1], p[2])):
            if reach is None or p[1] > reach + gap:
                islands.append([])
                reach = p[2]
            islands[-1].append(p)
            reach = max(reach, p[2])
        for left in islands:
            while left:
                held = [left.pop()]
                for p in held:
                    near = [q for q in left if sum((p[i] - q[i]) ** 2 for i in (1, 2, 4, 5)) <= eps * eps]
                    left = [q for q in left if q not in near]
                    held += near
                out.add((key[0], min(p[1] for p in held), max(p[2] for p in held), key[1], min(p[4] for p in held), max(p[5] for p in held)))
    return out


def test_window_pairs_and_regions(spark):
    rows = windows_of(genome(random.Random(5)))
    df = spark.createDataFrame(rows, PLACE + ", seq string")
    found = duplications.window_pairs(df, k=9, least=0.05)
    want = pairs_by_hand(rows, 9, 0.05)
    got = {tuple(r)[:6]: r.jaccard for r in found.collect()}
    assert got == want and ("c3", 0, 200, "c3", 900, 1100) in got
    for gap, eps in ((10_000, 300_000), (50, 250)):
        done = duplications.duplicated_regions(spark.createDataFrame(list(want), SIX), gap, eps)
        assert sorted(map(tuple, done.collect())) == sorted(regions_by_hand(list(want), gap, eps))
    none = duplications.window_pairs(df.limit(0), k=9)
    assert none.count() == 0 and duplications.duplicated_regions(none).count() == 0


def test_repeated_selves_and_growth(spark):
    regions = spark.createDataFrame([("a", 100, 200, "a", 150, 260), ("a", 100, 200, "a", 300, 400), ("b", 100, 200, "b", 120, 220)], SIX)
    repeats = spark.createDataFrame([("a", 90, 210), ("b", 100, 150), ("a", 380, 430)], PLACE)
    lengths = spark.createDataFrame([("a", 420), ("b", 1000)], "chrom string, length long")
    kept = duplications.drop_repeated_selves(regions, repeats)
    assert sorted(map(tuple, kept.collect())) == [("a", 100, 200, "a", 300, 400), ("b", 100, 200, "b", 120, 220)]
    grown = {tuple(r) for r in duplications.grown_regions(kept, repeats, lengths).collect()}
    # the repeat on the first side sticks out by 10 and 10: the second side is 290 to 410; out of that the repeat at 380 sticks by 20
    assert ("a", 100, 220, "a", 290, 410) in grown


def test_annotate(spark, tmp_path):
    sequences = genome(random.Random(5))
    spark.createDataFrame(windows_of(sequences)[:-4], PLACE + ", seq string").write.parquet(str(tmp_path / "windows"))
    (tmp_path / "repeats.bed").write_text("c1\t0\t50\n")
    (tmp_path / "satellites.bed").write_text("c2\t0\t50\n")
    (tmp_path / "lengths.fai").write_text("".join(f"{c}\t{len(q)}\t0\t60\t61\n" for c, q in sequences.items()))
    inputs = {"windows": str(tmp_path / "windows"), "repeats": str(tmp_path / "repeats.bed"), "satellites": str(tmp_path / "satellites.bed"), "lengths": str(tmp_path / "lengths.fai")}

    def align(regions):
        """As if the whole of both sides aligned; a second line lies within it, a third is too short."""
        name = lambda k: F.concat_ws("", f"chrom{k}", F.lit(":"), (F.col(f"start{k}") + 1).cast("string"), F.lit("-"), F.col(f"end{k}").cast("string"))
        size = lambda k: F.col(f"end{k}") - F.col(f"start{k}")
        line = lambda cut, block: F.concat_ws("\t", name(2), size(2), F.lit(cut), size(2) - cut, F.lit("+"), name(1), size(1), F.lit(cut), size(1) - cut, F.lit(block), F.lit(block), F.lit("60"), F.lit("cg:Z:10=1X"))
        return regions.select(F.explode(F.array(line(0, 1200), line(30, 1100), line(0, 900))).alias("value"))

    done, run = duplications.annotate(spark, str(tmp_path / "run"), inputs, align, "test 1", k=9, eps=400)
    rows = [tuple(r) for r in done.select("chrom1", "start1", "end1", "chrom2", "start2", "end2").collect()]
    assert {(r[0], r[3]) for r in rows} == {("c1", "c1"), ("c1", "c2")} and len(rows) == len(set(rows))
    assert all(r.align_len == 1200 and r.identity == pytest.approx(1200 / 1201) for r in done.collect())
    # the planted segment on both sides, to a window
    spots = {("c1", 2000, 3500), ("c1", 4500, 6000), ("c2", 500, 2000)}
    near = lambda r, s: r[0] == s[0] and abs(r[1] - s[1]) <= 200 and abs(r[2] - s[2]) <= 200
    assert {s for s in spots if any(near(r[:3], s) or near(r[3:], s) for r in rows)} == spots
    _, again = duplications.annotate(spark, str(tmp_path / "run"), inputs, align, "test 1", k=9, eps=400)
    assert again.computed == []
    _, again = duplications.annotate(spark, str(tmp_path / "run"), inputs, align, "test 2", k=9, eps=400)
    assert again.computed == ["aligned", "duplications"]
