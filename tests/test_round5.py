"""Findings of round 4: each of these failed before."""


def test_places_that_trimming_empties_have_no_row(spark):
    from spanweave.plans import regions

    place = "chrom string, start long, end long, sample string"
    rows = [("c", 0, 10, "s1", 1.0), ("c", 0, 10, "s2", 2.0), ("c", 20, 30, "s1", 3.0), ("c", 20, 30, "s2", 3.0), ("c", 40, 50, "s1", 5.0)]
    windows = spark.createDataFrame([("c", 0, 15), ("c", 20, 35), ("c", 40, 55), ("c", 60, 75)], "chrom string, start long, end long")
    got = regions.element_variation(spark.createDataFrame(rows, place + ", delta double")).collect()
    assert sorted((r.start, r.TEgini) for r in got) == [(20, 0.0), (40, 0.0)]
    got = regions.repeat_variation(windows, spark.createDataFrame(rows, place + ", copies double")).collect()
    assert sorted((r.start, r.vntr_cov) for r in got) == [(0, 0.0), (20, 1.0), (40, 1.0), (60, 0.0)]


def test_windows_meet_their_variants_without_a_table_between(spark, monkeypatch):
    import math
    import random

    from spanweave.plans import regions

    rng = random.Random(7)
    starts = [rng.randrange(-200, 30000) for _ in range(60)]
    windows = [(rng.choice("ab"), s, s + rng.choice([0, 1, 40, 64, 65, 600, 1000, 1000, 5000])) for s in starts] + [("a", 5, None), (None, 5, 9)]
    variants = [(rng.choice("abc"), s, s + rng.choice([0, 1, 3, 3, 200, 9000]), rng.choice([1, 7]), rng.choice([None, 2, 5]), rng.choice([None, 0.5, 1.0])) for s in (rng.randrange(-300, 31000) for _ in range(500))]
    variants += variants[:40] + [("a", None, 4, 1, 1, 1.0)]

    def plain(windows):
        out = {}
        for c, a, b in set(windows):
            met = [x for x in variants if None not in (a, b, c, x[1]) and x[0] == c and x[1] < b and a < x[2]]
            if met:
                lo, hi = min(a, *[x[1] for x in met]), max(b, *[x[2] for x in met])
                left = hi - lo + 1 - len({p for x in met for p in range(x[1], x[2] + 1)})
                size = sum(max(x[3], x[4] or 0) for x in met)
                weight = sum(x[4] for x in met if x[4]) if any(x[4] for x in met) else None
                out[c, a, b] = (sum(x[4] * x[5] for x in met if x[4] and x[5]) / weight if weight and any(x[4] and x[5] for x in met) else None, weight, left / (left + size))
        return out

    place = "chrom string, start long, end long"
    df = spark.createDataFrame(variants, place + ", ref_len long, alt_len long, entropy double")
    near = lambda x, y: (x is None and y is None) or math.isclose(x, y)

    def same(windows):
        got = regions.window_diversity(spark.createDataFrame(windows, place), df).collect()
        want = plain(windows)
        assert len(got) == len(want) and all(near(x, y) for r in got for x, y in zip((r.entropy, r.weight, r.win_sim), want[r.chrom, r.start, r.end]))

    same([*windows, *windows[:9], ("a", -1000, 400000), ("b", 0, 262144)])
    same([("a", -1000, 400000)])
    assert regions.window_diversity(spark.createDataFrame([], place), df).count() == 0
    monkeypatch.setattr(regions, "Scratch", None)  # no table is written between the join and the sums
    same(windows)


def test_pairs_of_texts_are_those_of_their_substrings(spark):
    import random

    from spanweave.functions import textpairs

    rng = random.Random(11)
    letters = "abcdeé😀 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 4, 5, 30, 400, 1500]))) for _ in range(40)]
    texts += [t[: len(t) * k // 8] + t[len(t) * (k - 1) // 8 :][::-1] for t in texts for k in (4, 6, 7)] + texts[:9] + [None, "aaaaaaaaaa", "aaaaa", "ab" * 400, "ba" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in (x or "" for x in texts)]
    want = {}
    for a in range(len(sets)):
        for b in range(a):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] and sets[b] else 0
            if j >= 0.4:
                want[b, a] = j
    got = textpairs.text_pairs(df, "id", "text", 5, 0.4)
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == want and len(want) > 40 and got.count() == len(want)
    assert textpairs.text_pairs(df.limit(0), "id", "text", 5, 0.4).count() == 0
    bands, rows, agree = textpairs.shape_for(0.4)
    assert (1 - 0.4**rows) ** bands <= 5e-7 and 0 < agree < 0.4 * bands * rows


def test_enrichment_does_not_repeat_its_targets(spark, monkeypatch):
    import random

    from spanweave.operators import intervals, stats

    rng = random.Random(5)
    spot = lambda: (rng.choice("abc"), (s := rng.randrange(300)), s + rng.randrange(1, 12))
    targets = [(*spot(), rng.choice(["x", "y", "z", None, "far"])) for _ in range(60)] + [("q", 1, 5, "far"), (None, 1, 5, "z"), ("a", None, 5, "x")]
    observed, moved = [spot() for _ in range(150)], [(k, *spot()) for k in range(4) for _ in range(100 + 30 * k)]
    held = {k: {(c, p) for j, c, s, e in [(-1, *x) for x in observed] + moved if j == k for p in range(s, e)} for k in range(-1, 4)}

    def above(k):
        parts = {}
        for c, s, e, n in targets:
            if s is not None:
                have, size = parts.get(n, (0, 0))
                parts[n] = (have + sum((c, p) in held[k] for p in range(s, e)), size + e - s)
        return sum(h / n > 0.64 for h, n in parts.values())

    place = "chrom string, start long, end long"
    frames = [spark.createDataFrame(targets, place + ", name string"), spark.createDataFrame(observed, place), spark.createDataFrame(moved, "shuffle_id int, " + place)]
    seen, before = [], intervals.overlap_join
    monkeypatch.setattr(intervals, "overlap_join", lambda a, b, **how: seen.append(a.count()) or before(a, b, **how))
    rows = stats.enrichment(*frames, 0.64).collect()
    n = above(-1)
    assert [tuple(r) for r in rows] == [(n, 4, (1 + sum(above(k) >= n for k in range(4))) / 5)]
    assert seen == [len(targets)]
    assert stats.enrichment(frames[0], frames[1].limit(0), frames[2], 0.64).count() == 0


def test_hits_of_a_projection_are_dealt_once(spark):
    import re

    from spanweave.operators import paths

    line = spark.createDataFrame([("r", k, ">", f"n{k % 7}", 10 * k + 1, 10 * k + 10) for k in range(10)], "path string, ord int, orient string, node string, pos_s long, pos_e long")
    region = spark.createDataFrame([("x", "r", 16, 75), ("y", "r", 1, 30)], "region string, path string, start long, end long")
    placed = [(s, c, f"n{k % 5}", 40 * k * (s + 1), 40 * k * (s + 1) + 10, "><"[k % 2]) for s in range(3) for c in "cd" for k in range(12)]
    placed = spark.createDataFrame(placed, "sample int, chrom string, node string, start long, end long, orient string")
    got = paths.project_regions(region, line, placed)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(region", plan)) == 1 and plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") == 2
    assert got.count() == len({(r.region, r.sample, r.chrom, r.start) for r in got.collect()}) >= 12


def test_kmers_beyond_a_bound_go_through_the_shuffle_in_parts(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from spanweave.functions import kmers
    from spanweave.scratch import Scratch

    rng = random.Random(2)
    texts = ["".join(rng.choice("acgt n") for _ in range(rng.choice([3, 40, 900]))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    known = df.where("id % 3 = 0")
    rows, pool = kmers.kmer_rows(df, "id", F.col("s"), 6), kmers.kmer_rows(known, "id", F.col("s"), 6)
    want = sorted(map(tuple, kmers.sequence_share(df, "id", F.col("s"), 6, known, F.col("s")).collect()))
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, table, name: saved.append(name) or save(self, table, name))
    monkeypatch.setattr(kmers, "AT_ONCE", -(-sum(len(t or "") for i, t in enumerate(texts) for _ in range(1 + (i % 3 == 0))) // 3))
    assert sorted(map(tuple, kmers.sequence_share(df, "id", F.col("s"), 6, known, F.col("s")).collect())) == want
    assert saved == ["part0", "part1", "part2"]
    monkeypatch.setattr(kmers, "AT_ONCE", 4000)
    assert sorted(map(tuple, kmers.kmer_share(rows, "id", pool).collect())) == want and len(saved) > 4
