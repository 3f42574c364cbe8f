"""Chained traversals, haplotype paths and list ranking against plain Python on random groups; motif chains."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from spanweave.operators import motif, paths
from spanweave.operators.ranking import rank_lists


def test_lists_and_rings_are_ranked(spark):
    rng, rows, want = random.Random(2), [], {}
    ids = rng.sample(range(5_000), 700)
    for size, ring in [(1, False), (2, False), (2, True), (5, True), (64, False), (65, True), (200, False)]:
        own = [ids.pop() for _ in range(size)]
        if ring:
            own = own[own.index(min(own)) :] + own[: own.index(min(own))]
        rows += [(x, p) for x, p in zip(own, [own[-1] if ring else None, *own])]
        want |= {x: (own[0], k) for k, x in enumerate(own)}
    df = spark.createDataFrame(rows, "id long, prev long")
    assert {r.id: (r.head, r.place) for r in rank_lists(df, 200).collect()} == want
    assert rank_lists(df.limit(0), 0).count() == 0


def chains_by_hand(traversals):
    """Chains of [(ord, text)] in the order of what they begin with."""
    steps = {o: re.findall("[<>][^<>]+", t) for o, t in sorted(traversals) if t}
    ends, begins = defaultdict(list), defaultdict(list)
    for o, s in steps.items():
        begins[s[0]].append(o)
        ends[s[-1]].append(o)
    after = {a: b for x in ends for a, b in zip(ends[x], begins[x]) if a != b}
    heads, seen, out = [o for o in steps if o not in after.values()], set(), []
    for o in [*heads, *steps]:  # what no head reaches are rings
        if o in seen:
            continue
        text, at = list(steps[o]), o
        seen.add(o)
        while after.get(at) is not None and after[at] not in seen:
            at = after[at]
            seen.add(at)
            text += steps[at][1:]
        out.append((o, "".join(text)))
    return sorted(out)


def test_chained_traversals(spark):
    rng, groups = random.Random(8), {}
    for g in range(60):
        groups[g] = [(k, "".join(f"{rng.choice('<>')}{rng.randrange(4)}" for _ in range(rng.randint(0, 3)))) for k in range(rng.randrange(12))]
    groups[None] = [(0, ">1>2"), (1, ">2>1"), (2, ">5>5"), (3, ">5>6")]
    df = spark.createDataFrame([(g, k, t) for g, x in groups.items() for k, t in x], "g int, ord int, traversal string")
    got = defaultdict(list)
    for r in paths.chained_traversals(df.withColumn("group", F.struct("g"))).collect():
        got[r.group.g].append((r.ord, r.chain))
    assert {g: sorted(x) for g, x in got.items()} == {g: c for g, x in groups.items() if (c := chains_by_hand(x))}


def test_haplotype_paths(spark):
    rng = random.Random(4)
    old = {v: f">{v}>{v + 1}" for v in range(12)}
    new = {v: f">{v}>9{v}>{v + 1}" for v in range(0, 12, 2)}
    ref = "".join(f">{k}" for k in range(14))
    gt = {g: {v: rng.choices(["0", "1", "."], [4, 3, 3])[0] for v in range(12)} for g in range(25)} | {None: {3: "1", 4: "."}}
    rows = spark.createDataFrame([(g, v, x) for g, own in gt.items() for v, x in own.items()], "group int, variant int, gt string")
    alleles = spark.createDataFrame([(v, 0, t) for v, t in old.items()] + [(v, 1, t) for v, t in new.items()], "variant int, allele int, traversal string")
    got = {r.group: (r.status, r.path) for r in paths.haplotype_paths(rows, alleles, F.lit(ref)).collect()}

    def replaced(text, a, b):
        return re.sub(rf"{a}(?![^<>])", b, text)

    for g, own in gt.items():
        if sum(x == "." for x in own.values()) > 0.5 * len(own):
            assert got[g] == ("unknown", None)
            continue
        text = ref
        for v, x in sorted(own.items()):
            if x == "1" and v in new:
                text = replaced(text, old[v], new[v])
        for _, chain in chains_by_hand([(v, old[v]) for v, x in own.items() if x == "."]):
            text = replaced(text, chain, ">00000")
        assert got[g] == ("known", text)


def test_motif_chains():
    # on either side until the first chain that does not join; what is behind it stays out
    assert motif.grown_chain([(0, 10), (10, 20), (24, 34), (100, 110), (110, 120), (121, 131), (133, 143), (150, 160), (300, 310), (310, 320)], 10) == [(100, 110), (110, 120), (121, 131), (133, 143), (150, 160)]
    assert motif.grown_chain([(5, 8)], 3) == [(5, 8)]
    assert motif.grown_chain([(0, 10), (30, 40), (50, 60), (60, 70), (70, 80), (80, 90)], 10) == [(30, 40), (50, 60), (60, 70), (70, 80), (80, 90)]
    rng = random.Random(6)
    for _ in range(200):
        calls = [(rng.randrange(5), s := rng.randrange(60), s + rng.randint(1, 20)) for _ in range(rng.randrange(12))]
        kept, held = [], set()
        for c in sorted(calls, reverse=True):
            own = set(range(c[1], c[2]))
            if not kept or len(own & held) < 0.9 * len(own):
                kept.append(c)
                held |= own
        assert motif.non_redundant(calls) == kept
    assert motif._apart([(0, 10), (2, 12), (4, 14), (9, 19)]) == [(0, 10), (4, 14), (9, 19)]
