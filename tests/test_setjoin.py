"""The exact set join against all pairs."""

import random

import numpy as np
import pytest

from spanweave.operators import setjoin


def by_hand(sets, least):
    first = {}
    for k in sorted(sets):
        first.setdefault(frozenset(sets[k]), k)
    kept = [(k, s) for s, k in first.items() if s]
    out = {}
    for a, s in kept:
        for b, t in kept:
            if a < b and len(s & t) / len(s | t) >= least:
                out[a, b] = (len(s & t), len(s & t) / len(s | t))
    return out


def rows_of(spark, sets, more=()):
    return spark.createDataFrame([(k, x, str(x)) for k, s in sets.items() for x in s] + list(more), "id long, x long, name string")


@pytest.mark.parametrize("least,block", [(0.05, 1024), (0.05, 7), (0.1, 3), (0.5, 1024), (1.0, 5)])
def test_similar_sets(spark, monkeypatch, least, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    rng = random.Random(int(least * 100) + block)
    sets = {k: {int(rng.paretovariate(0.4)) % 500 for _ in range(rng.choice([1, 2, 8, 30, 90]))} for k in range(120)}
    sets[120], sets[121], sets[122] = set(sets[3]), set(range(981, 1001)), {990}  # 1/20 is the threshold itself
    more = [(5, None, None), (None, 1, "1"), (200, None, "a")] + [(k, x, str(x)) for k in (1, 2, 3) for x in list(sets[k])[:3]]
    got = setjoin.similar_sets(rows_of(spark, sets, more), "id", ["x", "name"], least).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    want = by_hand(sets, least)
    assert {(r.a, r.b): (r.shared, r.jaccard) for r in got} == want
    if least == 0.05:
        assert (121, 122) in want


def test_classes_and_empty(spark):
    sets = {1: {1, 2}, 2: {1, 2}, 3: {1, 2, 9}, 4: {7}}
    got = {r.id: (r.rep, r.n) for r in setjoin.set_classes(rows_of(spark, sets), "id", ["x"]).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 3)}  # 4 shares nothing
    assert setjoin.similar_sets(rows_of(spark, {}), "id", ["x"], 0.05).count() == 0
    with pytest.raises(ValueError):
        setjoin.similar_sets(rows_of(spark, sets), "id", ["x"], 0)


def test_common_item_goes_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HEAVY", 3)
    sets = {k: {0, k, k + 1} for k in range(1, 60)}
    got = {(r.a, r.b): r.shared for r in setjoin.similar_sets(rows_of(spark, sets), "id", ["x"], 0.1).collect()}
    assert got == {k: v[0] for k, v in by_hand(sets, 0.1).items()}


def test_pairs_are_packed_by_set(spark):
    """300 sets of one common item: a row for each set goes through the shuffle, not one for each of 44,850 pairs."""
    cells = spark.createDataFrame([(1, 0, 0, 0, k, 5, 1) for k in range(300)] + [(2, 0, 1, k % 2, k, 5, 2) for k in range(6)], "_id long, _c1 int, _c2 int, _at int, key long, n long, place int")
    met = cells.repartition(1).sortWithinPartitions("_id").mapInArrow(setjoin._met(0.05), "a long, n long, others binary").collect()
    assert len(met) <= 306
    pairs = [(r.a, b, m, most) for r in met for b, m, most in zip(*setjoin._decoded(r.others))]
    assert len(pairs) == 300 * 299 // 2 + 9 and all(a < b and m == 5 and most in (4, 5) for a, b, m, most in pairs)
    assert sum(len(r.others) for r in met) < 5 * len(pairs)
    again = spark.createDataFrame([(k, 5, setjoin._coded(*(np.array(x) for x in ([k + 1, k + 2], [5, 5], [5, 1])))) for k in range(0, 9, 3)], "a long, n long, others binary")
    assert {tuple(r) for r in again.repartition(1).sortWithinPartitions("a").mapInArrow(setjoin._candidates(0.3), "a long, b long").collect()} == set()
    assert {tuple(r) for r in again.repartition(1).sortWithinPartitions("a").mapInArrow(setjoin._candidates(0.1), "a long, b long").collect()} == {(0, 1), (0, 2), (3, 4), (3, 5), (6, 7), (6, 8)}
