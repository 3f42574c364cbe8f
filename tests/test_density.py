"""Hierarchical density clusters against a hierarchy by the full distance matrix; projection by clusters."""

import math
import random

import numpy as np
import pytest

from spanweave.operators import density, paths


def full_tree(points, samples):
    """Links of the lightest spanning tree of mutual reachability, by the matrix of all distances."""
    xy = np.array(points, float)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, samples]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    n, links = len(xy), []
    inside, best, whence = np.zeros(n, bool), m[0].copy(), np.zeros(n, int)
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        links.append((float(best[j]), int(whence[j]), j))
        inside[j] = True
        closer = m[j] < best
        best[closer], whence[closer] = m[j][closer], j
    return links


def parts_of(nodes, links):
    near = {x: set() for x in nodes}
    for _, a, b in links:
        near[a].add(b)
        near[b].add(a)
    out, left = [], set(nodes)
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            part.add(x)
            todo += [y for y in near[x] if y in left]
            left -= near[x]
        out.append(part)
    return out


def labels_by_hand(points, least, samples, epsilon):
    """Clusters as nested dictionaries, by cutting the heaviest links of each part in turn."""

    def grow(part, links, born):
        me = {"points": set(part), "born": born, "stable": 0.0, "inner": [], "on": None}
        while links:
            w = max(x[0] for x in links)
            links = [x for x in links if x[0] < w]
            pieces = parts_of(part, links)
            large = [p for p in pieces if len(p) >= least]
            me["stable"] += sum(len(p) for p in pieces if not (len(large) == 1 and p is large[0])) * (1 / w - born)
            if len(large) != 1:
                me["inner"] = [grow(p, [x for x in links if x[1] in p], 1 / w) for p in large] if len(large) > 1 else []
                return me
            part = large[0]
            links = [x for x in links if x[1] in part]
        return me

    root = grow(range(len(points)), full_tree(points, samples), 0.0)

    def choose(c):
        """(stability, chosen clusters with the ones around them)"""
        inner = [choose(x) for x in c["inner"]]
        total = sum(x for x, _ in inner)
        if c is not root and total <= c["stable"]:
            return c["stable"], [[c]]
        return total, [[*trail, c] for _, trails in inner for trail in trails]

    label = {}
    for trail in choose(root)[1]:
        trail = [x for x in trail if x is not root]
        own = trail[0]
        if 1 / own["born"] < epsilon:
            own = next((x for x in trail[1:] if 1 / x["born"] > epsilon), trail[-1])
        for x in own["points"]:
            label[x] = own
    outer = {id(c): min(c["points"]) for c in label.values()}
    # a raised cluster holds the ones within it
    for c in list(label.values()):
        for x in c["points"]:
            if len(label[x]["points"]) < len(c["points"]):
                label[x] = c
    return {x: outer[id(c)] for x, c in label.items()}


@pytest.mark.parametrize("n,least,samples,epsilon", [(1000, 5, 1, 0.0), (300, 2, 1, 6.0), (300, 4, 3, 0.0), (200, 2, 1, 0.0)])
def test_density_clusters(spark, n, least, samples, epsilon):
    rng = random.Random(n + least + samples)
    spots = [(rng.uniform(0, 400), rng.uniform(0, 400), rng.uniform(1, 25)) for _ in range(8)]
    points = [(rng.gauss(x, s), rng.gauss(y, s)) for x, y, s in rng.choices(spots, k=n - n // 8)] + [(rng.uniform(0, 400), rng.uniform(0, 400)) for _ in range(n // 8)]
    df = spark.createDataFrame([(i, 1, *p) for i, p in enumerate(points)] + [(n, 1, None, 3.0)], "id long, g int, x double, y double")
    got = {r.id: r.cluster for r in density.hdbscan(df, ["g"], ["x", "y"], 300.0, least, samples, epsilon).collect()}
    want = labels_by_hand(points, least, samples, epsilon)
    assert len(set(want.values())) > 2
    assert got == {i: want.get(i) for i in range(n + 1)}


def test_forest_and_ties(spark):
    links = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 5.0), (4, 5, 1.0), (4, 4, 0.0), (8, 9, 2.0), (9, 8, 3.0)]
    df = spark.createDataFrame(links, "a long, b long, w double")
    forest = density.spanning_forest(df)
    assert sorted(map(tuple, forest.collect())) == [(1, 2, 1.0), (1, 3, 1.0), (3, 4, 5.0), (4, 5, 1.0), (8, 9, 2.0)]
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 8, 9, 77)], "id long")
    got = dict(map(tuple, density.density_clusters(ids, forest).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: None, 9: None, 77: None}
    assert density.density_clusters(ids, forest.limit(0)).where("cluster is not null").count() == 0
    rng = random.Random(5)
    many = [(rng.randrange(120), rng.randrange(120), float(rng.randrange(40))) for _ in range(600)]
    got, top, want = density.spanning_forest(spark.createDataFrame(many, "a long, b long, w double")).collect(), list(range(120)), []

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in many):
        if find(a) != find(b):
            top[find(a)] = find(b)
            want.append((a, b, w))
    assert sorted(map(tuple, got)) == sorted(want)


def test_projection_takes_the_hull_first_and_clusters_else(spark):
    line = spark.createDataFrame([("r", k, ">", f"n{k}", 10 * k + 1, 10 * k + 10) for k in range(10)], "path string, ord int, orient string, node string, pos_s long, pos_e long")
    region = spark.createDataFrame([("x", "r", 1, 100)], "region string, path string, start long, end long")
    far = [("far", "c", f"n{k}", 10 * k + x, 10 * k + 10 + x, ">") for x in (0, 5_000) for k in range(10)]
    gap = [("gap", "c", "n0", 0, 10, ">"), ("gap", "c", "n1", 10, 20, ">"), ("gap", "c", "n9", 90, 110, ">")]
    thin = [("thin", "c", f"n{k}", 1000 * k, 1000 * k + 10, ">") for k in range(3)]
    holes = [("holes", "c", f"n{k}", 14 * k + x, 14 * k + 10 + x, ">") for x in (0, 9_000) for k in range(8)]
    placed = spark.createDataFrame(far + gap + thin + holes, "sample string, chrom string, node string, start long, end long, orient string")

    def got(**how):
        return sorted((r.sample, r.start, r.end, round(r.ratio, 3)) for r in paths.project_regions(region, line, placed, **how).collect())

    two = [("far", 0, 100, 1.0), ("far", 5_000, 5_100, 1.0)]
    gaps = [*two, ("gap", 0, 100, 1.0), ("holes", 0, 108, round(100 / 108, 3)), ("holes", 9_000, 9_108, round(100 / 108, 3)), ("thin", 0, 2_010, round(100 / 2_010, 3))]
    assert got() == gaps
    # the two merged places of far are too few for clusters of two; holes has eight on either side
    assert got(density=True) == [("far", 0, 5_100, round(100 / 5_100, 3)), *gaps[2:]]
    assert paths.project_regions(region, line, placed.limit(0), density=True).count() == 0
    assert math.isclose(paths.project_regions(region, line, placed).where("sample = 'gap'").first().share, 0.3)
