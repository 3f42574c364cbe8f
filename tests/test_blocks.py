"""Haplotype blocks, collinear runs and list ranking against plain Python on random paths."""

import random
from collections import Counter, defaultdict

import pytest

from spanweave.operators import blocks, chunked
from spanweave.operators.ranking import rank_chains


def test_chains_are_ranked(spark):
    rng, rows, want = random.Random(1), [], {}
    names = rng.sample(range(10_000), 900)
    for size in [1, 2, 3, 7, 64, 65, 300]:
        chain = [names.pop() for _ in range(size)]
        rows += [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(chain, chain[1:])] or [(chain[0], chain[0])]
        chain = chain if chain[0] < chain[-1] else chain[::-1]
        want |= {n: (chain[0], k) for k, n in enumerate(chain)}
    df = spark.createDataFrame([*rows, rows[0], (None, 1)], "a long, b long")
    assert {r.node: (r.chain, r.place) for r in rank_chains(df).collect()} == want
    assert rank_chains(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        rank_chains(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long"), 8)
    with pytest.raises(ValueError):
        rank_chains(spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long"))


def random_paths(rng, n_paths, size):
    """Paths that share most of their nodes, with nodes left out, put in, turned around and repeated."""
    base, out = [f"n{i:03d}" for i in range(size)], []
    for p in range(n_paths):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(own))
            kind, k = rng.choice(["gone", "new", "turn", "twice", "holes"]), rng.randint(1, 6)
            if kind == "gone":
                del own[i : i + k]
            elif kind == "new":
                own[i:i] = [f"x{rng.randrange(30)}" for _ in range(k)]
            elif kind == "holes":
                del own[i : i + 4 * k : 2]
            elif kind == "turn":
                own[i : i + k] = own[i : i + k][::-1]
            else:
                own[i:i] = own[max(0, i - k) : i]
        out.append((f"p{p}", own or ["n000"]))
    return dict(out)


def runs_by_hand(paths):
    seen, count = defaultdict(set), Counter()
    for p, nodes in paths.items():
        for n in nodes:
            seen[n].add(p)
            count[p, n] += 1
    on = defaultdict(set)
    for p, nodes in paths.items():
        for a, b in zip(nodes, nodes[1:]):
            on[frozenset((a, b))].add(p)
    label = {n: {n} for n in seen}
    for pair, where in on.items():
        a, b = (*pair, *pair)[:2]
        if a != b and where == seen[a] == seen[b] and all(count[p, x] == 1 for p in where for x in pair):
            both = label[a] | label[b]
            label.update((n, both) for n in both)
    return {frozenset(x) for x in label.values()}


def steps_of(spark, regions, lens):
    rows = [(g, p, k, n, lens[n]) for g, paths in regions.items() for p, nodes in paths.items() for k, n in enumerate(nodes)]
    return spark.createDataFrame(rows, "region int, path string, ord int, node string, len int")


def test_collinear_runs(spark):
    rng = random.Random(7)
    regions = {g: random_paths(rng, rng.randint(1, 5), 40) for g in range(12)}
    lens = defaultdict(lambda: 30)
    got = defaultdict(dict)
    for r in blocks.collinear_runs(steps_of(spark, regions, lens)).collect():
        got[r.region].setdefault(r.run, {})[r.node] = r.place
    for g, paths in regions.items():
        assert {frozenset(x) for x in got[g].values()} == runs_by_hand(paths)
        for run, places in got[g].items():
            order = sorted(places, key=places.get)
            assert sorted(places.values()) == list(range(len(places))) and order[0] == run
            for nodes in paths.values():
                held = [n for n in nodes if n in places]
                assert not held or len(places) == 1 or held in (order, order[::-1])
    table = blocks.region_blocks(steps_of(spark, regions, lens), 100).collect()
    for r in table:
        own, n = runs_by_hand(regions[r.region]), len(regions[r.region])
        on = lambda run: sum(bool(run & set(x)) for x in regions[r.region].values())  # noqa: E731, B023
        assert r.blocks == sum(30 * len(x) >= 100 and on(x) == n for x in own) and r.poly == sum(30 * len(x) >= 100 and on(x) < n for x in own)
        assert r.total_len == 30 * sum(map(len, own)) and r.kept_len == sum(30 * len(x) for x in own if 30 * len(x) >= 100 and on(x) == n)


# The rule of chunked blocks in plain Python: lists of paths that are changed step by step.


def islands(places, gap):
    out = []
    for p in sorted(places):
        if out and p - out[-1][-1] <= gap:
            out[-1].append(p)
        else:
            out.append([p])
    return max(out, key=len)


def island_on(path, nodes, gap, free):
    """Places of ``nodes`` in the widest island on the path."""
    at = [k for k, n in enumerate(path) if n in nodes and free(k)]
    return islands(at, gap) if at else []


def has(chunk, lens, path, free, a, b, share, gap):
    part = {n: p for n, p in chunk.items() if a <= p < b}
    spots = island_on(path, part, gap, free)
    common = {path[k] for k in spots}
    if not common:
        return False
    if common == set(part):
        return True
    low, *_, high = [min(islands([part[n] for n in common], gap)), max(islands([part[n] for n in common], gap))]
    total = sum(lens[n] for n in part)
    inside = sum(lens[n] for n, p in part.items() if low <= p <= high)
    own = sum(lens[n] for n in path[spots[0] : spots[-1] + 1])
    return max((high - low + 1) / (b - a), inside / total) > share and min(own, total) > share * max(own, total)


def blocks_by_hand(paths, lens, sizes, slices, share, slice_gap, gap, least):
    state = {p: ["open"] * len(nodes) for p, nodes in paths.items()}
    twice = {n for nodes in paths.values() for n, c in Counter(nodes).items() if c > 1}
    found = set()
    for repeated in (False, True):
        for size in sizes:
            may = {p: [s == "open" and (repeated or n not in twice) for n, s in zip(nodes, state[p])] for p, nodes in paths.items()}
            owner = {}
            for p in sorted(paths):
                for n, m in zip(paths[p], may[p]):
                    if m:
                        owner.setdefault(n, p)
            chunks = []
            for p, nodes in paths.items():
                run = []
                for k in range(len(nodes) + 1):
                    if k < len(nodes) and may[p][k] and owner[nodes[k]] == p:
                        run.append(k)
                        continue
                    n = len(run) // size
                    for c in range(n):
                        end = run[-1] + 1 if c == n - 1 else run[0] + (c + 1) * size
                        at, nodes_in = run[0] + c * size, {}
                        for j in range(at, end):
                            nodes_in.setdefault(nodes[j], j - at)
                        chunks.append((p, at, nodes_in))
                    run = []
            after = {p: list(s) for p, s in state.items()}
            for bench, at, chunk in chunks:
                n = max(chunk.values()) + 1
                step, differs, says, wait = max(1, n // slices), set(), {}, False
                for q, nodes in paths.items():
                    free = lambda k, q=q: may[q][k]
                    common = {x for k, x in enumerate(nodes) if x in chunk and free(k)}
                    if not common:
                        continue
                    for s in range(slices):
                        a, b = s * step, n if s == slices - 1 else (s + 1) * step
                        part = [x for x, p in chunk.items() if a <= p < b]
                        own = [x for x in part if x in common]
                        if a < b and own and len(own) < len(part):
                            isle = islands([chunk[x] for x in own], slice_gap)
                            if sum(lens[x] for x in part if isle[0] <= chunk[x] <= isle[-1]) <= share * sum(lens[x] for x in part):
                                differs.add(s)
                    if has(chunk, lens, nodes, free, 0, n, share, gap):
                        says[q] = (0, n)
                        continue
                    places = sorted(chunk[x] for x in common)
                    for last in places[:0:-1]:
                        if has(chunk, lens, nodes, free, places[0], last + 1, share, gap):
                            says[q] = (places[0], last + 1)
                            break
                    else:
                        wait |= len(common) > 0.5 * len(chunk)
                gone = {}
                if len(differs) > slices / 2:
                    gone = {x: "varied" for x, p in chunk.items() if min(p // step, slices - 1) in differs}
                elif not wait and says:
                    a, b = max(x for x, _ in says.values()), min(y for _, y in says.values())
                    inside = [x for x, p in chunk.items() if a <= p < b]
                    if inside and sum(lens[x] for x in inside) < least:
                        gone = dict.fromkeys(inside, "closed")
                    elif inside:
                        for q in says:
                            spots = island_on(paths[q], inside, gap, lambda k, q=q: may[q][k])
                            if spots:
                                found.add((bench, at + a, at + b - 1, q, spots[0], spots[-1]))
                                for k in range(spots[0], spots[-1] + 1):
                                    if state[q][k] == "open":
                                        after[q][k] = "block"
                for q, nodes in paths.items():
                    for k, x in enumerate(nodes):
                        if x in gone and after[q][k] == "open" and (repeated or x not in twice):
                            after[q][k] = gone[x]
            state = after
    return found, state


@pytest.mark.parametrize("sizes,least,seed", [((12, 8, 4), 60, 3), ((20, 5), 150, 4)])
def test_chunked_blocks(spark, sizes, least, seed):
    rng = random.Random(seed)
    regions = {g: random_paths(rng, rng.randint(1, 6), 60) for g in range(14)}
    lens = {n: rng.randint(1, 30) for paths in regions.values() for nodes in paths.values() for n in nodes}
    rule = {"slices": 5, "share": 0.9, "slice_gap": 2, "gap": 5, "least": least}
    found, nodes = chunked.chunked_blocks(steps_of(spark, regions, lens), sizes, **rule)
    got, states = defaultdict(set), defaultdict(dict)
    for r in found.collect():
        got[r.region].add(tuple(r)[1:])
    for r in nodes.collect():
        states[r.region].setdefault(r.path, {})[r.ord] = r.state
    kinds = Counter()
    for g, paths in regions.items():
        want, state = blocks_by_hand(paths, lens, sizes, **rule)
        assert got[g] == want
        assert {p: [s[k] for k in range(len(s))] for p, s in states[g].items()} == state
        assert all(0 <= k < len(paths[p]) for _, _, _, p, *ends in want for k in ends)
        kinds.update(x for s in state.values() for x in s)
    assert set(kinds) == {"open", "block", "closed", "varied"}
    for r in chunked.block_summary(found, nodes).collect():
        paths = regions[r.region]
        kept = {n for p, s in states[r.region].items() for k, x in s.items() if x == "block" for n in [paths[p][k]]}
        every = {n for x in paths.values() for n in x}
        assert r.kept_len == sum(lens[n] for n in kept) and r.total_len == sum(lens[n] for n in every)
        assert r.blocks == len({x[:2] for x in got[r.region]}) and abs(r.polyratio - (1 - r.kept_len / r.total_len)) < 1e-9


def test_chunked_blocks_of_nothing(spark):
    rows = [(None, "p", 0, "a", 3), (1, "p", 0, None, 3), (1, None, 0, "a", 3), (1, "p", 1, "a", None), (1, "p", 1, "b", 5)]
    found, nodes = chunked.chunked_blocks(spark.createDataFrame(rows, "region int, path string, ord int, node string, len int"), (2,))
    assert found.count() == 0 and [tuple(r) for r in nodes.collect()] == [(1, "p", 1, "a", 0, "open")]
    found, nodes = chunked.chunked_blocks(spark.createDataFrame([], "region int, path string, ord int, node string, len int"), (2,))
    assert found.count() == nodes.count() == 0
