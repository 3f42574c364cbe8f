"""Exact Jaccard join of whole texts over 5-word shingles (similarity 0.8), in metric space.

Jaccard distance is a metric, so a pivot p tells apart x and y when |d(x,p) - d(y,p)| > 0.2.
Texts that share no shingle are all at distance 1, which no finite set of pivots can divide;
so the space is first cut without loss by shared rare shingles, then by pivots:

1. Equal shingle sets form one class. Under one order of all shingles (by the corpus count of
   their hashed bucket, then by hash) two sets within 0.2 share one of the first
   n - ceil(0.8 n) + 1. Sets with such a shingle in common and sizes within 0.8 are candidates; parity
   sketches, whose difference is a lower bound of the sets', rule most of them out for certain. Where very
   many sets share a shingle, neighbours in order of size are chained without that test. The connected components
   are the outer regions, and no link crosses two of them.
2. A region takes pivots; every member's distance to each of them is computed exactly. A member
   belongs to the Voronoi cell of its nearest pivot and is replicated to cells whose pivot is
   at most 2 * 0.2 farther, so that linked members always meet in a cell. Members at 0.8 or more
   from all pivots form a cell of their own. Members within 0.2 of a pivot are linked by it; of
   those linked already a cell keeps what can still reach (by the pivot distances) a member of another component.
3. Cells are joined in the same way again, with new pivots, until they are small and compared
   directly. Regions up to ``REGION_SETS`` sets do so inside one task, larger ones by rounds of
   salted, distributed jobs. What cells would not
   make cheaper, or not in ``MAX_ROUNDS`` rounds, is joined by pairs of blocks.

Texts move once, and only those of outer regions with two sets or more (a Bloom filter of bounded size holds back the
others). The bucket counts steer
speed only; the result does not depend on them.

Defined cases: null or empty texts have an empty set and link with nothing; 1 to 4 words are one
shingle; one output row per input row, so repeated rows stay; with a null doc_id the component
is the smallest doc_id reached, or null if there is none; an empty table gives no rows; other columns
are ignored (``keep_one`` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import sql
from spanweave.llm.idfilter import IdFilter
from spanweave.llm.text import as_row, mix, shingle_sets, text_chunks, words_of
from spanweave.operators.components import connected_components, local_roots
from spanweave.scratch import Scratch

BUCKET_BITS = 22
SEGMENTS = 64
REGION_SETS = 400
REGION_SHINGLES = 1_500_000
PIVOTS = 24
LEAF = 32
#: Rows of one shingle up to which all its pairs are tested.
CELL = 32
MAX_ROUNDS = 10
BLOCK = 200
#: Sets of one region that one task compares with the pivots, about.
SALT_SETS = 1000


def _signature(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart: sums of two mixes of the elements."""
    a = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x243F6A8885A308D3)), dtype=np.uint64)])
    b = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x13198A2E03707344)), dtype=np.uint64)])
    return (a[ends[1:]] - a[ends[:-1]]).view(np.int64), (b[ends[1:]] - b[ends[:-1]]).view(np.int64)


def _parity_sketch(hashes: np.ndarray) -> bytes:
    """One bit for each of about n cells of the hash space: whether it holds an odd number of elements."""
    bits = max(64, 1 << max(0, len(hashes) - 1).bit_length())
    cell = ((hashes >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing_cells(a: bytes, b: bytes) -> int:
    """Cells that differ between two sketches, the larger folded to the smaller's size. Each element that only one set
    has changes one cell, so this is a lower bound of the symmetric difference."""
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        half = len(a) // 2
        a = (int.from_bytes(a[:half], "little") ^ int.from_bytes(a[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: doc_id, set size, signature and sketch of each text (the sketch where the set is new to the
    task). kind 1: how many distinct sets of this task have each bucket of shingles, as bytes (up to 255) in ``SEGMENTS``
    rows (n: which one)."""
    counts, seen = np.zeros(1 << BUCKET_BITS, np.int32), set()
    names = ["kind", "doc_id", "n", "s1", "s2", "sketch"]
    for batch in batches:
        ids = batch.column(0)
        for i, j, data, offs in text_chunks(batch.column(1)):
            hashes, ends = shingle_sets(words_of(data, offs))
            s1, s2 = _signature(hashes, ends)
            new = np.zeros(j - i, bool)
            for d, s in enumerate(s1.tolist()):
                if s not in seen:
                    seen.add(s)
                    new[d] = True
            first = hashes[np.repeat(new, np.diff(ends))]
            np.add.at(counts, _bucket(first), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(j - i, np.int32)), ids.slice(i, j - i), pa.array(np.diff(ends)), pa.array(s1), pa.array(s2),
                 pa.array([_parity_sketch(hashes[a:b]) if new[d] else None for d, (a, b) in enumerate(zip(ends[:-1], ends[1:]))], pa.binary())], names
            )
    parts = np.minimum(counts, 255).astype(np.uint8).reshape(SEGMENTS, -1)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.ones(SEGMENTS, np.int32)), pa.nulls(SEGMENTS, pa.int64()), pa.array(np.arange(SEGMENTS)),
            pa.nulls(SEGMENTS, pa.int64()), pa.nulls(SEGMENTS, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary()),
        ],
        names,
    )


def _bucket_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by segment -> one row each with the sums of its buckets."""
    last, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], ["n", "sums"])
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != last:
                if total is not None:
                    yield row()
                last, total = n, np.zeros(len(raw), np.int64)
            total += np.frombuffer(raw, np.uint8)
    if total is not None:
        yield row()


def _ranks(signed: DataFrame) -> np.ndarray:
    """A 16-bit rank of every bucket, growing with its count in the corpus: 2**(BUCKET_BITS + 1) bytes at any size."""
    rows = signed.where("kind = 1").select("n", "sketch").repartition("n").sortWithinPartitions("n").mapInArrow(_bucket_sums, "n long, sums binary").collect()
    out = np.zeros((SEGMENTS, (1 << BUCKET_BITS) // SEGMENTS), np.uint32)
    for n, sums in rows:
        out[n] = np.frombuffer(sums, np.uint32)
    scale = max(1.0, float(out.mean()) / 4096)
    return np.minimum(out.ravel() / scale, 65535).astype(np.uint16)


def _prefixes(heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = heavy.value
        seen = set()
        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column(0)):
                hashes, ends = shingle_sets(words_of(data, offs))
                s1, _ = _signature(hashes, ends)
                ranks = rank[_bucket(hashes)]
                tokens, sizes, keys = [], [], []
                for d, s in enumerate(s1.tolist()):
                    a, b = int(ends[d]), int(ends[d + 1])
                    n = b - a
                    if n == 0 or s in seen:
                        continue
                    seen.add(s)
                    need = n - (4 * n + 4) // 5 + 1
                    # hashes ascend, so a stable order by rank is one by (rank, hash)
                    first = hashes[a:b][np.argsort(ranks[a:b], kind="stable")[:need]]
                    tokens.append(first)
                    sizes.append(n)
                    keys.append(s)
                lens = [len(t) for t in tokens]
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(tokens).view(np.int64)),
                            pa.array(np.repeat(np.array(sizes, np.int32), lens)),
                            pa.array(np.repeat(np.array(keys, np.int64), lens)),
                        ],
                        ["token", "n", "s1"],
                    )

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (token, n, s1) -> pairs that share a token and whose sizes allow a link: all of them in cells
    of up to ``CELL`` rows (sure false), neighbours in order of size in larger ones (sure true)."""
    token, size, key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    long_token = None
    for batch in _with_end(batches):
        if batch is not None:
            token, size, key = (np.concatenate([x, batch.column(c).to_numpy()]) for c, x in enumerate((token, size, key)))
        if not len(token):
            continue
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        start, rows = edges[:-1], np.diff(edges)
        done = np.ones(len(start), bool)
        large = rows > CELL
        if long_token is not None and token[0] == long_token:
            large[0] = True
        if batch is not None and not large[-1]:
            done[-1] = False  # may go on in the next batch
        src, dst, sure = [], [], []
        for k in np.unique(rows[done & ~large & (rows > 1)]).tolist():
            at = start[done & ~large & (rows == k)][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            a, b = at[:, i].ravel(), at[:, j].ravel()
            near = (5 * size[a] >= 4 * size[b]) & (key[a] != key[b])
            src.append(np.minimum(key[a[near]], key[b[near]]))
            dst.append(np.maximum(key[a[near]], key[b[near]]))
            sure.append(np.zeros(int(near.sum()), bool))
        for c in np.flatnonzero(large).tolist():
            a = np.arange(start[c], start[c] + rows[c] - 1)
            near = (5 * size[a] >= 4 * size[a + 1]) & (key[a] != key[a + 1])
            src.append(np.minimum(key[a[near]], key[a[near] + 1]))
            dst.append(np.maximum(key[a[near]], key[a[near] + 1]))
            sure.append(np.ones(int(near.sum()), bool))
        keep = start[-1] if not done[-1] else len(token) - 1  # of a large cell its last row goes on
        long_token = token[-1] if large[-1] else None
        token, size, key = token[keep:], size[keep:], key[keep:]
        if src:
            x, y, z = np.concatenate(src), np.concatenate(dst), np.concatenate(sure)
            _, first = np.unique(mix(x.view(np.uint64)) * np.uint64(2) + mix(y.view(np.uint64)) * np.uint64(7) + z, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(y[first]), pa.array(z[first])], ["src", "dst", "sure"])


def _with_end(batches):
    yield from batches
    yield None


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst, sizes and sketches of pairs -> those whose sketches do not rule a link out: linked sets differ in
    (n + m) / 9 elements at most."""
    for batch in batches:
        src, dst, n, m, a, b = (batch.column(c).to_pylist() for c in range(6))
        keep = pa.array([9 * differing_cells(x, y) <= p + q for x, y, p, q in zip(a, b, n, m)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["src", "dst"])


def linked(shared, a, b):
    return 100 * shared >= 80 * (a + b - shared)


class Pivots:
    """Exact distances of sets to a few pivot sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(token, kind="stable")
        self.token, self.owner = token[order], owner[order]

    def shared(self, s: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.token, s), np.searchsorted(self.token, s, "right")
        hit = b > a
        a, n = a[hit], (b - a)[hit]
        if not len(a):
            return np.zeros(len(self.sizes), np.int64)
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))

    def to(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(linked, distance) to each pivot."""
        both = self.shared(s)
        return linked(both, len(s), self.sizes), 1 - both / (len(s) + self.sizes - both)


def cells_of(d: np.ndarray) -> list[int]:
    """The cells that a member at distances d from the pivots takes part in; -1: far from all.

    What is 0.8 or more from all pivots is at home in -1 and can link with members at 0.6 or more
    only, which are there too; what is nearer links with members less than 1 from its pivot."""
    eps = 1e-9
    near = d.min()
    out = [-1] if near >= 0.6 - eps else []
    if near < 0.8:
        out += np.flatnonzero((d <= near + 0.4 + eps) & (d < 1)).tolist()
    return out


class Links:
    """Links found so far among numbered sets, as a union-find forest."""

    def __init__(self, n: int):
        self.root = list(range(n))
        self.pairs: list[tuple[int, int]] = []

    def find(self, a: int) -> int:
        while self.root[a] != a:
            self.root[a] = self.root[self.root[a]]
            a = self.root[a]
        return a

    def add(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.root[max(x, y)] = min(x, y)
            self.pairs.append((a, b))

    def apart(self, members: list[int]) -> set[int]:
        """The members outside the component that most of them are in."""
        roots = [self.find(m) for m in members]
        most = max(set(roots), key=roots.count) if len(set(roots)) < 50 else np.bincount(roots).argmax()
        return {m for m, r in zip(members, roots) if r != most}


def compare(sets: list[np.ndarray], members: list[int], links: Links) -> None:
    """Add the links among some sets. Shared shingles are counted over an inverted index: common
    shingles by a matrix product, the others by the pairs of their few owners."""
    size = np.array([len(sets[m]) for m in members])
    n = len(members)
    token = np.concatenate([sets[m] for m in members])
    row = np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    start, owners = edges[:-1], np.diff(edges)
    both = np.zeros(n * n)
    common = max(8, n // 8)
    for k in np.unique(owners[(owners > 1) & (owners < common)]).tolist():
        at = start[owners == k]
        for i in range(0, len(at), max(1, 2_000_000 // (k * k))):
            rows = row[at[i : i + max(1, 2_000_000 // (k * k)), None] + np.arange(k)]
            both += np.bincount((rows[:, :, None] * n + rows[:, None, :]).ravel(), minlength=n * n)
    both = both.reshape(n, n)
    often = np.flatnonzero(owners >= common)
    step = max(256, 4_000_000 // n)
    for i in range(0, len(often), step):
        part = often[i : i + step]
        m = np.zeros((n, len(part)), np.float32)
        m[row[_ranges(start[part], owners[part])], np.repeat(np.arange(len(part)), owners[part])] = 1
        both += m @ m.T
    hit = np.triu(linked(np.rint(both).astype(np.int64), size[:, None], size[None, :]), 1)
    for a, b in zip(*(x.tolist() for x in np.nonzero(hit))):
        links.add(members[a], members[b])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def region_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of a region that connect all its linked sets, by pivots and cells in turn. What one
    component holds needs no more comparison within it; a region that its cells would not make
    cheaper is compared directly."""
    links = Links(len(sets))
    stack = [list(range(len(sets)))]
    while stack:
        members = stack.pop()
        if len(members) < 2 or not links.apart(members):
            continue
        if len(members) <= LEAF:
            compare(sets, members, links)
            continue
        pivots = members[:: max(1, len(members) // 8)][:8]
        at = Pivots([sets[p] for p in pivots])
        near: dict[int, list[tuple[float, int]]] = {}
        for m in members:
            link, d = at.to(sets[m])
            for k in np.flatnonzero(link).tolist():
                links.add(m, pivots[k])
            if m not in pivots:
                for c in cells_of(d):
                    near.setdefault(c, []).append((float(d[c]) if c >= 0 else 1.0, m))
        others = links.apart(members)
        cells, cost = [], 0
        for rows in near.values():
            away = links.apart([m for _, m in rows])
            if away:
                low, high = min(d for d, m in rows if m in away), max(d for d, m in rows if m in away)
                cells.append([m for d, m in rows if low - 0.2 - 1e-9 <= d <= high + 0.2 + 1e-9])
                cost += len(cells[-1]) ** 2
        if 2 * cost < len(members) ** 2:
            stack.extend(cells)
        elif others:
            compare(sets, members, links)
    return links.pairs


def _stars(ids: np.ndarray, links: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    if not links:
        return ids[:0], ids[:0]
    pairs = np.array(links)
    node, root = local_roots(ids[pairs[:, 0]], ids[pairs[:, 1]])
    return node, root


def _texts_to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """region, cid, n, s1, s2, text -> region, cid, shingles (bytes of sorted uint64); rows whose text
    is another one under the same doc_id go."""
    for batch in batches:
        for i, j, data, offs in text_chunks(batch.column(5)):
            hashes, ends = shingle_sets(words_of(data, offs))
            s1, s2 = _signature(hashes, ends)
            part = batch.slice(i, j - i)
            own = (part.column(3).to_numpy() == s1) & (part.column(4).to_numpy() == s2) & (part.column(2).to_numpy() == np.diff(ends))
            raw = [hashes[ends[k] : ends[k + 1]].tobytes() for k in np.flatnonzero(own).tolist()]
            mask = pa.array(own)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask), pa.array(raw, pa.binary())], ["region", "cid", "shingles"])


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal first ``keys`` columns, from batches in which they are consecutive."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(keys)]
        cut = np.zeros(batch.num_rows + 1, bool)
        cut[0] = cut[-1] = True
        for c in cols:
            cut[1:-1] |= c[1:] != c[:-1]
        edges = np.flatnonzero(cut).tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _decode(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _join_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small regions: links as stars."""
    for run in runs(batches, 1):
        ids, first = np.unique(run.column("cid").to_numpy(), return_index=True)
        sets = _decode(run.column("shingles").take(pa.array(first)))
        node, root = _stars(ids, region_links(sets))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["src", "dst"])


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches, 3):
        ids, first = np.unique(run.column("cid").to_numpy(), return_index=True)
        links = Links(len(ids))
        compare(_decode(run.column("shingles").take(pa.array(first))), list(range(len(ids))), links)
        node, root = _stars(ids, links.pairs)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["src", "dst"])


def _split_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by region, salt, kind (pivots first). Emits links to pivots (region null) and
    the cells of the other members: region, pivot of the cell, cid, distance."""
    names = ["region", "pivot", "cid", "d"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    for pivots, ids, rows in _runs_streamed(batches):
        out: list = []
        for region, cid, raw in rows:
            link, d = pivots.to(np.frombuffer(raw, np.uint64))
            out.extend((None, ids[k], cid, 0.0) for k in np.flatnonzero(link).tolist() if ids[k] != cid)
            if cid not in ids:
                out.extend((region, ids[c] if c >= 0 else -1, cid, float(d[c]) if c >= 0 else 1.0) for c in cells_of(d))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _runs_streamed(batches):
    """(pivots, their ids, member rows) of each (region, salt), at most one batch of members at a time."""
    held, key, at, ids = [], None, None, []
    for batch in batches:
        region, salt, kind, cid, raw = (batch.column(k).to_pylist() for k in range(5))
        rows = []
        for r, s, k, c, x in zip(region, salt, kind, cid, raw):
            if (r, s) != key:
                if rows:
                    yield at, ids, rows
                    rows = []
                key, held, ids, at = (r, s), [], [], None
            if k == 0:
                held.append(np.frombuffer(x, np.uint64))
                ids.append(c)
            else:
                if at is None:
                    at = Pivots(held)
                rows.append((r, c, x))
        if rows:
            yield at, ids, rows


def _large_regions(tmp: Scratch, rows: DataFrame) -> list[DataFrame]:
    """rows: region, cid, shingles of all outer regions. Returns tables of links (src, dst)."""
    links = []
    for k in range(MAX_ROUNDS + 1):
        size = rows.groupBy("region").agg(F.count("*").alias("sets"), F.sum(F.length("shingles") / 8).alias("load"))
        size = tmp.save(size, f"sizes{k}")
        fits = (F.col("sets") <= REGION_SETS) & (F.col("load") <= REGION_SHINGLES)
        small = rows.join(size.where(fits).select("region"), "region", "left_semi")
        links.append(tmp.save(_in_tasks(small), f"links{k}"))
        size = size.where(~fits)
        if not size.limit(1).count():
            tmp.drop(rows)
            break
        big = rows.join(size, "region")
        if k == MAX_ROUNDS:
            links.append(tmp.save(_by_blocks(big), "blocks"))
            tmp.drop(rows)
            break
        salts = F.ceil(F.col("sets") / SALT_SETS).cast("int")
        draw = F.pmod(F.xxhash64("cid", F.lit(k)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        lowest = rows.join(size, "region", "left_semi").groupBy("region").agg(F.min(F.struct(F.xxhash64("cid", F.lit(k)), "cid")).alias("p"))
        chosen = big.join(lowest.select("region", F.col("p.cid").alias("lowest")), "region")
        pivots = chosen.where((draw < F.lit(PIVOTS) / F.col("sets")) | (F.col("cid") == F.col("lowest"))).select(
            "region", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "cid", "shingles"
        )
        members = big.select("region", F.pmod(F.xxhash64("cid"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "cid", "shingles")
        routed = (
            pivots.unionByName(members)
            .repartition("region", "salt")
            .sortWithinPartitions("region", "salt", "kind", "cid")
            .mapInArrow(_split_regions, "region long, pivot long, cid long, d double")
        )
        routed = tmp.save(routed, f"routed{k}")
        found = tmp.save(routed.where("region is null").select(F.col("cid").alias("src"), F.col("pivot").alias("dst")), f"near{k}")
        links.append(found)
        part = connected_components(found).select(F.col("node").alias("cid"), "component")
        cells = routed.where("region is not null").join(part, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        # a cell needs those outside its largest component, and what they can reach in that one
        count = cells.groupBy("region", "pivot", "component").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
        most = count.groupBy("region", "pivot").agg(F.max(F.struct("n", "component")).alias("most"))
        away = (
            count.join(most, ["region", "pivot"])
            .where("component <> most.component")
            .groupBy("region", "pivot")
            .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        )
        cells = tmp.save(
            cells.join(away, ["region", "pivot"]).where("d between low - 0.2000001 and high + 0.2000001").select("region", "pivot", "cid"), f"cells{k}"
        )
        cost = cells.groupBy("region", "pivot").agg(F.count("*").alias("n")).groupBy("region").agg(F.sum(F.col("n") * F.col("n")).alias("cost"))
        cost = tmp.save(size.join(cost, "region").select("region", "sets", (F.col("cost") * 2 > F.col("sets") * F.col("sets")).alias("stuck")), f"cost{k}")
        stuck = rows.join(cost.where("stuck").select("region", "sets"), "region")
        links.append(tmp.save(_by_blocks(stuck), f"blocks{k}"))
        on = cells.join(cost.where("not stuck").select("region"), "region", "left_semi").join(rows, ["region", "cid"])
        after = tmp.save(on.select(F.xxhash64("region", "pivot", F.lit(k)).alias("region"), "cid", "shingles"), f"rows{k}")
        tmp.drop(rows, cells, cost)
        rows = after
    return links


def _in_tasks(rows: DataFrame) -> DataFrame:
    return rows.select("region", "cid", "shingles").repartition("region").sortWithinPartitions("region").mapInArrow(_join_regions, "src long, dst long")


def _by_blocks(rows: DataFrame) -> DataFrame:
    """Exact join of each region by pairs of blocks; a member goes to one pair for each block."""
    blocks = F.ceil(F.col("sets") / BLOCK).cast("int")
    own = rows.withColumn("b", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return (
        own.select("region", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "cid", "shingles")
        .repartition("region", "i", "j")
        .sortWithinPartitions("region", "i", "j")
        .mapInArrow(_join_blocks, "src long, dst long")
    )


def _row_keys(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _labelled(tmp: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, s1, s2 of every row; s1, s2, n, rep, component, component_id of every class with shingles)."""
    spark = rows.sparkSession
    signed = tmp.save(rows.mapInArrow(_sign, "kind int, doc_id long, n long, s1 long, s2 long, sketch binary"), "signed", partition_by="kind")
    heavy = spark.sparkContext.broadcast(_ranks(signed))
    own = signed.where("kind = 0")
    classes = own.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.max("sketch").alias("sketch"))
    classes = tmp.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    own = tmp.save(own.select("doc_id", "n", "s1", "s2"), "own")
    tmp.drop(signed)
    pairs = (
        rows.select("text")
        .mapInArrow(_prefixes(heavy), "token long, n int, s1 long")
        .repartition("token")
        .sortWithinPartitions("token", "n", "s1")
        .mapInArrow(_candidates, "src long, dst long, sure boolean")
        .distinct()
    )
    pairs = tmp.save(pairs, "pairs")
    heavy.destroy()
    side = classes.select("s1", "n", "sketch")
    tested = (
        pairs.where("not sure")
        .join(side.withColumnsRenamed({"s1": "src", "n": "n1", "sketch": "k1"}), "src")
        .join(side.withColumnsRenamed({"s1": "dst", "n": "n2", "sketch": "k2"}), "dst")
        .select("src", "dst", "n1", "n2", "k1", "k2")
        .mapInArrow(_plausible, "src long, dst long")
    )
    plausible = tmp.save(tested.unionByName(pairs.where("sure").select("src", "dst")), "plausible")
    light = tmp.save(classes.drop("sketch"), "light")
    tmp.drop(pairs, classes)
    regions = connected_components(plausible)
    members = tmp.save(light.join(regions.select(F.col("node").alias("s1"), F.col("component").alias("region")), "s1"), "members")
    tmp.drop(plausible)
    # texts outside the regions stay where they are
    wanted = members.select("region", "cid", "n", "s1", "s2", _id("rep").alias("id"))
    # an id of several rows names several classes: those are told apart by signature, and one text of each is fetched
    repeated = own.groupBy(_id("doc_id").alias("id")).agg(F.count("*").alias("_n")).where("_n > 1").select("id")
    repeated = tmp.save(repeated, "repeated")
    several = bool(repeated.limit(1).count())
    single = wanted.join(repeated, "id", "left_anti") if several else wanted
    known = IdFilter(single.select("id"))
    found = single.join(rows.select(_id("doc_id").alias("id"), "text").where(known.may_have(F.col("id"))), "id")
    sets = found.select("region", "cid", "n", "s1", "s2", "text").mapInArrow(_texts_to_sets, "region long, cid long, shingles binary")
    filters = [known]
    if several:
        asked = wanted.join(repeated, "id", "left_semi")
        filters.append(IdFilter(asked.select("id")))
        keys = ["id", "s1", "s2", "n"]
        judged = rows.select(_id("doc_id").alias("id"), "text").withColumn("_s", _judge(filters[1], F.col("id"), F.col("text")))
        each = judged.where("_s.hit").select("id", "_s.s1", "_s.s2", "_s.n", "text").groupBy(*keys).agg(F.first("text").alias("text"))
        more = asked.join(each, keys).select("region", "cid", "n", "s1", "s2", "text")
        sets = sets.unionByName(more.mapInArrow(_texts_to_sets, "region long, cid long, shingles binary"))
    sets = tmp.save(sets, "sets")
    for f in filters:
        f.destroy()
    tmp.drop(members, repeated)
    links = _large_regions(tmp, sets)
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    joined = connected_components(found).select(F.col("node").alias("cid"), "component")
    labelled = light.join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    labelled = tmp.save(labelled.join(labelled.groupBy("component").agg(F.min("rep").alias("component_id")), "component"), "labelled")
    tmp.drop(light, *links)
    return own, labelled


def _id(value: Column | str) -> Column:
    """An id that joins, null included."""
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("long"), F.lit(-(2**63)).cast("long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    own, labelled = _labelled(Scratch(docs.sparkSession, "jaccard"), _row_keys(docs))
    return own.join(labelled.select("s1", "s2", "n", "component_id"), ["s1", "s2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _judge(known: IdFilter, value: Column, text: Column) -> Column:
    """s1, s2, n of the rows whose id may be in the filter (hit true); one call of Python for both."""
    hits = known.probe()

    @F.arrow_udf("struct<hit: boolean, s1: long, s2: long, n: long>")
    def judge(a: pa.Array, b: pa.Array, text: pa.Array) -> pa.Array:
        hit = hits(a, b)
        out = np.zeros((3, len(hit)), np.int64)
        at = np.flatnonzero(hit)
        done = 0
        for _, _, data, offs in text_chunks(text.filter(pa.array(hit))):
            hashes, ends = shingle_sets(words_of(data, offs))
            rows = at[done : done + len(offs) - 1]
            out[0, rows], out[1, rows] = _signature(hashes, ends)
            out[2, rows] = np.diff(ends)
            done += len(rows)
        return pa.StructArray.from_arrays([pa.array(hit), *map(pa.array, out)], ["hit", "s1", "s2", "n"])

    # else the filter on its result would call it once more
    return judge.asNondeterministic()(*known.places(value), text)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of ``docs``: one whose doc_id is the smallest there (null: if all are). Rows
    without shingles all stay. Only rows whose doc_id has something to leave out go through a shuffle."""
    tmp = Scratch(docs.sparkSession, "jaccard-kept")
    own, labelled = _labelled(tmp, _row_keys(docs))
    chosen = labelled.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("_"), "rep", "s1", "s2", "n")).alias("c"))
    chosen = chosen.select(_id("c.rep").alias("id"), "c.s1", "c.s2", "c.n", F.lit(True).alias("best"))
    keys = ["id", "s1", "s2", "n"]
    rows = own.where("n > 0").select(_id("doc_id").alias("id"), "s1", "s2", "n").groupBy(*keys).agg(F.count("*").alias("rows"))
    fate = rows.join(chosen, keys, "left").where("best is null or rows > 1").select(*keys, F.coalesce("best", F.lit(False)).alias("best"))
    fate = tmp.save(fate, "fate")
    tmp.drop(own, labelled)
    known = IdFilter(fate.select("id"))
    packed = docs.select(as_row(docs).alias("_row"), _id(F.col("doc_id")).alias("id"))
    out = packed.where(~known.may_have(F.col("id"))).select("_row.*")
    judged = packed.withColumn("_s", _judge(known, F.col("id"), F.col("_row.text").cast("string"))).where("_s.hit").select("_row", "id", "_s.s1", "_s.s2", "_s.n")
    judged = judged.join(fate, keys, "left")
    out = out.unionByName(judged.where("best is null").select("_row.*"))
    if fate.where("best").limit(1).count():  # rows repeated whole
        out = out.unionByName(judged.where("best").dropDuplicates(keys).select("_row.*"))
    return out


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
#: The relations of the oracle; ``reach`` has (doc_id, component_id) of linked documents.
ORACLE_WITH = f"""dw AS ({sql.words("documents", "doc_id")}), ds AS ({sql.shingles("dw", "doc_id")}),
n AS (SELECT doc_id, count(*) AS n FROM ds GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM ds a JOIN ds b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM j JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * s >= 80 * (x.n + y.n - s)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
reach AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM r GROUP BY a)"""
ORACLE = {
    "op4_jaccard_join": f"""WITH RECURSIVE {ORACLE_WITH}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(component_id, d.doc_id) AS BIGINT) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id)"""
}
