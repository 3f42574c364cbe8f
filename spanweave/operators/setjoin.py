"""Exact Jaccard join of sets at low thresholds, where bands of signatures would find nothing more cheaply than all pairs.

Items are numbered from the rarest on. Two sets at a Jaccard of t share an item among the first n - ceil(t * n) + 1 of either, so only those are listed;
what sizes and places in the order rule out goes before a pair is made, and the pairs that are left are compared whole. Nothing is missed.

Work grows with the pairs that share a listed item: at 0.05 that leaves out the commonest twentieth of a set and the items of one set only.
Lists of a common item are cut into blocks, and two blocks meet in a task. What goes through the shuffle is not a row for each pair that meets at an item, but a row for each set
there, with those that it meets packed at about six bytes each.

Defined cases: null keys and items do not count, repeated rows count once, a key without items has no pairs; sets that are equal are one class, named by its smallest key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators.tables import number_rows
from spanweave.scratch import Scratch

#: Rows of a common item's list that are compared with as many others at a time.
BLOCK = 1024
#: An item in more than this part of all rows is numbered by a broadcast; there are at most that many such items.
HEAVY = 10_000


def _numbered(rows: DataFrame, items: list[str]) -> DataFrame:
    """_key, _id, _blocks of the rows whose item is in two sets or more; rarer items have smaller numbers."""
    shared = rows.groupBy(*items).agg(F.count("*").alias("_f")).where("_f > 1")
    ids = Scratch(rows.sparkSession, "items").save(number_rows(shared, "_f", *items, name="_id"), "ids")
    ids = ids.withColumn("_blocks", F.ceil(F.col("_f") / BLOCK).cast("int"))
    common = ids.where(F.col("_f") * HEAVY > rows.count())
    rest = rows.join(F.broadcast(common.select(*items)), items, "left_anti").join(ids.hint("merge"), items)
    return rows.join(F.broadcast(common), items).unionByName(rest).select("_key", "_id", "_blocks")


def set_classes(rows: DataFrame, key: str, items: list[str]) -> DataFrame:
    """key, rep, n, ids, blocks: of each set its class (the smallest key of equal sets), its size, and the numbers of the items that other sets have too, in order."""
    rows = rows.select(F.col(key).alias("_key"), *items).dropna().distinct()
    rows = Scratch(rows.sparkSession, "sets").save(rows, "rows")
    held = _numbered(rows, items).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_id", "_blocks"))).alias("_s"))
    sizes = rows.groupBy("_key").agg(F.count("*").alias("n"))
    sets = sizes.join(held, "_key").select("_key", "n", F.col("_s._id").alias("ids"), F.col("_s._blocks").alias("blocks"))
    # a set with an item of its own has no equal; 128 bits tell the others apart
    own = F.when(F.size("ids") < F.col("n"), F.col("_key"))
    sets = sets.withColumns({"_own": own, "_h1": F.xxhash64("ids"), "_h2": F.xxhash64(F.lit(1), "ids")})
    sets = Scratch(rows.sparkSession, "sets").save(sets, "sets")
    least = sets.where("_own is null").groupBy("_h1", "_h2").agg(F.min("_key").alias("_rep"))
    named = sets.join(least, ["_h1", "_h2"], "left")
    return named.select(F.col("_key").alias(key), F.coalesce("_own", "_rep").alias("rep"), "n", "ids", "blocks")


def _listed(sets: DataFrame, least: float) -> DataFrame:
    """_id, _c1, _c2, _at, key, n, place: the first items of each set; place is that in the whole set, from 1, items of its own before all others."""
    alone = F.col("n") - F.size("ids")
    many = F.greatest(F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    first = sets.select("key", "n", alone.alias("_alone"), F.posexplode(F.arrays_zip(F.slice("ids", 1, many).alias("i"), F.slice("blocks", 1, many).alias("b"))).alias("_k", "_x"))
    at = F.pmod(F.xxhash64("key"), F.col("_x.b")).cast("int")
    cells = first.select("key", "n", (F.col("_alone") + F.col("_k") + 1).alias("place"), F.col("_x.i").alias("_id"), at.alias("_at"), F.explode(F.sequence(F.lit(0), F.col("_x.b") - 1)).alias("_o"))
    return cells.select("_id", F.least("_at", "_o").alias("_c1"), F.greatest("_at", "_o").alias("_c2"), "_at", "key", "n", "place")


def _dense(sets: DataFrame) -> DataFrame:
    """``key`` (from ``monotonically_increasing_id``: 33 bits in each task) as a number below that of the rows."""
    task, place = F.shiftright("key", 33), F.col("key").bitwiseAND((1 << 33) - 1)
    sizes = sorted(map(tuple, sets.groupBy(task.alias("t")).count().collect()))
    begins, run = [], 0
    for t, n in sizes:
        begins.append((t, run))
        run += n
    offsets = sets.sparkSession.createDataFrame(begins, "_t long, _begin long")
    return sets.join(F.broadcast(offsets), task == F.col("_t")).withColumn("key", F.col("_begin") + place).drop("_t", "_begin")


#: Pairs that a task holds before it counts them.
HELD = 1 << 21


def _met(least: float):
    """Listed rows ordered by their cell -> a, its size, and the others that meet it there, packed: their keys, sizes, and the most items that they can share with a from here on."""

    def pairs(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        key, n, at, left = rows["key"], rows["n"], rows["_at"], rows["n"] - rows["place"]
        order = np.argsort(key)
        key, n, at, left = key[order], n[order], at[order], left[order]
        a, b = np.triu_indices(len(key), 1)
        ok = np.minimum(n[a], n[b]) >= np.maximum(n[a], n[b]) * least - 1e-9
        if rows["_c1"][0] != rows["_c2"][0]:
            ok &= at[a] != at[b]
        a, b = a[ok], b[ok]
        return key[a], n[a], key[b], n[b], np.minimum(left[a], left[b]) + 1

    def packed(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, n, b, m, most = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(a, kind="stable")
        a, n, b, m, most = a[order], n[order], b[order], m[order], most[order]
        edges = np.concatenate([np.flatnonzero(np.diff(a, prepend=a[0] - 1)), [len(a)]]).tolist()
        raw = [_coded(b[i:j], m[i:j], most[i:j]) for i, j in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(a[edges[:-1]]), pa.array(n[edges[:-1]]), pa.array(raw, pa.binary())], ["a", "n", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in _groups(batches, ("_id", "_c1", "_c2"), ("_c1", "_c2", "_at", "key", "n", "place")):
            found = pairs(rows)
            if len(found[0]):
                held.append(found)
                size += len(found[0])
            if size >= HELD:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def _coded(*columns: np.ndarray) -> bytes:
    """Whole numbers that are not negative, each column with as few bytes as its largest one needs."""
    kinds = [np.min_scalar_type(c.max()) for c in columns]
    return bytes(k.itemsize for k in kinds) + b"".join(c.astype(k).tobytes() for c, k in zip(columns, kinds))


def _decoded(raw: bytes, columns: int = 3) -> list[np.ndarray]:
    wide = list(raw[:columns])
    rows, at, out = (len(raw) - columns) // sum(wide), columns, []
    for w in wide:
        out.append(np.frombuffer(raw, f"u{w}", rows, at).astype(np.int64))
        at += w * rows
    return out


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each group, which follow each other."""
    last, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in by]
        rows = {c: batch.column(c).to_numpy() for c in columns}
        new = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges[:-1], edges[1:]):
            own = tuple(k[i] for k in keys)
            if parts and own != last:
                yield {c: np.concatenate([p[c] for p in parts]) for c in columns}
                parts = []
            last = own
            parts.append({c: v[i:j] for c, v in rows.items()})
    if parts:
        yield {c: np.concatenate([p[c] for p in parts]) for c in columns}


def _counted(a, n, b, m, most, count) -> tuple[np.ndarray, ...]:
    """Each pair once: the most that it can share, and how often it met."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], n[order][first], b[first], m[order][first], np.maximum.reduceat(most[order], first), np.add.reduceat(count[order], first)


def _candidates(least: float):
    """Rows ordered by a -> the pairs that can reach the threshold: from the first item that both have on there are enough items left, and the listed ones in common with all that one of
    the two does not list are enough."""

    def good(a, n, b, m, most, count) -> pa.RecordBatch:
        need = (n + m) * (least / (1 + least)) - 1e-9
        ok = (most >= need) & (count + np.ceil(np.maximum(n, m) * least - 1e-9) - 1 >= need)
        return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x, n, raw in zip(batch.column(0).to_numpy().tolist(), batch.column(1).to_numpy().tolist(), batch.column(2).to_pylist()):
                b, m, most = _decoded(raw)
                k = len(b)
                if size + k > HELD and held:
                    held, size = [_counted(*(np.concatenate(c) for c in zip(*held)))], 0
                    done = held[0][0] != x  # the rows of x may not be all
                    if done.any():
                        yield good(*(c[done] for c in held[0]))
                    held = [tuple(c[~done] for c in held[0])]
                held.append((np.full(k, x), np.full(k, n), b, m, most, np.ones(k, np.int64)))
                size += k
        if size or any(len(h[0]) for h in held):
            yield good(*_counted(*(np.concatenate(c) for c in zip(*held))))

    return run


def similar_classes(classes: DataFrame, key: str, least: float) -> DataFrame:
    """``similar_sets`` of the classes that ``set_classes`` gives."""
    if not 0 < least <= 1:
        raise ValueError("the least Jaccard must be over 0 and at most 1")
    scratch = Scratch(classes.sparkSession, "similar")
    sets = classes.where(F.col(key) == F.col("rep")).select(F.col("rep").alias("_rep"), "n", "ids", "blocks", F.monotonically_increasing_id().alias("key"))
    sets = _dense(scratch.save(sets, "classes"))
    cell = ["_id", "_c1", "_c2"]
    met = _listed(sets, least).repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_met(least), "a long, n long, others binary")
    pairs = scratch.save(met.repartition("a").sortWithinPartitions("a").mapInArrow(_candidates(least), "a long, b long"), "pairs")
    whole = lambda c: sets.select(F.col("key").alias(c), F.col("_rep").alias(f"_r{c}"), F.col("n").alias(f"_n{c}"), F.col("ids").alias(f"_i{c}"))
    both = pairs.join(whole("a"), "a").join(whole("b"), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("_ia", "_ib")).cast("long"))
    both = both.withColumn("jaccard", F.col("shared") / (F.col("_na") + F.col("_nb") - F.col("shared")))
    return both.where(F.col("jaccard") >= least).select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b"), "shared", "jaccard")


def similar_sets(rows: DataFrame, key: str, items: list[str], least: float) -> DataFrame:
    """a, b, shared, jaccard: all pairs (a < b) of different sets with a Jaccard of ``least`` or more. ``rows`` holds an item (the columns ``items``) of a set (``key``) in each row; of
    equal sets the smallest key stands for all (``set_classes`` lists them)."""
    return similar_classes(set_classes(rows, key, items), key, least)
