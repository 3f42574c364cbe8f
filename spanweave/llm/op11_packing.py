"""Best-fit packing of tokenised documents into sequences, by minimum bin slack.

1. Each task tokenises its texts: a text is cut at single ASCII white space between visible characters, where the tokenizer never goes across, and
   the library tokenises each distinct piece of text once for a stretch of text. A document is its ids and an end id; a longer one than a sequence is cut into
   full pieces, with the shorter piece first. A full piece is a sequence of its own.
2. Only the number of pieces of each length matters for the packing: ``capacity - 1`` counts, whatever the input. The driver fills one sequence
   after another: the longest piece left, and the fullest combination of other lengths, found by a subset-sum over available lengths in a
   bitset. The combination is taken as often as the counts allow, so the plan has some thousand rows at most: each combination
   uses up a length (or leaves fewer of it than it takes).
3. Pieces of one length are numbered (by task, then within it), and the plan says for each number which sequence and which place it gets.

Defined cases: null text counts as empty (the end id alone); repeated rows and null or repeated doc_ids are documents of their own; an empty table
gives no rows; columns other than doc_id and text are ignored. Special strings inside texts are tokenised as the library does by default.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.llm.op06_token_counts import tokenizer_path
from spanweave.llm.text import distinct_keys, span_keys, text_chunks
from spanweave.llm.vocab import lookup
from spanweave.scratch import Scratch

TOKENIZER, CAPACITY, END = "byte_bpe_50k.json", 1024, 2
#: Bytes of text whose spans are looked up together, and bytes of the spans that a task keeps ids for.
TOGETHER, KEPT = 4 << 20, 24 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def span_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where spans of texts begin: at texts, at one white space byte between visible characters, and at a stop behind a letter or digit. Visible are
    ASCII ones and those of U+00C0 to U+00FF (two bytes, the first of them C3); near others, which may be white space as well, nothing is cut."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        latin = np.zeros(n, bool)
        latin[1:] = (data[1:] >= 0x80) & (data[:-1] == 0xC3)
        visible = _VISIBLE[data]
        cut[1:-1] = _WHITE[data[1:-1]] & (visible | latin)[:-2] & (visible | (data == 0xC3))[2:]
        cut[1:] |= _STOP[data[1:]] & (_LETTER[data] | latin & (data != 0x97) & (data != 0xB7))[:-1]
    edges = offs[:-1][np.diff(offs) > 0]
    last = offs[1:][np.diff(offs) > 0] - 1
    cut[last[_WHITE[data[last]]]] = False  # the character behind it is of another text
    cut[edges] = True
    return np.flatnonzero(cut)


class SpanIds:
    """Token ids of spans, kept from one stretch of text to the next up to ``KEPT`` bytes of spans."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self._begin()

    def _begin(self) -> None:
        self.first, self.second, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ends, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def of(self, first: np.ndarray, second: np.ndarray, spell) -> np.ndarray:
        """The slot of each of some distinct spans, given by their keys in ascending order; ids of slot s are ids[ends[s]:ends[s + 1]].
        ``spell`` gives the bytes of spans by their numbers."""
        if self.size > KEPT:
            self._begin()
        at, known = lookup(self.first, first)
        if len(self.first):
            known &= self.second[at] == second
        slots, new = np.empty(len(first), np.int64), np.flatnonzero(~known)
        if len(self.first):
            slots[known] = self.slot[at[known]]
        found, lens = [self.ids], []
        for i in range(0, len(new), 2000):
            spelt = spell(new[i : i + 2000])
            self.size += sum(map(len, spelt))
            each = [e.ids for e in self.tok.encode_batch_fast([s.decode("utf-8", "replace") for s in spelt], add_special_tokens=False)]
            found.append(np.fromiter(chain.from_iterable(each), np.uint32))
            lens += map(len, each)
        slots[new] = len(self.ends) - 1 + np.arange(len(new))
        self.ids = np.concatenate(found)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens, dtype=np.int64)])
        place = np.searchsorted(self.first, first[new])
        self.first, self.second, self.slot = (np.insert(old, place, values[new]) for old, values in ((self.first, first), (self.second, second), (self.slot, slots)))
        return slots


@cache
def _spans(path: str) -> SpanIds:
    """One for each Python worker, for all its tasks; what it holds changes no result."""
    return SpanIds(path)


def token_ids(spans: SpanIds, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's ids end), without end ids."""
    starts = span_starts(data, offs)
    if len(starts) == 0:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    keys, ends = span_keys(data, starts), np.append(starts[1:], len(data))
    at, number = distinct_keys(*keys)
    slot = spans.of(keys[0][at], keys[1][at], lambda new: [data[a:b].tobytes() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])[number]
    first, lens = spans.ends[slot], spans.ends[slot + 1] - spans.ends[slot]
    upto = np.concatenate([[0], np.cumsum(lens)])
    ids = spans.ids[np.arange(upto[-1]) + np.repeat(first - upto[:-1], lens)]
    return ids, upto[np.searchsorted(starts, offs)]


def _number(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many rows of the same length came before each row; ``seen`` goes on from call to call."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(ordered)) - np.repeat(begins, np.diff(np.append(begins, len(ordered)))) + seen[ordered]
    np.add.at(seen, lengths, 1)
    return out


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spans, seen, task = _spans(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for i, _, data, offs in text_chunks(batch.column(1), TOGETHER):
                ids, ends = token_ids(spans, data, offs)
                rows, piece, start, length, crc = [], [], [], [], []
                for d in range(len(offs) - 1):
                    own = np.append(ids[ends[d] : ends[d + 1]], np.uint32(end)).astype("<u4")
                    raw, n = own.tobytes(), len(own)
                    a, k = 0, 0
                    while a < n:
                        b = a + capacity if k or n <= capacity or n % capacity == 0 else n % capacity
                        b = min(b, n)
                        rows.append(i + d)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                        a, k = b, k + 1
                length = np.array(length, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                        pa.array(np.full(len(length), task, np.int32)),
                        pa.array(_number(length, seen)),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "k"],
                )

    return run


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, k long"


def fullest(counts: list[int], room: int, longest: int) -> dict[int, int]:
    """How many of each length up to ``longest`` give the largest sum within ``room``: a subset-sum over the available copies, where bit s
    of ``reach`` says that a sum of s can be had. Longer lengths are tried first, so shorter ones are kept for later."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in range(min(room, longest), 0, -1):
        copies, step = min(counts[length], room // length), 1
        while copies > 0:
            step = min(step, copies)
            steps.append((reach, length, step))
            reach |= (reach << (length * step)) & mask
            copies, step = copies - step, step * 2
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, {}
    for before, length, step in reversed(steps):
        if not (before >> total) & 1:
            taken[length] = taken.get(length, 0) + step
            total -= length * step
    return taken


def plan(counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces of it in one sequence}): every piece in one sequence, by the fullest combination with the longest piece left."""
    left, longest, out = list(counts), capacity, []
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return out
        left[longest] -= 1
        taken = fullest(left, capacity - longest, longest)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[n] // c for n, c in taken.items())
        for n, c in taken.items():
            left[n] -= times * c
        out.append((times, dict(sorted(taken.items(), reverse=True))))


def _places(steps: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan by length: from piece number ``first`` of a length on, ``each`` pieces of it go to a sequence from ``sequence`` on, from place ``offset`` on."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, taken in steps:
        offset = 0
        for length, each in taken.items():
            rows.append((length, used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + times * each
            offset += length * each
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(["length", "first", "each", "sequence", "offset"])}


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        for batch in batches:
            at = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number")}
            row = np.empty(batch.num_rows, np.int64)
            for length in np.unique(at["length"]):
                own = at["length"] == length
                a, b = np.searchsorted(steps["length"], [length, length + 1])
                row[own] = a + np.searchsorted(steps["first"][a:b], at["number"][own], "right") - 1
            behind, each = at["number"] - steps["first"][row], steps["each"][row]
            placed = [pa.array(steps["sequence"][row] + behind // each), pa.array(steps["offset"][row] + behind % each * at["length"])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in _OUT[:5]] + placed, _OUT)

    return run


_OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "packing")
    pieces = tmp.save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(path, capacity, end), _PIECE),
        "pieces",
    )
    rest = pieces.where(F.col("length") < capacity)
    # one row for each task and length; numbers of a length go on from task to task
    counts = tmp.save(rest.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = [0] * (capacity + 1)
    for length, n in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[length] = n
    shared = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    bases = counts.select("task", "length", before.alias("before"))
    numbered = rest.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("number"))
    small = numbered.mapInArrow(_placed(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    # sequences of one full piece are numbered below 0
    own = (-1 - F.shiftleft(F.col("task").cast("long"), 40) - F.col("k")).alias("sequence_id")
    full = pieces.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", own, F.lit(0).cast("long").alias("offset"))
    return small.unionAll(full)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(TOKENIZER))


QUERIES = {"op11_packing": op11_packing}
ORACLE: dict[str, str] = {}
