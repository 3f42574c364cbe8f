"""Byte-level word splitting and 64-bit word and shingle hashes, vectorised with numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. These separators are
ASCII, so splitting UTF-8 bytes equals splitting characters. Everything works on the
buffers of an Arrow string column; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _RNG.integers(1, 2**63, 16, dtype=np.uint64)


#: Rows that go to Python at once. Spark's default of 10,000 whole texts takes tens of megabytes, several times over, in each task.
BATCH_ROWS = 1000


def small_batches(spark) -> None:
    """Set the session's Arrow batches to ``BATCH_ROWS`` rows, unless the user has chosen a size of their own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def quoted(name: str) -> str:
    """A column's name as SQL and F.col take it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def as_row(df):
    """One struct of all columns of ``df``."""
    from pyspark.sql import functions as F

    return F.struct(*[F.col(quoted(c)) for c in df.columns])


class Words(NamedTuple):
    """Words of one chunk: byte span, hash, and for document i the words offs[i]:offs[i+1]. ``second``: another
    64 bits of each word's hash, if asked for."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offs: np.ndarray
    second: np.ndarray | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (murmur3's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of consecutive rows with about ``size``
    bytes together; a longer text is a chunk of its own. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off_buf, data_buf = column.buffers()
    offs = np.frombuffer(off_buf, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words_of(data: np.ndarray, doc_offs: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE, second: bool = False) -> Words:
    """Words between the bytes of ``space``; every other byte takes part in the hash."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = doc_offs[(doc_offs > 0) & (doc_offs < n)]  # a word never runs on into the next text
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    offs = np.searchsorted(starts, doc_offs)
    if len(starts) == 0:
        return Words(data, starts, ends, np.zeros(0, np.uint64), offs, np.zeros(0, np.uint64))
    lens = ends - starts
    value = _BYTE_VALUE[data]
    value[~inside] = 0
    at = np.zeros(n, np.int64)
    at[starts[0] :] = np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))
    power = powers(int(lens.max()))
    value *= power[np.minimum(at, len(power) - 1)]
    hashes = mix(np.add.reduceat(value, starts) + lens.astype(np.uint64) * _GRAM[15])
    other = None
    if second:
        # a sum of non-linear terms of the same bytes and places
        value ^= value >> np.uint64(29)
        value *= _GRAM[13]
        other = mix(np.add.reduceat(value, starts) ^ (lens.astype(np.uint64) * _GRAM[14]))
    return Words(data, starts, ends, hashes, offs, other)


def distinct_keys(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of one row for each distinct pair of 64-bit keys, the number in that list of each row)."""
    _, at, inverse = np.unique(first, return_index=True, return_inverse=True)
    if (second[at][inverse] == second).all():
        return at, inverse
    pairs = np.empty(len(first), [("a", np.uint64), ("b", np.uint64)])
    pairs["a"], pairs["b"] = first, second
    _, at, inverse = np.unique(pairs, return_index=True, return_inverse=True)
    return at, inverse


def shingle_sets(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each document, ascending, as one array and offsets.
    A text of 1 to n-1 words has its whole sequence as one shingle; one without words none."""
    h, offs = words.hashes, words.offs
    total = len(h)
    if total >= n:
        grams = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            grams += h[k : total - n + 1 + k] * _GRAM[k]
        grams = mix(grams)
    else:
        grams = np.zeros(0, np.uint64)
    parts, ends = [], np.zeros(len(offs), np.int64)
    for i in range(len(offs) - 1):
        a, b = int(offs[i]), int(offs[i + 1])
        if b - a >= n:
            part = np.unique(grams[a : b - n + 1])
        elif b > a:
            part = mix(np.sum(h[a:b] * _GRAM[: b - a], dtype=np.uint64, keepdims=True) + _SHORT[b - a : b - a + 1])
        else:
            part = np.zeros(0, np.uint64)
        parts.append(part)
        ends[i + 1] = ends[i] + len(part)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), ends


def span_keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span from one start to the next (the last to the end); every byte takes part."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    lens = np.diff(np.append(starts, len(data)))
    power = powers(int(lens.max()))
    value = _BYTE_VALUE[data[starts[0] :]]
    value *= power[np.arange(len(value)) - np.repeat(starts - starts[0], lens)]
    at = starts - starts[0]
    first = mix(np.add.reduceat(value, at) + lens.astype(np.uint64) * _GRAM[15])
    value ^= value >> np.uint64(29)
    value *= _GRAM[13]
    return first, mix(np.add.reduceat(value, at) ^ (lens.astype(np.uint64) * _GRAM[14]))
