"""Tandem-repeat copy number of a motif in a sequence, in Arrow-batched pandas functions.

A motif is aligned inside the sequence with few edits, hits that overlap little are kept, and the
search goes on in what lies between them; the hits are chained and counted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAIR = str.maketrans("ACGTNacgtn", "TGCANtgcan")


def infix_distances(motif: str, text: str) -> np.ndarray:
    """For each end position of ``text`` the fewest edits that turn the motif into a substring ending there."""
    row = np.zeros(len(text) + 1, np.int64)
    letters = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    steps = np.arange(len(text) + 1)
    for i, c in enumerate(motif.encode("latin-1", "replace"), 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (letters != c))
        new = np.concatenate([[i], best])
        # insertions run along the row: new[j] = min over k <= j of new[k] + j - k
        row = np.minimum.accumulate(new - steps) + steps
    return row


def best_hits(motif: str, text: str) -> tuple[int, list[tuple[int, int]]]:
    """(edits, places) of all best places of the motif inside the text, in order of their ends; each begins as far left as that many edits allow."""
    if not motif or not text:
        return len(motif), []
    ends = infix_distances(motif, text)[1:]
    edits = int(ends.min())
    places = []
    for end in (np.flatnonzero(ends == edits) + 1).tolist():
        back = infix_distances_from_end(motif, text[max(0, end - 2 * len(motif)) : end])
        start = end - int(np.flatnonzero(back == edits)[-1])
        if start < end:
            places.append((start, end))
    return edits, places


def infix_distances_from_end(motif: str, text: str) -> np.ndarray:
    """Edits between the motif and the last n letters of ``text``, for each n."""
    a, b = motif[::-1], text[::-1][: 2 * len(motif)]
    row = np.arange(len(b) + 1)
    letters = np.frombuffer(b.encode("latin-1", "replace"), np.uint8)
    for i, c in enumerate(a.encode("latin-1", "replace"), 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (letters != c))])
        row = np.minimum.accumulate(new - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return row


def _upper(text: str) -> str:
    """Capitals, letter by letter: a letter whose capital is more than one stays, so that places do not move."""
    whole = text.upper()
    return whole if len(whole) == len(text) else "".join(c.upper() if len(c.upper()) == 1 else c for c in text)


def _exact(motif: str, text: str) -> list[tuple[int, int]]:
    """All places of the motif as it is, those that overlap among them."""
    out, at = [], text.find(motif)
    while at >= 0:
        out.append((at, at + len(motif)))
        at = text.find(motif, at + 1)
    return out


def _apart(places: list[tuple[int, int]], share: float = 0.7) -> list[tuple[int, int]]:
    """The places, in order, without those of which the last one that stayed covers ``share`` or more."""
    kept: list[tuple[int, int]] = []
    for s, e in places:
        shared = min(e, kept[-1][1]) - max(s, kept[-1][0]) if kept else 0
        if shared < share * (e - s):
            kept.append((s, e))
    return kept


def motif_hits(motif: str, text: str, tolerance: float = 0.2) -> list[tuple[int, int]]:
    """Places of the motif with at most ``tolerance`` of its length in edits. All best places of a stretch are taken (but those that others cover by 70 %),
    then what lies before, after and, where it is longer than half a motif, between them is searched in the same way."""
    text = _upper(text)
    if not motif or not text:
        return []
    if tolerance * len(motif) < 1:
        # no edits: what lies between places that stay has no more of them
        return _apart(_exact(motif.encode("latin-1", "replace").decode("latin-1"), text.encode("latin-1", "replace").decode("latin-1")))
    # a part of the text is at least as far from the motif at each end as the whole text is, so that parts without a near end need no search
    near = np.concatenate([[0], np.cumsum(infix_distances(motif, text)[1:] <= tolerance * len(motif))])
    hits, stack = [], [(0, len(text))]
    while stack:
        a, b = stack.pop()
        if near[b] == near[a]:
            continue
        edits, places = best_hits(motif, text[a:b])
        if not places or edits > tolerance * len(motif):
            continue
        found = [(a + s, a + e) for s, e in _apart(places)]
        hits += found
        if found[0][0] > a:
            stack.append((a, found[0][0]))
        stack += [(e, s) for (_, e), (s, _) in zip(found, found[1:]) if abs(s - e + 1) > 0.5 * len(motif) and s > e]
        if found[-1][1] < b:
            stack.append((found[-1][1], b))
    return sorted(hits)


def _reached(gaps: np.ndarray, held: np.ndarray, size: int, tolerance: float) -> int:
    """How many chains in a row join: the gap before each, and the hits held until then."""
    joins = (gaps < size * np.minimum(3, np.ceil(tolerance * held))) & (gaps > -0.2 * size)
    return len(joins) if joins.all() else int(joins.argmin())


def grown_chain(hits: list[tuple[int, int]], size: int, tolerance: float = 0.3) -> list[tuple[int, int]]:
    """The hits around the longest chain (neighbours at most a fifth of the motif apart or overlapping; the first such) that go with it: on either side chain after
    chain joins while its gap, in motifs, is less than min(3, ceil(tolerance * n)), n being the hits from the longest chain up to there, and it overlaps
    by less than a fifth of the motif. The first chain that does not join ends that side."""
    starts, ends = np.array(sorted(hits)).T
    between = starts[1:] - ends[:-1]
    first = np.flatnonzero(np.concatenate([[True], np.abs(between) > math.ceil(0.2 * size)]))
    count = np.diff(np.append(first, len(starts)))
    gaps = between[first[1:] - 1]
    k = int(count.argmax())
    right = _reached(gaps[k:], np.cumsum(count[k:])[:-1], size, tolerance)
    left = _reached(gaps[:k][::-1], np.cumsum(count[: k + 1][::-1])[:-1], size, tolerance)
    a, b = first[k - left], first[k + right] + count[k + right]
    return list(zip(starts[a:b].tolist(), ends[a:b].tolist()))


def copy_number(motif: str, text: str, tolerance: float = 0.2) -> tuple[int, int, int]:
    """(copies, start, end) of the grown chain of hits."""
    hits = motif_hits(motif.upper(), text, tolerance) if motif else []
    if not hits:
        return 0, 0, 0
    held = grown_chain(hits, len(motif))
    return len(held), held[0][0], held[-1][1]


def non_redundant(calls: list[tuple[float, int, int]], share: float = 0.9) -> list[tuple[float, int, int]]:
    """Calls (score, start, end) from the highest on, without those of which what stayed covers ``share`` or more (depth along the locus)."""
    if not calls:
        return []
    low = min(s for _, s, _ in calls)
    held = np.zeros(max(e for _, _, e in calls) - low, bool)
    stays = []
    for call in sorted(calls, reverse=True):
        own = held[call[1] - low : call[2] - low]
        if not stays or own.sum() < share * len(own):
            own[:] = True
            stays.append(call)
    return stays


def oriented_copy_number(motif: str, text: str) -> dict:
    """The orientation with more copies (forward on a tie)."""
    forward, back = copy_number(motif, text), copy_number(motif.translate(_PAIR)[::-1], text)
    n, s, e = back if back[0] > forward[0] else forward
    return {"copies": n, "start": s, "end": e, "strand": "-" if back[0] > forward[0] else "+"}


def purity(hits: list[tuple[int, int]]) -> float:
    """Positions that exactly one hit covers, over the span of all."""
    if not hits:
        return 0.0
    span = max(e for _, e in hits) - min(s for s, _ in hits)
    low = min(s for s, _ in hits)
    starts, ends = np.array(hits).T - low
    depth = np.bincount(starts, minlength=span + 1) - np.bincount(ends, minlength=span + 1)
    return float((np.cumsum(depth)[:-1] == 1).sum() / span)


def extend_flanks(motif: str, before: str, core: str, after: str, tries: int = 10) -> tuple[int, int]:
    """(copies, letters taken on each side): the core widened step by step while that adds copies, up to ``tries``
    steps in a row without one."""
    best, width, idle, step = oriented_copy_number(motif, core)["copies"], 0, 0, 0
    while idle < tries:
        step += 1
        size = step * len(motif) + 20
        if size > max(len(before), len(after)) + len(motif) + 20:
            break
        text = (before[-size:] if size else "") + core + after[:size]
        n = oriented_copy_number(motif, text)["copies"]
        best, width, idle = (n, size, 0) if n > best else (best, width, idle + 1)
    return best, width


def with_copy_number(df: DataFrame, motif: str, seq: str) -> DataFrame:
    """Adds copies, start, end, strand and purity of the motif column in the sequence column (nulls count as empty)."""

    @F.pandas_udf("copies int, start int, end int, strand string, purity double")
    def run(m: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(m, s):
            call = oriented_copy_number(a or "", b or "")
            unit = (a or "") if call["strand"] == "+" else (a or "").translate(_PAIR)[::-1]
            hits = [h for h in motif_hits(unit.upper(), b or "") if call["start"] <= h[0] and h[1] <= call["end"]] if call["copies"] else []
            out.append((*call.values(), purity(hits)))
        return pd.DataFrame(out, columns=["copies", "start", "end", "strand", "purity"])

    return df.withColumn("_c", run(motif, seq)).select(*df.columns, "_c.copies", "_c.start", "_c.end", "_c.strand", "_c.purity")


def with_flanks(df: DataFrame, motif: str, before: str, core: str, after: str, tries: int = 10) -> DataFrame:
    """Adds flank_copies and flank_letters: the copies when the core is widened as long as that adds some, and by how much (nulls count as empty)."""

    @F.pandas_udf("flank_copies int, flank_letters int")
    def run(m: pd.Series, b: pd.Series, c: pd.Series, a: pd.Series) -> pd.DataFrame:
        out = [extend_flanks(*(x or "" for x in row), tries) for row in zip(m, b, c, a)]
        return pd.DataFrame(out, columns=["flank_copies", "flank_letters"])

    return df.withColumn("_c", run(motif, before, core, after)).select(*df.columns, "_c.flank_copies", "_c.flank_letters")


def with_best_places(df: DataFrame, motif: str, seq: str) -> DataFrame:
    """Adds edits and places (array<struct<start, end>>): the fewest edits of the motif inside the sequence, and all places that reach them."""

    @F.pandas_udf("edits int, places array<struct<start:int,end:int>>")
    def run(m: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = [best_hits(a or "", b or "") for a, b in zip(m, s)]
        return pd.DataFrame([(e, [{"start": x, "end": y} for x, y in p]) for e, p in out], columns=["edits", "places"])

    return df.withColumn("_c", run(motif, seq)).select(*df.columns, "_c.edits", "_c.places")


def non_redundant_calls(df: DataFrame, by: list[str], score: str, share: float = 0.9) -> DataFrame:
    """Rows (start, end) of each group that stay when they are read from the best score on; a group's calls are one locus, one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {}
        for call in non_redundant(list(zip(pdf[score], pdf["start"], pdf["end"])), share):
            left[call] = left.get(call, 0) + 1
        keep = []
        for call in zip(pdf[score], pdf["start"], pdf["end"]):
            keep.append(left.get(call, 0) > 0)
            left[call] = left.get(call, 0) - 1
        return pdf[keep]

    return df.dropna(subset=[score, "start", "end"]).groupBy(*by).applyInPandas(run, df.schema)


def is_candidate(consensus: Column, length: Column, copies: Column) -> Column:
    return (consensus >= 7) & (length > 100) & (length < 10_000) & (copies >= 3)
