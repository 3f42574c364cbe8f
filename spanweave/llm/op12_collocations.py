"""Phrase collocations: phrases of 2 to 5 words whose words come together more often than their best parts would by chance.

1. Links. Each task counts its distinct words and pairs of neighbouring words by hash; one aggregation gives the hashes with ``least``
   occurrences or more. A phrase that occurs often has only such words and pairs, so a filter of their hashes rules out the rest of the text (it
   may let through more, and never rules out a frequent phrase). The filter's size is bounded (see ``idfilter``).
2. Tries. Each task counts, for every place in the text, the phrases of up to five linked words that begin there, in tries of that depth under a root for each
   language. A trie is written level by level in sorted order (parent, word, count, and the spelling of its words), cut into slices by ranges of
   the hash of a phrase's first three words, so that a very frequent word or pair of words spreads over many slices.
3. Merge. The slices of one range are merged in sorted order, a bounded number of nodes at a time; phrases with fewer than ``least`` occurrences go.
4. Parts. For each cut of a phrase the left part is the node that a walk from the root reaches, and the right part the one that suffix links
   reach: both are found by their path in the table of merged nodes. A phrase inside a phrase one word longer that occurs as often is
   dropped (longer ones yet follow: what lies between has the same count).
5. First ``top`` phrases of each language: first among shares of a language's phrases, then among what those leave.

Counts are exact: words are told apart by 128 bits within a task and by their bytes in the merge; products are decimals of 38 digits.

Defined cases: null text counts as empty; null lang is ``und``; repeated rows count as often as they occur; an empty table, or one without
frequent phrases, gives no rows; columns other than text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.llm.idfilter import IdFilter
from spanweave.llm.sql import _LOW, _UP
from spanweave.llm.text import Words, distinct_keys, mix, text_chunks, words_of
from spanweave.scratch import Scratch

DEPTH, LEAST, TOP, UNKNOWN = 5, 100, 2000, "und"
#: Bytes of text counted together, trie nodes that a task or a merge holds before it merges or writes them, linked places for each range.
TOGETHER, NODES, PLACES = 4 << 20, 500_000, 250_000
SHARES = 64

_BETWEEN, _STOPS = np.zeros(256, bool), np.zeros(256, bool)
_STOPS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BETWEEN[:] = _STOPS
_BETWEEN[[0x20, 0x09]] = True
_WORD, _LINK, _PATH = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


class Text(NamedTuple):
    """Words of a stretch of text: number of the language in ``langs``, key of word and language, whether the next word belongs to the same piece."""

    words: Words
    langs: list[str]
    lang: np.ndarray
    key: np.ndarray
    link: np.ndarray


def _texts(batch: pa.RecordBatch, second: bool) -> Iterator[Text]:
    for i, j, data, offs in text_chunks(batch.column(0), TOGETHER):
        words = words_of(data, offs, space=_BETWEEN, second=second)
        coded = batch.column(1).slice(i, j - i).dictionary_encode()
        langs = coded.dictionary.to_pylist()
        seed = np.array([mix(np.array([zlib.crc32(x.encode()), len(x)], np.uint64)).sum() for x in langs], np.uint64)
        lang = np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(words.offs))
        stops = np.concatenate([[0], np.cumsum(_STOPS[words.data])])
        link = stops[words.starts[1:]] == stops[words.ends[:-1]]
        first = words.offs[1:-1]
        link[first[(first > 0) & (first < len(words.starts))] - 1] = False  # a text's first word
        yield Text(words, langs, lang, mix(words.hashes * _WORD + seed[lang]), link)


def _pair_keys(text: Text, at: np.ndarray) -> np.ndarray:
    return mix(text.key[at] * _LINK + text.key[at + 1])


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in _texts(batch, second=False):
            for keys in (text.key, _pair_keys(text, np.flatnonzero(text.link))):
                some, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(n)], ["id", "n"])


class _KeyFilter(IdFilter):
    """The filter of ids that are hashes already; numpy finds their places as Spark does."""

    def places(self, value: Column) -> list[Column]:
        return [F.shiftrightunsigned(value, k).bitwiseAND(F.lit(self.bits - 1)) for k in (0, 32)]

    def test(self):
        shared, most = self.shared, np.uint64(self.bits - 1)

        def has(keys: np.ndarray) -> np.ndarray:
            table, hit = shared.value, True
            for k in (0, 32):
                at = (keys >> np.uint64(k)) & most
                hit = hit & ((table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1)
            return hit

        return has


class Trie(NamedTuple):
    """Level by level: (parent's place in the level above, number of the word, count) of each node, sorted by the first two. Level 0 has the languages;
    ``words`` are the words (and languages) in byte order."""

    words: list[bytes]
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def nodes(self) -> int:
        return sum(len(x[0]) for x in self.levels)

    def write(self) -> bytes:
        packed = [(p.astype(np.uint32), w.astype(np.uint32), n) for p, w, n in self.levels]
        return zlib.compress(pickle.dumps((self.words, packed), 5), 1)


def read_trie(blob: bytes) -> Trie:
    words, levels = pickle.loads(zlib.decompress(blob))
    return Trie(words, [(p.astype(np.int64), w.astype(np.int64), n) for p, w, n in levels])


def _level(parent: np.ndarray, word: np.ndarray, count: np.ndarray | None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """One level from the (parent, word, count) of its occurrences, and the node of each."""
    keys, node, times = np.unique((parent << 32) | word, return_inverse=True, return_counts=True)
    if count is not None:
        order = np.argsort(node, kind="stable")
        begins = np.concatenate([[0], np.cumsum(times)[:-1]]).astype(np.int64)
        times = np.add.reduceat(count[order], begins) if len(keys) else np.zeros(0, np.int64)
    return (keys >> 32, keys & 0xFFFFFFFF, times.astype(np.int64)), node


def count_trie(text: Text, has, depth: int) -> Trie:
    """Phrases of up to ``depth`` linked words of a stretch of text; a language's count is that of all its words."""
    words, key = text.words, text.key
    good = has(key)
    alive = np.zeros(len(key) + depth, bool)
    pairs = np.flatnonzero(text.link & good[:-1] & good[1:])
    alive[pairs] = has(_pair_keys(text, pairs))
    places = np.flatnonzero(good)
    at, number = distinct_keys(words.hashes[places], words.second[places])
    raw = words.data.tobytes()
    spelt = [raw[a:b] for a, b in zip(words.starts[places[at]].tolist(), words.ends[places[at]].tolist())]
    names = [x.encode() for x in text.langs]
    spelling = sorted({*spelt, *names})
    rank = {w: i for i, w in enumerate(spelling)}
    word = np.zeros(len(key), np.int64)
    word[places] = np.array([rank[w] for w in spelt], np.int64)[number]
    used = np.array([rank[x] for x in names], np.int64)[text.lang]
    top, node = _level(np.zeros(len(key), np.int64), used, None)
    levels, node, begin = [top], node[places], places
    for n in range(1, depth + 1):
        if n > 1:
            on = alive[begin + n - 2]
            begin, node = begin[on], node[on]
        found, node = _level(node, word[begin + n - 1], None)
        levels.append(found)
    return Trie(spelling, levels)


def merge_tries(tries: list[Trie]) -> Trie:
    """One trie with the counts of all, level by level in sorted order."""
    if len(tries) == 1:
        return tries[0]
    spelling = sorted(set().union(*(t.words for t in tries)))
    rank = {w: i for i, w in enumerate(spelling)}
    to = [np.array([rank[w] for w in t.words], np.int64) for t in tries]
    above = [np.zeros(1, np.int64) for _ in tries]
    levels = []
    for n in range(max(len(t.levels) for t in tries)):
        parts = [t.levels[n] for t in tries]
        level, node = _level(
            np.concatenate([a[p] for a, (p, _, _) in zip(above, parts)]),
            np.concatenate([r[w] for r, (_, w, _) in zip(to, parts)]),
            np.concatenate([c for _, _, c in parts]),
        )
        levels.append(level)
        above = np.split(node, np.cumsum([len(p) for p, _, _ in parts])[:-1])
    return Trie(spelling, levels)


def _homes(trie: Trie, ranges: int) -> list[np.ndarray]:
    """The range of each node, by the hash of its first three words: deeper ones stay with theirs."""
    offs = np.concatenate([[0], np.cumsum([len(w) for w in trie.words])]).astype(np.int64)
    data = np.frombuffer(b"".join(trie.words), np.uint8)
    spelt = words_of(data, offs, lower=False, space=np.zeros(256, bool))
    hashes = np.zeros(len(trie.words), np.uint64)
    hashes[np.diff(offs) > 0] = spelt.hashes
    path, homes = np.zeros(1, np.uint64), []
    for n, (parent, word, _) in enumerate(trie.levels):
        path = mix(path[parent] * _PATH + hashes[word]) if n <= 3 else path[parent]
        homes.append(((path >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32))
    return homes


def slices(trie: Trie, ranges: int) -> Iterator[tuple[int, Trie]]:
    """(range, trie) with the nodes of each range; nodes on the way to them come along with a count of 0."""
    homes = _homes(trie, ranges)
    order = [np.argsort(h, kind="stable") for h in homes]
    cuts = [np.searchsorted(h[o], np.arange(ranges + 1)) for h, o in zip(homes, order)]
    for r in np.unique(np.concatenate(homes)).tolist():
        own = [o[c[r] : c[r + 1]] for o, c in zip(order, cuts)]  # ascending, as the sort is stable
        keep, need = [], np.zeros(0, np.int64)
        for n in range(len(own) - 1, -1, -1):
            here = np.union1d(own[n], need) if len(need) else own[n]
            keep.append(here)
            need = np.unique(trie.levels[n][0][here]) if len(here) else here
        keep.reverse()
        used = np.unique(np.concatenate([trie.levels[n][1][k] for n, k in enumerate(keep)]))
        levels, above = [], np.zeros(1, np.int64)
        for n, here in enumerate(keep):
            parent, word, count = (x[here] for x in trie.levels[n])
            levels.append((np.searchsorted(above, parent), np.searchsorted(used, word), np.where(homes[n][here] == r, count, 0)))
            above = here
        yield r, Trie([trie.words[i] for i in used.tolist()], levels)


class _Merging:
    """Tries to be merged, at most ``NODES`` nodes or as many as the merged trie has at a time."""

    def __init__(self):
        self.tries: list[Trie] = []
        self.waiting = 0

    def add(self, trie: Trie) -> None:
        self.tries.append(trie)
        self.waiting += trie.nodes()
        if self.waiting > NODES + (self.tries[0].nodes() if len(self.tries) > 1 else 0):
            self.merged()

    def merged(self) -> Trie | None:
        if self.tries:
            self.tries, self.waiting = [merge_tries(self.tries)], 0
        return self.tries[0] if self.tries else None


def _tries(has, depth: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(trie: Trie) -> pa.RecordBatch:
            parts = [(r, t.write()) for r, t in slices(trie, ranges)]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["range", "trie"])

        held = _Merging()
        for batch in batches:
            for text in _texts(batch, second=True):
                if len(text.key):
                    held.add(count_trie(text, has, depth))
                if held.tries and held.tries[0].nodes() > 2 * NODES:
                    yield written(held.merged())
                    held = _Merging()
        if held.tries:
            yield written(held.merged())

    return run


def _merged_nodes(least: int):
    """(lang, words, phrase, f) of the frequent nodes of each range; words is 0 for the languages, whose f is the number of their words."""

    def rows(trie: Trie) -> pa.RecordBatch:
        frequent = [count >= (least if n else 1) for n, (_, _, count) in enumerate(trie.levels)]
        spelt = [on.copy() for on in frequent]  # those, and what is on the way to them
        for n in range(len(trie.levels) - 1, 0, -1):
            spelt[n - 1][trie.levels[n][0][spelt[n]]] = True
        paths: dict[int, tuple[bytes, bytes]] = {}
        lang, n_words, phrase, f = [], [], [], []
        for n, (parent, word, count) in enumerate(trie.levels):
            here = {}
            for i in np.flatnonzero(spelt[n]).tolist():
                w = trie.words[word[i]]
                above = paths[parent[i]] if n else None
                here[i] = (w, b"") if n == 0 else (above[0], w if n == 1 else above[1] + b" " + w)
                if frequent[n][i]:
                    lang.append(here[i][0])
                    n_words.append(n)
                    phrase.append(here[i][1])
                    f.append(int(count[i]))
            paths = here
        text = [pa.array([x.decode("utf-8", "replace") for x in xs], pa.string()) for xs in (lang, phrase)]
        return pa.RecordBatch.from_arrays([text[0], pa.array(n_words, pa.int32()), text[1], pa.array(f, pa.int64())], ["lang", "words", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, _Merging()
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if r != current and held.tries:
                    yield rows(held.merged())
                    held = _Merging()
                current = r
                held.add(read_trie(blob.as_py()))
        if held.tries:
            yield rows(held.merged())

    return run


def phrase_counts(docs: DataFrame, tmp: Scratch, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, f: the phrases of 1 to ``depth`` words with ``least`` occurrences in a language, and, with words = 0, each language's number of words."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    texts = docs.select(F.col("text").cast("string").alias("text"), lang)
    keys = tmp.save(texts.mapInArrow(_key_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "keys")
    places = keys.agg(F.sum("n")).first()[0] or 0
    ranges = min(1 << 16, max(64, -(-places // PLACES)))
    known = _KeyFilter(keys)
    tries = tmp.save(texts.mapInArrow(_tries(known.test(), depth, ranges), "range int, trie binary"), "tries")
    merged = tries.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_merged_nodes(least), "lang string, words int, phrase string, f long")
    return tmp.save(merged, "phrases")


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language of ``docs`` (text, lang)."""
    tmp = Scratch(docs.sparkSession, "collocations")
    nodes = phrase_counts(docs, tmp, depth, least)
    # a language's words are counted in one node: as many rows as there are languages
    totals = nodes.where("words = 0").select("lang", F.col("f").alias("n"))
    counted = nodes.where("words > 0").select("lang", "phrase", "words", "f")
    many = counted.where("words > 1").withColumn("path", F.split("phrase", " "))
    part = lambda a, n: F.array_join(F.slice("path", a, n), " ")
    inside = (
        many.where("words > 2")
        .select("lang", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"), "f")
        .distinct()
    )
    kept = many.join(inside, ["lang", "phrase", "f"], "left_anti")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "path", F.col("words").alias("m"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    side = lambda name, f: counted.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = (
        cuts.join(side("left", "l"), ["lang", "left"])
        .join(side("right", "r"), ["lang", "right"])
        .join(totals, "lang")
        .withColumn("_product", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"))
        .withColumn("_chance", wide("l") * wide("r"))
        .withColumn("score", F.expr("_product div _chance"))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("best"))
        .select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score")
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("_share")
    shares = scored.withColumn("_share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order)))
    first = shares.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return first.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs),
split AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM split GROUP BY lang),
runs AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM split, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m),
counts AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM runs GROUP BY ALL),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 100),
inside AS (SELECT DISTINCT lang, f, unnest([array_to_string(w[1 : m - 1], ' '), array_to_string(w[2 : m], ' ')]) AS phrase FROM candidates WHERE m > 2),
kept AS (SELECT * FROM candidates ANTI JOIN inside USING (lang, phrase, f)),
cuts AS (SELECT lang, phrase, f, k, array_to_string(w[1 : k], ' ') AS a, array_to_string(w[k + 1 : m], ' ') AS b FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.f AS a, x.f AS l, y.f AS r, n, 1000 * cuts.f * n // (x.f * y.f) AS score, k
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = cuts.a JOIN counts y ON y.lang = cuts.lang AND y.phrase = cuts.b JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLE = {"op12_collocations": _SQL}
