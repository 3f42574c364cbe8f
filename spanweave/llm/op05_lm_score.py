"""Language-model scores from a log-frequency Bloom filter of bigram counts.

Counts are quantised to levels (thresholds growing by half). A bigram of level q is stored as q
entries of a Bloom filter, (bigram, 1) to (bigram, q); probing (bigram, 1), (bigram, 2), ... until
the first miss gives its level back, never too low, and too high with small probability. The
filter has a fixed number of bits for each entry, so it grows with the corpus; it is cut into segments by the bigram.
Up to ``BROADCAST_BYTES`` its segments are broadcast in shards of at most ``SHARD_BYTES``, of which a task holds one at a
time. A filter that may be larger (``BITS_PER_ENTRY`` for each token) is not broadcast: texts are dealt into chunks of some
megabytes, and each chunk sends its distinct bigrams to the segments once, packed; a segment counts them, makes its
filter, probes it and sends back a byte for each, in the same order. Both give the same scores.

p(w | v) = (c(v,w) + m * u(w)) / (c(v) + m), additive smoothing with the unigram estimate u(w) (that of the base score) as
the prior; its weight m is the mean number of different successors of a word in all training texts. c(v,w) is the
filter's count, at most c(v). c(v) and u(w) are exact for every word: the commonest ``head_limit`` words are broadcast, and
tokens of which either word is outside the head get the missing counts by shuffle joins (from the segments, where the filter
is not broadcast), so the scores do not depend on ``head_limit``. A first word that training has not seen leaves u(w).

Defined cases: null counts as empty and consists of the end token; a null doc_id counts as the empty
string, so it is held out; repeated rows are scored each; without training rows c and N are 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.text import mix, text_chunks, words_of
from spanweave.llm.vocab import HEAD_LIMIT, collect_sorted, head_threshold, lookup
from spanweave.scratch import Scratch

SHARD_BYTES = 32_000_000
BROADCAST_BYTES = 512_000_000
BITS_PER_ENTRY = 10
#: Tokens of training texts for each chunk of texts, about, where the filter is not broadcast.
CHUNK_POSITIONS = 1 << 20
#: Bytes of text whose tokens are looked up together.
GROUP_BYTES = 4 << 20
PROBES = 4
#: Bigram positions for each segment of the filter, about.
SEGMENT_POSITIONS = 1 << 19
END, START = np.uint64(0xE220A8397B1DCDAF), np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0x9FB21C651E98DF25)


def _levels() -> np.ndarray:
    out = [1]
    while out[-1] < 2**60:
        out.append(max(out[-1] + 1, -(-out[-1] * 3 // 2)))
    return np.array(out, np.int64)


LEVELS = _levels()
#: The count that stands for a level; 0 for level 0.
COUNT_OF = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2, [float(LEVELS[-1])]])


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a chunk (words, then one end for each text) and their offsets."""
    words = words_of(data, offs)
    n = len(offs) - 1
    return np.insert(words.hashes, words.offs[1:], END), words.offs + np.arange(n + 1)


def _contexts(tokens: np.ndarray, offs: np.ndarray) -> np.ndarray:
    before = np.concatenate([[START], tokens[:-1]])
    before[offs[:-1]] = START
    return before


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, tokens, _ in _groups(batch.column(0)):
            h, n = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "cnt"])


def _groups(column: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Tokens of consecutive texts with some megabytes together."""
    for i, j, data, offs in text_chunks(column, size):
        yield (i, j, *_tokens(data, offs))


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _PAIR + second)


def _segment(key: np.ndarray, segments: int) -> np.ndarray:
    return (mix(key ^ _PAIR) % np.uint64(segments)).astype(np.int32)


def _packed(n: np.ndarray) -> bytes:
    """Counts of a chunk, as one byte each if all of them are small."""
    return n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32).tobytes()


def _unpacked(counts: bytes, keys: bytes) -> np.ndarray:
    return np.frombuffer(counts, np.uint8 if 8 * len(counts) == len(keys) else np.uint32).astype(np.int64)


def _bigram_blocks(segments: int):
    """segment, keys (bytes of uint64), counts (bytes of uint32): distinct bigrams of some megabytes of
    text, summed before the shuffle."""

    def flush(held):
        key, n = np.unique(np.concatenate(held), return_counts=True)
        seg = _segment(key, segments)
        order = np.argsort(seg, kind="stable")
        seg, key, n = seg[order], key[order], n[order]
        edges = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1, [len(seg)]])
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(seg[edges[:-1]]),
                pa.array([key[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([_packed(n[a:b]) for a, b in spans], pa.binary()),
            ],
            ["segment", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column(0)):
                tokens, token_offs = _tokens(data, offs)
                held.append(_pair_key(_contexts(tokens, token_offs), tokens))
                size += len(tokens)
                if size >= 1_000_000:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _probe_bits(key: np.ndarray, level: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Bit positions of (key, level) in a segment of ``bits`` bits."""
    a = mix(key + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    b = mix(a) | np.uint64(1)
    for i in range(PROBES):
        yield ((a + np.uint64(i) * b) >> np.uint64(8)) % bits


def filter_of(keys: np.ndarray, counts: np.ndarray, per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """The filter's bytes for distinct keys and their counts."""
    level = np.searchsorted(LEVELS, counts, "right")
    bits = np.uint64(max(64, per_entry * int(level.sum())))
    out = np.zeros(int(bits + np.uint64(7)) // 8 * 8, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        key = keys[level >= q]
        for at in _probe_bits(key, q, bits):
            out[at.astype(np.int64)] = 1
    return np.concatenate([np.array([bits], np.uint64).view(np.uint8), np.packbits(out, bitorder="little")])


def _filters(per_entry: int):
    """Rows ordered by segment -> segment, distinct bigrams, filter."""

    def done(seg, parts):
        key = np.concatenate([np.frombuffer(k, np.uint64) for k, _ in parts])
        n = np.concatenate([_unpacked(c, k) for k, c in parts])
        key, inverse = np.unique(key, return_inverse=True)
        raw = filter_of(key, np.bincount(inverse, n, len(key)).astype(np.int64), per_entry).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([len(key)], pa.int64()), pa.array([raw], pa.binary())], ["segment", "pairs", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            for seg, k, c in zip(*(batch.column(x).to_pylist() for x in range(3))):
                if parts and seg != last:
                    yield done(last, parts)
                    parts = []
                last = seg
                parts.append((k, c))
        if parts:
            yield done(last, parts)

    return run


class Shard:
    """Filters of some segments: their bytes in one array, where each begins, and its bits."""

    def __init__(self, raw: np.ndarray, begin: np.ndarray, bits: np.ndarray):
        self.raw, self.begin, self.bits = raw, begin, bits

    @classmethod
    def of(cls, segments: int, filters: list[tuple[int, bytes]]):
        begin, bits = np.zeros(segments, np.int64), np.zeros(segments, np.uint64)
        parts, run = [np.zeros(0, np.uint8)], 0
        for seg, raw in filters:
            part = np.frombuffer(raw, np.uint8)
            bits[seg], begin[seg] = part[:8].view(np.uint64)[0], run
            parts.append(part[8:])
            run += len(part) - 8
        return cls(np.concatenate(parts), begin, bits)

    def levels(self, key: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """Level of each bigram by repeated probes; 0 where its segment is not here."""
        out = np.zeros(len(key), np.int64)
        live = np.flatnonzero(self.bits[seg] > 0)
        q = 1
        while len(live):
            k, begin, bits = key[live], self.begin[seg[live]], self.bits[seg[live]]
            hit = np.ones(len(live), bool)
            for at in _probe_bits(k, q, bits):
                at = at.astype(np.int64)
                hit &= (self.raw[begin + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
            live = live[hit]
            out[live] = q
            q += 1
        return out


def _open(broadcast, alone: bool) -> Shard:
    """A shard's broadcast; it is let go after use unless it is the only one."""
    shard = Shard(*broadcast.value)
    if not alone and hasattr(broadcast, "_value"):
        del broadcast._value
    return shard


class Model:
    """Counts of the head's words, and the filter's shards where it is broadcast."""

    def __init__(self, head, shards: list, facts: dict):
        self.keys, self.counts = head
        self.shards, self.facts = shards, facts

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (self.facts["n"] + 0.1 * (self.facts["v"] + 1))

    def bigrams(self, key: np.ndarray) -> np.ndarray:
        level = np.zeros(len(key), np.int64)
        seg = _segment(key, self.facts["segments"])
        for b in self.shards:
            level += _open(b, len(self.shards) == 1).levels(key, seg)
        return COUNT_OF[level]

    def counts_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count in training, whether it is known here)."""
        at, known = lookup(self.keys, words)
        c = np.where(known, self.counts[at] if len(self.keys) else 0, 0).astype(np.int64)
        c[words == START] = self.facts["texts"]
        return c, known | (words == START)

    def log_p(self, pairs: np.ndarray, cv: np.ndarray, u: np.ndarray) -> np.ndarray:
        m = self.facts["prior"]
        return np.log10((np.minimum(pairs, cv) + m * u) / (cv + m))


_OPEN = ["kind", "group", "a", "b", "cv", "cw", "n", "x"]
_OPEN_SCHEMA = "kind int, group long, a long, b long, cv long, cw long, n long, x double"


def _score(head, shards, facts):
    """kind 0: row (group), doc_id, tokens (a), known ones in the head (b), base (x) and score (y) but for what is open.
    Other kinds, one row for each distinct (text, bigram) that is open: bit 0, the count of the first word (cv) is to
    come; bit 1, that of the second one (cw). x: count of the bigram; n: occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = Model(head.value, shards, facts)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for i, j, tokens, offs in _groups(batch.column(1)):
                n = j - i
                rows = np.arange(row, row + n)
                row += n
                first = _contexts(tokens, offs)
                key = _pair_key(first, tokens)
                (cw, known_w), (cv, known_v) = model.counts_of(tokens), model.counts_of(first)
                u = model.unigram(cw.astype(float))
                x = np.where(known_w, np.log10(u), 0)
                pairs, done = model.bigrams(key), known_v & known_w
                y = np.where(done, model.log_p(pairs, cv, u), 0)
                known_n, base, score = (np.add.reduceat(v, offs[:-1]) for v in (known_w.astype(np.int64), x, y))
                at = np.flatnonzero(~done)
                owner = np.repeat(rows, np.diff(offs))[at]
                _, one, times = np.unique(mix(key[at] + owner.astype(np.uint64) * _PAIR), return_index=True, return_counts=True)
                at, owner, m = at[one], owner[one], len(one)
                kind = np.where(known_v[at], 0, 1) + np.where(known_w[at], 0, 2)
                zero = np.zeros(n, np.int64)
                docs = [zero.astype(np.int32), rows, np.diff(offs), known_n, zero, zero, zero, base]
                more = [kind.astype(np.int32), owner, first[at].view(np.int64), tokens[at].view(np.int64), cv[at], cw[at], times.astype(np.int64), pairs[at]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.concatenate([d, o])) for d, o in zip(docs, more)),
                        pa.concat_arrays([ids.slice(i, n), pa.nulls(m, pa.int64())]),
                        pa.array(np.concatenate([score, np.zeros(m)])),
                    ],
                    [*_OPEN, "doc_id", "y"],
                )

    return run


class _Tally:
    """Distinct keys with the sum of their counts; no more is held than twice the distinct ones and some."""

    def __init__(self):
        self.keys, self.counts, self.size, self.least = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, CHUNK_POSITIONS

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size >= self.least:
            keys, _ = self.done()
            self.least = CHUNK_POSITIONS + 2 * len(keys)

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(self.counts), len(keys)).astype(np.int64)
        self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return keys, counts


def _by_segment(key: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ascending keys by segment, and where each segment begins in it: what a chunk asks for and the answers have this order."""
    seg = _segment(key, segments)
    order = np.argsort(seg, kind="stable")
    return order, np.searchsorted(seg[order], np.arange(segments + 1))


_ASKED = "segment int, chunk long, keys binary, counts binary, words binary, seen binary"


def _questions(head, segments: int):
    """Rows (chunk, trains, text) ordered by chunk -> for each chunk and segment the distinct bigrams of the chunk and its
    words outside the head, with their counts in its training texts."""

    def asked(chunk, pairs, words):
        (key, n), (word, times) = pairs.done(), words.done()
        (order, begin), (word_order, word_begin) = _by_segment(key, segments), _by_segment(word, segments)
        key, n, word, times = key[order], n[order], word[word_order], times[word_order]
        some = np.flatnonzero((np.diff(begin) > 0) | (np.diff(word_begin) > 0))
        spans, word_spans = (list(zip(x[some].tolist(), x[some + 1].tolist())) for x in (begin, word_begin))
        columns = [
            [key[a:b].tobytes() for a, b in spans],
            [_packed(n[a:b]) for a, b in spans],
            [word[a:b].tobytes() for a, b in word_spans],
            [_packed(times[a:b]) for a, b in word_spans],
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk)), *(pa.array(c, pa.binary()) for c in columns)],
            ["segment", "chunk", "keys", "counts", "words", "seen"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, pairs, words = head.value[0], None, _Tally(), _Tally()
        for batch in batches:
            for chunk, part in _runs(batch):
                if last is not None and chunk != last:
                    yield asked(last, pairs, words)
                    pairs, words = _Tally(), _Tally()
                last = chunk
                trains = part.column("trains").to_numpy(zero_copy_only=False).astype(np.int64)
                for i, j, tokens, offs in _groups(part.column("text")):
                    times = np.repeat(trains[i:j], np.diff(offs))
                    pairs.add(_pair_key(_contexts(tokens, offs), tokens), times)
                    tail = ~lookup(known, tokens)[1]
                    words.add(tokens[tail], times[tail])
        if last is not None:
            yield asked(last, pairs, words)

    return run


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, its rows) of a batch ordered by chunk."""
    chunk = batch.column("chunk").to_numpy()
    edges = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
    for i, j in zip(edges[:-1], edges[1:]):
        if i < j:
            yield int(chunk[i]), batch.slice(i, j - i)


_ANSWERED = "chunk long, segment int, pairs long, levels binary, seen binary"


def _answers(per_entry: int):
    """Questions ordered by segment -> for each the levels of its bigrams in the segment's filter (a byte each) and the counts of its
    words (int64); and a row of chunk -1 with the segment's number of distinct bigrams in training."""

    def summed(parts, k, c):
        key, inverse = np.unique(np.concatenate([np.frombuffer(p[k], np.uint64) for p in parts]), return_inverse=True)
        ends = np.cumsum([len(p[k]) // 8 for p in parts])[:-1]
        return key, np.bincount(inverse, np.concatenate([_unpacked(p[c], p[k]) for p in parts]), len(key)).astype(np.int64), np.split(inverse, ends)

    def done(segment, parts):
        key, n, rows = summed(parts, 1, 2)
        raw = filter_of(key[n > 0], n[n > 0], per_entry).tobytes()
        level = Shard.of(1, [(0, raw)]).levels(key, np.zeros(len(key), np.int64)).astype(np.uint8)
        _, times, word_rows = summed(parts, 3, 4)
        columns = [
            pa.array([-1, *(p[0] for p in parts)], pa.int64()),
            pa.array(np.full(len(parts) + 1, segment, np.int32)),
            pa.array([int((n > 0).sum()), *([0] * len(parts))], pa.int64()),
            pa.array([b"", *(level[r].tobytes() for r in rows)], pa.binary()),
            pa.array([b"", *(times[r].tobytes() for r in word_rows)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "segment", "pairs", "levels", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            for seg, *part in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and seg != last:
                    yield done(last, parts)
                    parts = []
                last = seg
                parts.append(part)
        if parts:
            yield done(last, parts)

    return run


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _answered(head, facts):
    """Rows ordered by chunk, of each first its answers by segment and then its texts -> scores. Equal texts of a chunk are held once."""

    def scored(model, levels, seen, ids, which, texts):
        parts = list(_groups(pa.array(texts, pa.large_string())))
        tokens = np.concatenate([p[2] for p in parts])
        lens = np.concatenate([np.diff(p[3]) for p in parts])
        offs = np.concatenate([[0], np.cumsum(lens)])
        first = _contexts(tokens, offs)
        key, inverse = np.unique(_pair_key(first, tokens), return_inverse=True)
        level = np.zeros(len(key), np.int64)
        level[_by_segment(key, facts["segments"])[0]] = np.frombuffer(b"".join(levels), np.uint8)
        word = np.unique(tokens[~lookup(model.keys, tokens)[1]])
        times = np.zeros(len(word), np.int64)
        times[_by_segment(word, facts["segments"])[0]] = np.frombuffer(b"".join(seen), np.int64)

        def counts(words):
            c, known = model.counts_of(words)
            at, found = lookup(word, words)
            return np.where(found & ~known, times[at] if len(word) else 0, c)

        cw, cv = counts(tokens), counts(first)
        u = model.unigram(cw.astype(float))
        by_text = (cw > 0).astype(np.int64), np.log10(u), model.log_p(COUNT_OF[level[inverse]], cv, u)
        columns = [lens, *(np.add.reduceat(v, offs[:-1]) for v in by_text)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c[which]) for c in columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(head.value, [], facts)
        last, levels, seen, ids, which, texts = None, [], [], [], [], {}
        for batch in batches:
            for chunk, part in _runs(batch):
                if ids and chunk != last:
                    yield scored(model, levels, seen, ids, which, list(texts))
                if chunk != last:
                    last, levels, seen, ids, which, texts = chunk, [], [], [], [], {}
                for segment, level, times, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("segment", "levels", "seen", "doc_id", "text"))):
                    if segment is None:
                        ids.append(doc_id)
                        which.append(texts.setdefault(text, len(texts)))
                    else:
                        levels.append(level)
                        seen.append(times)
        if ids:
            yield scored(model, levels, seen, ids, which, list(texts))

    return run


def _scores_by_chunk(rows: DataFrame, trains: Column, head, facts: dict, per_entry: int, tmp: Scratch) -> DataFrame:
    """Scores without a broadcast filter. Copies of a text are dealt by their ids."""
    chunks = max(1, facts["n"] // CHUNK_POSITIONS)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    texts = dealt.select("chunk", trains.alias("trains"), "text").repartition("chunk").sortWithinPartitions("chunk")
    asked = texts.mapInArrow(_questions(head, facts["segments"]), _ASKED).repartition("segment").sortWithinPartitions("segment")
    answers = tmp.save(asked.mapInArrow(_answers(per_entry), _ANSWERED), "answers")
    facts = facts | {"prior": _prior(answers.agg(F.sum("pairs")).first()[0], facts)}
    both = answers.where("chunk >= 0").drop("pairs").unionByName(dealt, allowMissingColumns=True)
    return both.repartition("chunk").sortWithinPartitions("chunk", F.col("segment").asc_nulls_last()).mapInArrow(_answered(head, facts), _SCORES)


def _prior(pairs: int, facts: dict) -> float:
    """How many different successors a word of training has on average, the start among them and the end not."""
    return pairs / facts["v"] if pairs else 1.0


def _resolved(tokens: DataFrame, tail: DataFrame) -> DataFrame:
    """Open tokens with cv and cw: exact counts of both words, 0 for words not in training."""
    found = lambda key, name: tail.select(F.col("h").alias(key), F.col("cnt").alias(name))
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    own = ["kind", "group", "n", "x"]
    first = tokens.where("kind = 1").drop("cv").join(found("a", "cv"), "a", "left").select(*own, count("cv"), "cw")
    both = tokens.where("kind = 3").drop("cv").join(found("a", "cv"), "a", "left").select(*own, "b", count("cv"))
    second = tokens.where("kind = 2").select(*own, "b", "cv").unionByName(both)
    second = second.join(found("b", "cw"), "b", "left").select(*own, "cv", count("cw"))
    return first.unionByName(second)


def _broadcast_shards(filters: DataFrame, segments: int, limit: int) -> list:
    """Broadcasts of consecutive segments with at most ``limit`` bytes together (or one segment);
    the driver holds one at a time."""
    sc = filters.sparkSession.sparkContext
    sizes = filters.select("segment", F.length("filter").alias("n")).orderBy("segment").toPandas()
    first, held, spans = 0, 0, []
    for seg, n in zip(sizes["segment"].tolist(), sizes["n"].tolist()):
        if held and held + n > limit:
            spans.append((first, seg))
            first, held = seg, 0
        held += n
    spans.append((first, segments))
    out = []
    for a, b in spans:
        rows = filters.where((F.col("segment") >= a) & (F.col("segment") < b)).select("segment", "filter").toArrow()
        shard = Shard.of(segments, list(zip(rows.column("segment").to_pylist(), rows.column("filter").to_pylist())))
        out.append(sc.broadcast((shard.raw, shard.begin, shard.bits)))
        del rows, shard
    return out


def lm_scores(
    docs: DataFrame, head_limit: int = HEAD_LIMIT, shard_bytes: int = SHARD_BYTES, broadcast_bytes: int = BROADCAST_BYTES, bits_per_entry: int = BITS_PER_ENTRY
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    tmp = Scratch(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10
    train = rows.where(part != 0).select("text")
    counts = tmp.save(train.mapInArrow(_unigrams, "h long, cnt long").groupBy("h").agg(F.sum("cnt").alias("cnt")), "unigrams")
    n, v = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)), F.count("*")).first()
    texts = (counts.where(F.col("h") == int(END.view(np.int64))).agg(F.max("cnt")).first()[0]) or 0
    cut = head_threshold(counts, head_limit)
    head = sc.broadcast(collect_sorted(counts.where(F.col("cnt") >= cut), "h", "cnt"))
    facts = {"n": n, "v": v, "texts": texts, "segments": max(1, -(-n // SEGMENT_POSITIONS))}
    segments = facts["segments"]
    names = ["doc_id", (part == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"]
    if bits_per_entry * n // 8 > broadcast_bytes:  # an entry for each token is the most that the filter may have
        return _scores_by_chunk(rows, part != 0, head, facts, bits_per_entry, tmp).select(*names)
    filters = (
        train.mapInArrow(_bigram_blocks(segments), "segment int, keys binary, counts binary")
        .repartition("segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_filters(bits_per_entry), "segment int, pairs long, filter binary")
    )
    filters = tmp.save(filters, "filters")
    prior = _prior(filters.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0], facts)
    facts = facts | {"prior": prior}
    shards = _broadcast_shards(filters, segments, shard_bytes)
    scored = tmp.save(rows.mapInArrow(_score(head, shards, facts), _OPEN_SCHEMA + ", doc_id long, y double"), "scored", partition_by="kind")
    for b in (head, *shards):
        b.destroy()
    tokens = scored.where("kind > 0").select(*_OPEN)
    u = (F.col("cw") + 0.1) / F.lit(n + 0.1 * (v + 1))
    p = (F.least(F.col("x"), F.col("cv").cast("double")) + F.lit(prior) * u) / (F.col("cv") + F.lit(prior))
    second = F.col("kind").isin(2, 3)
    tail = (
        _resolved(tokens, counts.where(F.col("cnt") < cut))
        .groupBy("group")
        .agg(
            F.sum(F.when(second & (F.col("cw") > 0), F.col("n")).otherwise(0)).alias("k"),
            F.sum(F.when(second, F.col("n") * F.log10(u)).otherwise(0.0)).alias("base"),
            F.sum(F.col("n") * F.log10(p)).alias("open"),
        )
    )
    zero = F.lit(0)
    return (
        scored.where("kind = 0")
        .join(tail, "group", "left")
        .select(
            "doc_id",
            F.col("a").alias("n_tokens"),
            (F.col("b") + F.coalesce("k", zero)).alias("n_known"),
            (F.col("x") + F.coalesce("base", zero)).alias("base_score"),
            (F.col("y") + F.coalesce("open", zero)).alias("score"),
        )
        .select(*names)
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_lm_score": op5_lm_score}
ORACLE: dict[str, str] = {}
