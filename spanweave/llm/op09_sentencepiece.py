"""SentencePiece encoding and decoding with shared-prefix Viterbi passes.

A text is read as marked words: one or more spaces (the first word has the dummy prefix) and the
characters up to the next space. No piece but runs of spaces holds a space after its first
character, so marked words are encoded independently. The distinct marked words are sorted, which makes them a
trie in depth-first order: going from one word to the next keeps the forward states of their common
prefix and extends them by the characters that differ. An automaton of the pieces (its states are kept along the
prefix as well) names those that end at each new character, the longest first.

The forward state of a prefix is its best last piece. For a unigram model that is the last piece of
the segmentation with the largest sum of scores. A BPE model (the kind at hand) does not
maximise that sum; its state is the last piece t of the prefix's BPE encoding, which is the only one
that goes with the state before t: a sequence of pieces is a BPE encoding exactly if every two neighbours
are what BPE makes of their concatenation. So the result equals the library's for either kind.

The commonest marked words of up to ``HEAD_BYTES`` bytes (at most ``HEAD_WORDS``, so the broadcast has a proven bound) are
encoded once for the corpus and broadcast; the others, few in each batch of texts, are encoded by the same
pass over the batch's own trie. Words are told apart by 128 bits of hash.

Defined cases: null counts as empty and gives an empty array (decoded: empty text); U+2581 in a text
counts as a space, as in the library; characters without a piece become their UTF-8 bytes' pieces,
or the unknown piece in a model without them; ids outside the model decode as the unknown piece; null
decodes as empty, and its encoding is exact; input columns are kept, and a column named like the output is replaced; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm.text import distinct_keys, mix, quoted, text_chunks, words_of
from spanweave.llm.vocab import head_threshold
from spanweave.scratch import Scratch

MODEL = "piece_bpe_32k.model"
MARK = "▁"
HEAD_WORDS, HEAD_BYTES = 250_000, 48
_MARK = np.frombuffer(MARK.encode(), np.uint8)
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True
_GAP, _GAP2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Pairs of pieces whose test a worker remembers.
PAIR_CACHE = 150_000
#: Moves of the automaton by way of suffixes that a worker remembers.
MOVE_CACHE = 60_000
#: Bytes of text whose rarer words are encoded together.
TOGETHER = 1 << 20


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_model(path: str, kind: str = "bpe") -> dict:
    """Pieces and scores of a model file as plain data: kind, piece -> id, scores, byte ids, unknown id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    ids = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    raw = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
    return {"kind": kind, "ids": ids, "scores": [sp.get_score(i) for i in range(n)], "bytes": raw, "unk": sp.unk_id(), "size": n}


class Encoder:
    """Encodes sorted marked words, keeping the forward states of common prefixes."""

    def __init__(self, model: dict):
        self.ids, self.scores, self.raw, self.unk = model["ids"], model["scores"], model["bytes"], model["unk"]
        self.bpe, self.width = model["kind"] == "bpe", model["size"]
        self.piece, self.length = [""] * self.width, [0] * self.width
        for piece, i in self.ids.items():
            self.piece[i], self.length[i] = piece, len(piece)
        self._build()
        self.pairs: dict[int, bool] = {}
        self.built: dict[str, tuple] = {}
        self.floor = min(self.scores, default=0.0) - 10.0
        #: Characters whose forward state was asked for, and those of them taken over from the word before.
        self.states = self.reused = 0

    def _build(self) -> None:
        """The automaton: moves of each state, the state of its longest proper suffix, and the pieces that end in it."""
        self.moves: list[dict[str, int]] = [{}]
        own = [-1]
        for piece, i in self.ids.items():
            at = 0
            for c in piece:
                at = self.moves[at].get(c) or self._new(at, c, own)
            own[at] = i if at else -1
        self.suffix = [0] * len(own)
        self.next_own = [0] * len(own)  # the nearest suffix state in which a piece ends
        queue = list(self.moves[0].values())
        for at in queue:
            for c, to in self.moves[at].items():
                up = self.suffix[at]
                while up and c not in self.moves[up]:
                    up = self.suffix[up]
                up = self.suffix[to] = self.moves[up].get(c, 0)
                self.next_own[to] = up if own[up] >= 0 else self.next_own[up]
                queue.append(to)
        self.own, self.options, self.learnt = own, [None] * len(own), 0

    def _new(self, at: int, c: str, own: list) -> int:
        self.moves[at][c] = len(self.moves)
        self.moves.append({})
        own.append(-1)
        return len(own) - 1

    def _move(self, at: int, c: str) -> int:
        up = at
        while up and c not in self.moves[up]:
            up = self.suffix[up]
        to = self.moves[up].get(c, 0)
        if to and self.learnt < MOVE_CACHE:
            self.learnt += 1
            self.moves[at][c] = to
        return to

    def _options(self, at: int) -> tuple:
        """Pieces that end in a state, the longest first; for BPE those that it makes of their own characters."""
        out, to = [], at
        while to:
            i = self.own[to]
            if i >= 0 and (not self.bpe or self.length[i] == 1 or self._spines(self.piece[i])[2]):
                out.append((i, self.length[i]))
            to = self.next_own[to]
        self.options[at] = tuple(out)
        return self.options[at]

    def _spines(self, text: str) -> tuple[list, list, bool]:
        """How BPE builds ``text`` on its own: its rightmost symbol over time, its leftmost one, each with the rank of the
        merge that ends it, and whether one symbol is left."""
        if text in self.built:
            return self.built[text]
        parts = list(text)
        right, left = [], []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                break
            if at == len(parts) - 2:
                right.append((parts[-1], -best))
            if at == 0:
                left.append((parts[0], -best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.built[text] = (right + [(parts[-1], math.inf)], left + [(parts[0], math.inf)], len(parts) == 1)
        return self.built[text]

    def _apart(self, before: str, piece: str) -> bool:
        """Whether no merge joins two pieces side by side: while a pair of symbols faces each other at the border, their merge
        must rank behind the one that ends either (of equal ranks the one more to the left comes first)."""
        right, left = self._spines(before)[0], self._spines(piece)[1]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            k = self.ids.get(x + y)
            if k is not None and -self.scores[k] < x_ends and -self.scores[k] <= y_ends:
                return False
            if x_ends == y_ends == math.inf:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _goes(self, before: int, piece: int) -> bool:
        if len(self.pairs) >= PAIR_CACHE:
            self.pairs.clear()
        got = self.pairs[before * self.width + piece] = self._apart(self.piece[before], self.piece[piece])
        return got

    def _extend_bpe(self, word: str, n: int, last: list, at: list) -> None:
        """Forward states of the prefixes of ``word`` longer than n: the last piece, or -1 for a character without one."""
        moves, options, pairs, width = self.moves, self.options, self.pairs, self.width
        state = at[n]
        for i in range(n, len(word)):
            c = word[i]
            state = moves[state].get(c) or self._move(state, c)
            at.append(state)
            found = options[state]
            if found is None:
                found = self._options(state)
            for piece, size in found:
                before = last[i + 1 - size]
                if before >= 0 and i + 1 > size:
                    ok = pairs.get(before * width + piece)
                    if ok is None:
                        ok = self._goes(before, piece)
                    if not ok:
                        continue
                last.append(piece)
                break
            else:
                last.append(-1)

    def _extend_unigram(self, word: str, n: int, last: list, at: list, score: list) -> None:
        state = at[n]
        for i in range(n, len(word)):
            c = word[i]
            state = self.moves[state].get(c) or self._move(state, c)
            at.append(state)
            best, pick = -math.inf, -1
            for piece, size in self.options[state] or self._options(state):
                s = score[i + 1 - size] + self.scores[piece]
                if s > best:
                    best, pick = s, piece
            if c not in self.ids and score[i] + self.floor > best:
                best, pick = score[i] + self.floor, -1
            last.append(pick)
            score.append(best)

    def encode_sorted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has; words in ascending order."""
        out: list[int] = []
        sizes: list[int] = []
        before, last, at, score = "", [-1], [0], [0.0]
        length = self.length
        for word in words:
            n, m = _common(before, word), len(word)
            self.states += m
            self.reused += n
            del last[n + 1 :], at[n + 1 :]
            if self.bpe:
                self._extend_bpe(word, n, last, at)
            else:
                del score[n + 1 :]
                self._extend_unigram(word, n, last, at, score)
            own: list[int] = []
            i = m
            while i:
                piece = last[i]
                if piece >= 0:
                    own.append(piece)
                    i -= length[piece]
                else:
                    i -= 1
                    own.extend(self.raw.get(x, self.unk) for x in reversed(word[i].encode("utf-8"))) if self.raw else own.append(self.unk)
            own.reverse()
            out += own
            sizes.append(len(own))
            before = word
        return np.array(out, np.int32), np.array(sizes, np.int64)


def _common(a: str, b: str) -> int:
    """Length of the common prefix; neighbours in order share most of it."""
    n = min(len(a), len(b))
    if n > 64 and a[:n] != b[:n]:
        n = next(i for i in range(n) if a[i] != b[i])
    while a[:n] != b[:n]:
        n -= 1
    return n


def _spaced(key: np.ndarray, gap: np.ndarray, factor: np.uint64) -> np.ndarray:
    """Keys of words with so many spaces before them."""
    return np.where(gap > 1, mix(key ^ (gap.astype(np.uint64) * factor)), key)


def _keys_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two keys of marked words, as ``_marked`` gives them."""
    bare = [w.replace(_MARK.tobytes(), b"") for w in words]
    size = np.array([len(b) for b in bare], np.int64)
    gap = (np.array([len(w) for w in words], np.int64) - size) // 3
    found = words_of(np.frombuffer(b"".join(bare), np.uint8), np.concatenate([[0], np.cumsum(size)]), lower=False, space=_BLANK, second=True)
    out = []
    for own, factor in ((found.hashes, _GAP), (found.second, _GAP2)):
        key = mix(gap.astype(np.uint64) * factor + np.uint64(1))
        key[size > 0] = _spaced(own, gap[size > 0], factor)
        out.append(key)
    return out[0], out[1]


def _marked(data: np.ndarray, offs: np.ndarray):
    """Marked words of a chunk: two keys, spaces before, byte spans, and their offsets per text."""
    words = words_of(data, offs, lower=False, space=_BLANK, second=True)
    n = len(words.starts)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(words.offs))
    prev = np.concatenate([[0], words.ends[:-1]])
    head = np.zeros(n, bool)
    head[words.offs[:-1][np.diff(words.offs) > 0]] = True
    gap = np.where(head, words.starts - offs[doc] + 1, words.starts - prev) if n else np.zeros(0, np.int64)
    # what follows the last word: a run of spaces (with the dummy prefix, where there is no word)
    some = np.diff(words.offs) > 0
    tail = offs[1:] - offs[:-1] + 1
    tail[some] = offs[1:][some] - words.ends[words.offs[1:][some] - 1]
    tail[np.diff(offs) == 0] = 0
    rest = np.flatnonzero(tail > 0)
    at = words.offs[1:][rest]
    starts, ends = np.insert(words.starts, at, offs[1:][rest]), np.insert(words.ends, at, offs[1:][rest])
    keys = [
        np.insert(_spaced(own, gap, factor), at, mix(tail[rest].astype(np.uint64) * factor + np.uint64(1)))
        for own, factor in ((words.hashes, _GAP), (words.second, _GAP2))
    ]
    counts = np.diff(words.offs) + (tail > 0)
    return keys[0], keys[1], np.insert(gap, at, tail[rest]), starts, ends, np.concatenate([[0], np.cumsum(counts)])


def _spaces_for_marks(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.replace_substring(pc.fill_null(column, ""), MARK, " ")


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of ``pool``, one after another."""
    end = np.cumsum(size)
    return pool[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


def _binary(data: np.ndarray, size: np.ndarray, kind=None) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(size)])
    kind = kind or pa.large_binary()
    offs = offs.astype(np.int64 if kind in (pa.large_binary(), pa.large_string()) else np.int32)
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])


def _spell(data: np.ndarray, gap: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The marked words as bytes."""
    size = 3 * gap + ends - starts
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    marks = 3 * gap
    out[np.repeat(end - size - np.cumsum(marks) + marks, marks) + np.arange(marks.sum())] = np.tile(_MARK, int(gap.sum()))
    own = ends - starts
    before = np.cumsum(own) - own
    step = np.arange(own.sum())
    out[np.repeat(end - own - before, own) + step] = data[np.repeat(starts - before, own) + step]
    return _binary(out, size)


class Group:
    """Distinct marked words of consecutive chunks, and which of them each place holds."""

    def __init__(self, chunks: list):
        marked = [_marked(data, offs) for data, offs in chunks]
        self.keys = np.concatenate([m[0] for m in marked])
        self.second = np.concatenate([m[1] for m in marked])
        self.first, self.inverse = distinct_keys(self.keys, self.second)
        base = np.cumsum([0] + [len(data) for data, _ in chunks])
        self.gap = np.concatenate([m[2] for m in marked])
        self.starts = np.concatenate([m[3] + b for m, b in zip(marked, base)])
        self.ends = np.concatenate([m[4] + b for m, b in zip(marked, base)])
        self.data = np.concatenate([data for data, _ in chunks]) if len(chunks) > 1 else chunks[0][0]
        self.texts = np.concatenate([[0], *(offs[1:] + b for (_, offs), b in zip(chunks, base))])
        places = np.cumsum([0] + [len(m[0]) for m in marked])
        self.offs = np.concatenate([[0], *(m[5][1:] + p for m, p in zip(marked, places))])

    def spelled(self, which: np.ndarray) -> pa.Array:
        at = self.first[which]
        return _spell(self.data, self.gap[at], self.starts[at], self.ends[at])


def _groups(column: pa.Array) -> Iterator[tuple[int, int, Group]]:
    """(first row, end row, words) of consecutive texts with about ``TOGETHER`` bytes."""
    begin, held, size = 0, [], 0
    for i, j, _, _ in text_chunks(column):
        held += [(data, offs) for _, _, data, offs in text_chunks(_spaces_for_marks(column.slice(i, j - i)))]
        size += len(held[-1][0])
        if size >= TOGETHER or j == len(column):
            yield begin, j, Group(held)
            begin, held, size = j, [], 0


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, g in _groups(batch.column(0)):
            words = g.spelled(np.arange(len(g.first))).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(g.inverse, minlength=len(g.first)))], ["w", "cnt"])


def _words(column: pa.Array) -> list[str]:
    return [x.decode("utf-8", "replace") for x in column.to_pylist()]


def _encode_words(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            ids, size = encoder.encode_sorted(_words(batch.column(0)))
            keys = [pa.array(k.view(np.int64)) for k in _keys_of(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*keys, _binary(ids.view(np.uint8), 4 * size, pa.binary())], ["h", "h2", "ids"])

    return run


class Decoder:
    """Bytes of pieces; any id outside the model is the unknown piece."""

    def __init__(self, model: dict):
        spelled = [b""] * model["size"] + [" ⁇ ".encode()]
        for piece, i in model["ids"].items():
            spelled[i] = piece.replace(MARK, " ").encode()
        for byte, i in model["bytes"].items():
            spelled[i] = bytes([byte])
        spelled[model["unk"]] = spelled[-1]
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.start, self.pool = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(spelled), np.uint8)

    def texts(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, first, end) of the texts of ids[offs[i]:offs[i+1]], without the dummy prefix."""
        ids = np.where((ids < 0) | (ids >= len(self.size)), len(self.size) - 1, ids)
        size = self.size[ids]
        raw = _gather(self.pool, self.start[ids], size)
        ends = np.concatenate([[0], np.cumsum(size)])[offs]
        first, end = ends[:-1].copy(), ends[1:]
        some = np.flatnonzero(end > first)
        first[some[raw[first[some]] == 0x20]] += 1
        return raw, first, end


def _group_ids(g: Group, encoder: Encoder, head: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a group's texts, and their offsets."""
    keys, second, start, size, pool = head
    k = g.keys[g.first]
    at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
    known = (keys[at] == k) & (second[at] == g.second[g.first]) if len(keys) else np.zeros(len(k), bool)
    rare = np.flatnonzero(~known)
    spelled = _words(g.spelled(rare))
    order = sorted(range(len(rare)), key=spelled.__getitem__)
    ids, n = encoder.encode_sorted([spelled[i] for i in order])
    begin, many = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    if len(keys):
        begin[known], many[known] = start[at[known]], size[at[known]]
    begin[rare[order]], many[rare[order]] = len(pool) + np.cumsum(n) - n, n
    many = many[g.inverse]
    run = np.concatenate([[0], np.cumsum(many)])
    return _gather(np.concatenate([pool, ids]), begin[g.inverse], many), run[g.offs]


def _same_texts(g: Group, raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each decoded text is the group's."""
    same = end - first == np.diff(g.texts)
    return np.array([bool(ok) and np.array_equal(raw[a:b], g.data[c:d]) for ok, a, b, c, d in zip(same, first, end, g.texts[:-1], g.texts[1:])], bool)


def _encode_rows(model, head, text: str, keep: list[str], check: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(model.value), Decoder(model.value)
        for batch in batches:
            for i, j, g in _groups(batch.column(text)):
                ids, offs = _group_ids(g, encoder, head.value)
                more = [pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))]
                if check:
                    more.append(pa.array(_same_texts(g, *decoder.texts(ids, offs))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in keep), *more], names)

    return run


def _decoder_udf(model):
    held: list[Decoder] = []

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        if not held:
            held.append(Decoder(model.value))
        decoder = held[0]
        ids = pc.fill_null(ids, [])
        flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
        offs = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
        out, i = [], 0
        while i < len(ids):
            j = min(len(ids), max(i + 1, int(np.searchsorted(offs, offs[i] + (1 << 19), "right")) - 1))
            raw, first, end = decoder.texts(flat[offs[i] : offs[j]].astype(np.int64), offs[i : j + 1] - offs[i])
            raw = raw.tobytes()
            out += [raw[a:b].decode("utf-8", "replace") for a, b in zip(first.tolist(), end.tolist())]
            i = j
        return pa.array(out, pa.string())

    return decode


def encode(docs: DataFrame, model: dict, text: str = "text", ids: str = "ids", exact: str | None = None, head_limit: int = HEAD_WORDS) -> DataFrame:
    """``docs`` with the piece ids of its text column as array<int>; ``exact``: a boolean column of that name is added too, whether decoding the
    ids gives the text back."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "pieces")
    shared = spark.sparkContext.broadcast(model)
    column = F.col(quoted(text)).cast("string")
    words = docs.select(column.alias("text")).mapInArrow(_distinct, "w binary, cnt long").groupBy("w").agg(F.sum("cnt").alias("cnt"))
    words = tmp.save(words.where(F.octet_length("w") <= HEAD_BYTES), "words")
    common = words.where(F.col("cnt") >= head_threshold(words, head_limit)).sortWithinPartitions("w")
    table = common.select("w").mapInArrow(_encode_words(shared), "h long, h2 long, ids binary").toArrow()
    tmp.drop(words)
    keys, second = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h", "h2"))
    order = np.argsort(keys)
    raw = table.column("ids").combine_chunks()
    raw = raw if not isinstance(raw, pa.ChunkedArray) else pa.concat_arrays(raw.chunks)
    bounds = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) // 4 if len(raw) else np.zeros(1, np.int64)
    pool = np.frombuffer(raw.buffers()[2], np.int32).copy() if len(raw) and raw.buffers()[2] is not None else np.zeros(0, np.int32)
    head = spark.sparkContext.broadcast((keys[order], second[order], bounds[:-1][order], np.diff(bounds)[order], pool))
    added = [ids] if exact is None else [ids, exact]
    keep = [f for f in docs.schema.fields if f.name not in added]
    # they travel under names that any of Spark's functions takes
    names, own = [f.name for f in keep], [f"c{k}" for k in range(len(keep))]
    travelling = [F.col(quoted(n)).alias(c) for n, c in zip(names, own)]
    if text in names and docs.schema[text].dataType == T.StringType():
        rows, source = docs.select(*travelling), own[names.index(text)]
    else:
        rows, source = docs.select(*travelling, column.alias("text")), "text"
    new = ["ids"] if exact is None else ["ids", "exact"]
    types = [T.StructField(c, f.dataType) for c, f in zip(own, keep)] + [T.StructField("ids", T.ArrayType(T.IntegerType())), *([] if exact is None else [T.StructField("exact", T.BooleanType())])]
    done = rows.mapInArrow(_encode_rows(shared, head, source, own, exact is not None, own + new), T.StructType(types))
    return done.toDF(*names, *added)


def decode(rows: DataFrame, model: dict, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of an array<int> column of piece ids."""
    return rows.withColumn(text, _decoder_udf(rows.sparkSession.sparkContext.broadcast(model))(F.col(ids)))


def digest(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, ids_md5 (of the ids joined by spaces), exact (decoding gives the text back)."""
    both = encode(docs.select("doc_id", F.col("text").cast("string").alias("text")), model, exact="exact")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(ids).alias("ids_md5"), "exact")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_model(model_path()))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLE: dict[str, str] = {}
