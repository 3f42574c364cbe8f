"""Packing, phrase collocations and resampling against brute force, with nulls, empty and very long texts, ties, repeated rows, empty tables
and extra columns whose names clash with the operators' own."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanweave.llm import op11_packing, op12_collocations, op13_resample
from spanweave.llm.text import text_chunks, words_of

SCHEMA = "doc_id long, text string, lang string, length string, k string, row string, score string, `a.b` string, f string"
PICK = random.Random(5)
VOCAB = ["the", "of", "The", "a", "new", "york", "é", "ça", "x1", "ß"] + [f"w{i}" for i in range(30)]


def sentence(n):
    return " ".join(PICK.choice(VOCAB) + PICK.choice(["", "", "", ",", ".", "!", "\n", "\t"]) for _ in range(n))


def rows():
    texts = [None, "", " \n\t ", ".", "one", "Two words", "a\x00b c", "<|endoftext|> x", "the new york " * 3_000, sentence(40_000)]
    texts += [sentence(PICK.randint(1, 120)) for _ in range(60)] + ["New york new york, new york"] * 9
    out = [(i, t, PICK.choice(["en", "fr", None, ""])) for i, t in enumerate(texts)]
    out += [out[20], out[20], (None, texts[21], "en"), (None, texts[21], "en"), (None, None, None), (7, "again", "en")]
    return [(i, t, x, "clash", "clash", "clash", "clash", "clash", "clash") for i, t, x in out]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).select("f", "`a.b`", "text", "doc_id", "lang", "length", "k", "row", "score")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11


def test_span_ids_equal_the_librarys():
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "é", "×", "÷", "中", "'s", "'", "1", "<|endoftext|>", "<|end", ".", ",", "!", "\x00", "\x1c", "\x85", "😀", "ß", "Ã", "̀"]
    texts = ["".join(PICK.choice(parts) for _ in range(PICK.randint(0, 30))) for _ in range(4_000)] + ["", " ", "a ", " a", "a b", "x" * 5_000, "<|endoftext|> <|endoftext|>"]
    spans = op11_packing.SpanIds(op11_packing.tokenizer_path(op11_packing.TOKENIZER))
    for size in (500, 1 << 20):
        for i, j, data, offs in text_chunks(pa.array(texts), size):
            ids, ends = op11_packing.token_ids(spans, data, offs)
            assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [spans.tok.encode(t, add_special_tokens=False).ids for t in texts[i:j]]


def test_fullest_is_the_largest_sum():
    for _ in range(300):
        room = PICK.randint(0, 25)
        counts = [0] + [PICK.randint(0, 3) if PICK.random() < 0.4 else 0 for _ in range(12)]
        longest = PICK.randint(1, 12)
        taken = op11_packing.fullest(counts, room, longest)
        items = [n for n in range(1, longest + 1) for _ in range(counts[n])]
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums if s + n <= room}
        assert sum(n * c for n, c in taken.items()) == max(sums) and all(c <= counts[n] for n, c in taken.items())


@pytest.mark.parametrize("low,high,slack", [(1, 1024, 1.003), (300, 700, 1.01), (1, 30, 1.0), (513, 1023, None)])
def test_plan_takes_every_piece_once(low, high, slack):
    lengths = np.random.default_rng(low).integers(low, high, 50_000)
    counts = np.bincount(lengths, minlength=1025)
    steps, used = op11_packing.plan(counts.tolist(), 1024), Counter()
    for times, taken in steps:
        assert sum(n * c for n, c in taken.items()) <= 1024
        used.update({n: times * c for n, c in taken.items()})
    assert all(used[n] == c for n, c in enumerate(counts))
    best = -(-lengths.sum() // 1024)
    assert sum(t for t, _ in steps) <= (math.ceil(best * slack) if slack else len(lengths))


@pytest.mark.parametrize("capacity", [1024, 37])
def test_packing(docs, none, capacity):
    path = op11_packing.tokenizer_path(op11_packing.TOKENIZER)
    tok = Tokenizer.from_file(path)
    found = op11_packing.pack(docs, path, capacity).collect()
    want = Counter()
    for r in ROWS:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    rest = sum(r.length for r in found if r.length < capacity)
    assert len(sequences) <= sum(r.length == capacity for r in found) + math.ceil(rest / capacity * 1.05) + 1
    empty = op11_packing.pack(none, path)
    assert empty.collect() == [] and empty.columns == op11_packing._OUT


# 12


def brute_collocations(depth, least, top):
    n, f = Counter(), Counter()
    for r in ROWS:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(r[1])):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, depth + 1) for i in range(len(words) - m + 1))
    many = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    out = []
    for (lang, words), a in many.items():
        inside = any(
            x == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer))) and 100 * c >= 100 * a for (x, longer), c in many.items()
        )
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    ranked = []
    for lang, group in itertools.groupby(sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())), key=lambda r: r[0]):
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(itertools.islice(group, top), 1)]
    return ranked


@pytest.mark.parametrize("depth,least,top", [(5, 100, 2000), (5, 8, 50), (3, 12, 2000)])
def test_collocations(docs, none, depth, least, top):
    found = op12_collocations.collocations(docs, depth, least, top)
    assert sorted(map(tuple, found.collect())) == sorted(brute_collocations(depth, least, top)) != []
    assert op12_collocations.collocations(none).collect() == []


def test_scores_beyond_64_bits(spark):
    rows = [("und", 0, "", 10**13), ("und", 1, "p", 3 * 10**12), ("und", 1, "q", 3 * 10**12 + 1), ("und", 2, "p q", 10**12)]
    nodes = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    before = op12_collocations.phrase_counts
    op12_collocations.phrase_counts = lambda *a: nodes
    try:
        found = op12_collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect()
    finally:
        op12_collocations.phrase_counts = before
    assert [r.score for r in found] == [1000 * 10**12 * 10**13 // (3 * 10**12 * (3 * 10**12 + 1))]


def test_tries_of_parts_merge_to_the_trie_of_all(monkeypatch):
    texts = [r[1] for r in ROWS[20:60]]
    langs = ["en" if i % 3 else "" for i in range(len(texts))]
    every = lambda keys: np.ones(len(keys), bool)

    def trie(size):
        monkeypatch.setattr(op12_collocations, "TOGETHER", size)
        batch = pa.record_batch([pa.array(texts), pa.array(langs)], ["text", "lang"])
        return [op12_collocations.count_trie(t, every, 4) for t in op12_collocations._texts(batch, second=True)]

    def counts(t):
        paths, out = [()], Counter()
        for parent, word, count in t.levels:
            paths = [paths[p] + (t.words[w],) for p, w in zip(parent, word)]
            assert paths == sorted(paths)
            out.update({p: int(c) for p, c in zip(paths, count)})
        return +out

    monkeypatch.setattr(op12_collocations, "text_chunks", lambda column, size: text_chunks(column, size))
    whole, parts = trie(1 << 20), trie(300)
    assert len(whole) == 1 and len(parts) > 5
    assert counts(op12_collocations.merge_tries(parts)) == counts(whole[0])
    cut = [op12_collocations.read_trie(t.write()) for _, t in op12_collocations.slices(whole[0], 7)]
    assert len(cut) == 7 and sum((counts(t) for t in cut), Counter()) == counts(whole[0])


# 13


def brute_resample(corpus, target, most, buckets, least, percent, seed):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
    runs = lambda w: [" ".join(w[i : i + m]) for m in range(1, most + 1) for i in range(len(w) - m + 1)]
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s = Counter(bucket(x) for r in corpus for x in runs(split(r[1])))
    t = Counter(bucket(x) for text in target for x in runs(split(text)))
    big, small = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for r in corpus:
        words = split(r[1])
        own = runs(words)
        gains = [math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * small))) for b in map(bucket, own)]
        weight = sum(gains) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append((r[0], len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter()
    for i, r in enumerate(long[: len(long) * percent // 100], 1):
        drawn[(*r, i)] += 1
    rest = Counter((*r, None) for r in out)
    for r, c in drawn.items():
        rest[(*r[:5], None)] -= c
    return drawn + rest


@pytest.mark.parametrize("most,percent", [(1, 10), (2, 50), (3, 100)])
def test_resample(spark, docs, none, monkeypatch, most, percent):
    target = spark.createDataFrame([("new york new york",), (None,), ("w1 w2 é",)], "text string")
    monkeypatch.setattr(op13_resample, "NODES", 40)  # many tries for each task
    found = op13_resample.resample(docs, target, percent, 20, most, 997, 2024)
    want = brute_resample(ROWS, ["new york new york", None, "w1 w2 é"], most, 997, 20, percent, 2024)
    assert Counter(map(tuple, found.collect())) == want
    assert op13_resample.resample(none, target).collect() == []
    assert op13_resample.resample(docs, none).where(F.col("rank").isNotNull()).count() == sum(c for r, c in brute_resample(ROWS, [], 1, 10_000, 20, 10, 2024).items() if r[5])


def test_trie_states_are_the_crc_of_the_run():
    data = np.frombuffer(b"ab c ab c\xc3\xa9 ab", np.uint8)
    trie = op13_resample.WordTrie(3)
    words = words_of(data, np.array([0, len(data)]), space=op13_resample._BETWEEN, second=True)
    walked = [trie.states()[nodes].tolist() for _, nodes in trie.walk(words) if True]
    assert walked[0] == [zlib.crc32(x.encode()) for x in ("ab", "c", "ab", "cé", "ab")]
    assert [trie.crc[n] for n in list(trie.walk(words))[2][1]] == [zlib.crc32(x.encode()) for x in ("ab c ab", "c ab cé", "ab cé ab")]


# 7, 4 and the stages of the pipeline


def test_dates_are_one_to_one_in_every_notation(spark):
    from spanweave.llm import op07_pseudonyms

    days = spark.range(73_049).select(F.expr("date_add(DATE'1900-01-01', cast(id as int))").alias("d")).repartition(4)
    late = F.day("d") > 12
    forms = F.when(late, F.date_format("d", "dd/MM/yyyy"))
    texts = days.select("d", F.explode(F.array(F.date_format("d", "MM/dd/yyyy"), forms, F.date_format("d", "yyyy-MM-dd"))).alias("text")).where("text is not null")
    done = op07_pseudonyms.pseudonymise(texts.withColumn("old", F.col("text")), "k").select("d", "old", "text")
    month_first, day_first = F.expr("try_to_date(text, 'MM/dd/yyyy')"), F.expr("try_to_date(text, 'dd/MM/yyyy')")
    read = done.withColumn("new", F.when(F.col("text").contains("-"), F.to_date("text")).otherwise(F.coalesce(month_first, day_first)))
    out = read.groupBy("new").agg(F.countDistinct("d").alias("days"), F.count("*").alias("n")).agg(F.max("days"), F.count("*"), F.sum("n")).first()
    assert tuple(out) == (1, 73_049, texts.count())
    assert read.groupBy("d").agg(F.countDistinct("new").alias("n")).where("n > 1").count() == 0


def test_null_and_repeated_ids_have_their_texts_told_apart(spark):
    from spanweave.llm import op04_jaccard_join

    rng = random.Random(9)
    texts = []
    for k in range(60):
        words = [f"t{k}w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words[:-1], "other"])]
    base = [(i, t) for i, t in enumerate(texts)]
    kept = {}
    for name, rows in {"own": base, "null": [(None, t) for _, t in base], "few": [(i % 7, t) for i, t in base], "mixed": [(None if i % 3 else i, t) for i, t in base]}.items():
        df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, `a.b` string")
        found = op04_jaccard_join.near_duplicates(df)
        assert found.count() == len(rows) and {r.n_shingles for r in found.collect()} == {56}
        out = op04_jaccard_join.keep_one(df)
        assert out.columns == df.columns
        kept[name] = sorted({r.text.split()[0][: r.text.index("w")] for r in out.collect()}), out.count()
    assert set(map(str, kept.values())) == {str((sorted(f"t{k}" for k in range(60)), 60))}


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, sentence(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, sentence(30) + " 29/10/1946", "en", "s", 9, "x", i) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `c d` long")
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{tmp_path}/{name}")
        after = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), str(tmp_path))
        assert [c for c in after.columns if c in docs.columns] == docs.columns
        assert {(r["a.b"], r["c d"] == r["doc_id"]) for r in after.collect()} <= {("x", True)}
