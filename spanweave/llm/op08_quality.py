"""Document quality: histogram gradient-boosted trees over document statistics.

Every statistic is computed from the whole text by vectorised passes over its bytes. The
trees are trained with numpy on at most ``TRAIN_ROWS`` labelled rows (those with the smallest
hash of doc_id; the bound is a parameter), flattened into arrays of complete trees, and all
documents walk all trees at once with numpy. Texts are read twice, but only those of the sample have their statistics taken twice: it is drawn by
doc_id alone, and a Bloom filter of its ids picks its texts.

Defined cases: null text counts as empty and is scored like any text; a doc_id with several
labels takes part only if they agree; null labels are left out; without any training row every
score is 1.0; one output row per input row, repeated or null doc_id included (a null doc_id is
never held out); columns other than those named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm.idfilter import IdFilter
from spanweave.llm.text import text_chunks, words_of
from spanweave.scratch import Scratch

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
_COUNTED = b"!#$%&*|.,;:/@\"'<>{}()[]-_=+?~^\\"
_NEWLINE = np.zeros(256, bool)
_NEWLINE[[0x0A, 0x0D]] = True


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[ord("a") : ord("z") + 1] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[[0x20, 0x09, 0x0B, 0x0C]] = 4
    out[[0x0A, 0x0D]] = 5
    out[0x80:] = 6
    for k, c in enumerate(_COUNTED):
        out[c] = 7 + k
    return out


_CLASS = _byte_classes()
N_CLASSES = 7 + len(_COUNTED)
N_FEATURES = N_CLASSES + 15


def _spread(hashes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct share and the share of the commonest value, for each document."""
    n = len(offs) - 1
    distinct, top = np.ones(n), np.zeros(n)
    for i in range(n):
        a, b = offs[i], offs[i + 1]
        if b > a:
            part = np.sort(hashes[a:b])
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            distinct[i], top[i] = (len(cut) - 1) / (b - a), np.diff(cut).max() / (b - a)
    return distinct, top


def _per_document(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return run[offs[1:]] - run[offs[:-1]]


def features(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    parts = []
    for i, j, data, offs in text_chunks(column):
        n = j - i
        size = np.diff(offs)
        words, lines = words_of(data, offs), words_of(data, offs, space=_NEWLINE)
        doc = np.repeat(np.arange(n), size)
        classes = np.bincount(doc * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
        nw, nl = np.diff(words.offs), np.diff(lines.offs)
        wl = (words.ends - words.starts).astype(float)
        ll = (lines.ends - lines.starts).astype(float)
        w1, l1 = np.maximum(nw, 1), np.maximum(nl, 1)
        last = _CLASS[data[words.ends - 1]] if len(wl) else np.zeros(0)
        first = _CLASS[data[words.starts]] if len(wl) else np.zeros(0)
        letters = np.maximum(classes[:, 1] + classes[:, 2], 1)
        mean = _per_document(wl, words.offs) / w1
        distinct_w, top_w = _spread(words.hashes, words.offs)
        distinct_l, top_l = _spread(lines.hashes, lines.offs)
        two = words.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + words.hashes[1:] if len(wl) > 1 else np.zeros(0, np.uint64)
        distinct_2, _ = _spread(two, np.minimum(words.offs, len(two)))
        more = [
            np.log1p(size),
            np.log1p(nw),
            np.log1p(nl),
            mean,
            np.sqrt(np.maximum(_per_document(wl * wl, words.offs) / w1 - mean**2, 0)),
            _per_document(ll, lines.offs) / l1,
            _per_document(last >= 7, words.offs) / w1,
            _per_document(first == 2, words.offs) / w1,
            _per_document(wl > 20, words.offs) / w1,
            classes[:, 2] / letters,
            distinct_w,
            top_w,
            distinct_l,
            top_l,
            distinct_2,
        ]
        parts.append(np.column_stack([classes / np.maximum(size, 1)[:, None], *more]).astype(np.float32))
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES), np.float32)


class Trees:
    """Complete binary trees as flat arrays: node k of a tree has children 2k+1 and 2k+2."""

    def __init__(self, base, feature, threshold, leaf):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def arrays(self) -> tuple:
        return self.base, self.feature, self.threshold, self.leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.leaf):
            return out
        trees, inner = self.feature.shape
        depth = inner.bit_length()
        lane = np.arange(trees)
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                right = part[row, self.feature[lane, node]] > self.threshold[lane, node]
                node = 2 * node + 1 + right
            out[i : i + 4096] += self.leaf[lane, node - inner].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic boosting with Newton leaves; splits are searched over per-feature histograms."""
    inner = 2**depth - 1
    if not len(y):
        return Trees(np.inf, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f].astype(float), np.arange(1, bins) / bins, method="lower")) for f in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    flat = code + np.arange(x.shape[1]) * bins
    margin = np.full(len(y), base)
    feature = np.zeros((rounds, inner), np.int64)
    threshold = np.full((rounds, inner), np.inf)
    leaf = np.zeros((rounds, inner + 1))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (x.shape[1] * bins) + flat).ravel()
            shape = (width, x.shape[1], bins)
            n = width * x.shape[1] * bins
            gs = np.bincount(at, np.repeat(g, x.shape[1]), n).reshape(shape).cumsum(2)
            hs = np.bincount(at, np.repeat(h, x.shape[1]), n).reshape(shape).cumsum(2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[r, first + k], threshold[r, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[r, node]] > threshold[r, node])
        node -= inner
        leaf[r] = -rate * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + ridge)
        margin += leaf[r, node]
    return Trees(base, feature, threshold, leaf)


def _floats(x: np.ndarray, there: np.ndarray) -> pa.Array:
    """A list for each row that is there, null for the others."""
    offs = np.concatenate([[0], np.cumsum(there)]).astype(np.int32) * N_FEATURES
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(x.ravel(), pa.float32()), mask=pa.array(~there))


def _remainder(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Trees:
    """Train on labelled rows of ``docs`` (doc_id, text) that are not held out."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .where(_remainder(F.col("doc_id")) != 2)
    )
    drawn = known.join(ids, "doc_id", "left_semi").select("doc_id", "quality", F.xxhash64("doc_id").alias("k")).orderBy("k", "doc_id").limit(max_rows)
    drawn = Scratch(docs.sparkSession, "quality").save(drawn, "drawn")
    picked = IdFilter(drawn.select(F.col("doc_id").alias("id")))
    hits = picked.probe()

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def statistics(a: pa.Array, b: pa.Array, text: pa.Array) -> pa.Array:
        """Null for texts that cannot be in the sample."""
        hit = hits(a, b)
        return _floats(features(text.filter(pa.array(hit))), hit)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    # else the filter on its result would call it once more
    texts = texts.withColumn("x", statistics.asNondeterministic()(*picked.places(F.col("doc_id")), "text")).where("x is not null")
    # of a doc_id with many rows, too, the bound holds
    rows = texts.select("doc_id", "x").join(drawn, "doc_id").orderBy("k", "doc_id", "x").limit(max_rows).select("x", "quality").toArrow()
    picked.destroy()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    return train(x, rows.column("quality").to_numpy().astype(float))


def _scorer(docs: DataFrame, labels: DataFrame, max_rows: int):
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows).arrays())

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(Trees(*model.value).score(features(text)))

    return scored(F.col("text").cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    held_out = _remainder(F.col("doc_id")) == 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), _scorer(docs, labels, max_rows).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their columns, that the classifier accepts."""
    return docs.where(_scorer(docs, labels, max_rows) >= threshold)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op8_quality": op8_quality}
ORACLE: dict[str, str] = {}
