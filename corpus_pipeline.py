"""From raw documents to piece ids: quality, near-duplicates, benchmark leaks, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
The intermediate tables of a stage are removed when the next stage begins, as its result has been written by then; so one
pipeline at a time runs in a session.

Defined cases, in every stage: a null or empty text is scored, kept or dropped like any other text, matches no benchmark
item, has no personal data and gives no ids; repeated rows and repeated or null doc_ids are judged each (of near-duplicates
one row stays); an empty table gives an empty one; other columns of any name are kept as they are.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import op03_decontaminate, op04_jaccard_join, op07_pseudonyms, op08_quality, op09_sentencepiece
from spanweave.llm.text import as_row, small_batches
from spanweave.scratch import Scratch, collecting

_OPENED: list[Scratch] = []


def _stage(function):
    @wraps(function)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _OPENED:
            before = _OPENED.pop()
            if before.spark.sparkContext._jsc is not None:  # its session still runs
                before.remove()
        small_batches(spark)
        with collecting(_OPENED):
            return function(spark, docs, sf_dir)

    return begin


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the empty text has a score like any other."""
    return op08_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id; texts without words have no duplicates."""
    return op04_jaccard_join.keep_one(docs)


@_stage
def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; those without words have none."""
    return op03_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated numbers, dates and addresses replaced in the texts; n_chars follows a text that changed. Null stays null."""
    packed = docs.select(as_row(docs).alias("_row"), F.col("text").cast("string").alias("text"))
    done = op07_pseudonyms.pseudonymise(packed, op07_pseudonyms.key_of(spark))
    shown = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.when(F.col("n_replaced") > 0, F.length("text")).otherwise(F.col("_row.n_chars"))
    return done.select(*[shown.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


@_stage
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with ids (piece ids of the text; none for null) and exact (whether decoding them gives the text back); own
    columns of these names are replaced."""
    model = op09_sentencepiece.load_model(op09_sentencepiece.model_path())
    return op09_sentencepiece.encode(docs, model, exact="exact")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", no_leaks),
    ("pseudonyms", pseudonyms),
    ("pieces", pieces),
]

#: Trees, keyed permutations and merges are beyond SQL; a brute-force version in the tests stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        after = tmp.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            tmp.drop(before)
        before = docs = after
    return docs
