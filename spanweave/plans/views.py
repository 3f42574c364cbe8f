"""The driver's tables in the roles that the operators work on, in Spark and in oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark, sf_dir) -> DataFrame:
    """lineitem as named intervals: chrom from the supplier, start from the order, length from the quantity."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_suppkey").cast("string").alias("chrom"),
        F.col("l_orderkey").alias("start"),
        (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"),
        F.col("l_returnflag").alias("name"),
    )


IV = "iv AS (SELECT CAST(l_suppkey AS VARCHAR) AS chrom, l_orderkey AS s, l_orderkey + CAST(l_quantity AS BIGINT) AS e, l_returnflag AS name FROM lineitem)"


def targets(spark, sf_dir) -> DataFrame:
    """orders as named targets of length 5 on chromosomes by customer."""
    t = table(spark, sf_dir, "orders")
    return t.select((F.col("o_custkey") % 100).cast("string").alias("chrom"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 5).alias("end"), F.col("o_orderpriority").alias("name"))


TGT = "tgt AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS chrom, o_orderkey AS s, o_orderkey + 5 AS e, o_orderpriority AS name FROM orders)"


def merged_sql(source: str, name: str, gap: int = 0) -> str:
    return (
        f"{name}_p AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {source}), "
        f"{name}_g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_p), "
        f"{name} AS (SELECT chrom, min(s) AS s, max(e) AS e, count(*) AS n FROM {name}_g GROUP BY chrom, isl)"
    )


def pairs(spark, sf_dir) -> DataFrame:
    """lineitem as interval pairs: one side by supplier and order, one by part."""
    t = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    return t.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.cast("string")).alias("pair"),
        (F.col("l_suppkey") % 10).cast("string").alias("chrom1"), F.col("l_orderkey").alias("start1"), (F.col("l_orderkey") + q).alias("end1"),
        (F.col("l_partkey") % 10).cast("string").alias("chrom2"), (F.col("l_partkey") * 3).alias("start2"), (F.col("l_partkey") * 3 + q).alias("end2"),
        (F.col("l_discount") * 10).alias("score"),
    )


PAIRS = (
    "pr AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS pair, CAST(l_suppkey % 10 AS VARCHAR) AS chrom1, l_orderkey AS start1, "
    "l_orderkey + CAST(l_quantity AS BIGINT) AS end1, CAST(l_partkey % 10 AS VARCHAR) AS chrom2, l_partkey * 3 AS start2, l_partkey * 3 + CAST(l_quantity AS BIGINT) AS end2, l_discount * 10 AS score FROM lineitem)"
)


def genotypes(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_partkey").alias("variant"), F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("gt"), (F.col("l_partkey") % 50).alias("window"))


def steps(spark, sf_dir) -> DataFrame:
    """Turns of conversations as steps of paths; the node is the first word of the turn."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("path"), F.col("turn").alias("ord"), F.coalesce(F.split("text", " ")[0], F.lit("")).alias("node"), F.length("text").cast("long").alias("len"), "role")
