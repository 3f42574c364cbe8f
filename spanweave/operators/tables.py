"""Rows by number, tables side by side, and sets of rows.

Defined cases: numbers follow an order that the caller names (equal rows in any order among themselves), never the order of files; nulls are equal
to each other in sets and keys; repeated rows count each unless an operator says distinct; empty tables give none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.scratch import Scratch


def number_rows(df: DataFrame, *order: str, name: str = "row") -> DataFrame:
    """Adds ``name``: 1, 2, ... in the order. Ranges of it are numbered each, and one row for each range adds them up."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = Scratch(df.sparkSession, "rows").save(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_i", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_b") + F.col("_i")).select(*df.columns, name)


def select_rows(df: DataFrame, numbers: DataFrame, *order: str) -> DataFrame:
    """The rows whose number in the order is in ``numbers`` (row)."""
    return number_rows(df, *order).join(numbers.select("row").distinct(), "row", "left_semi").select(*df.columns)


def paste(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """The columns of both side by side, by row number; what one table has more rows than the other stands beside nulls."""
    left, right = number_rows(a, *order_a, name="_row"), number_rows(b, *order_b, name="_row")
    return left.join(right, "_row", "full").select(*a.columns, *b.columns)


def union_distinct(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).distinct()


def with_precedence(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the first table, and those of the second whose key the first does not have."""
    known = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).distinct()
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
    return first.unionByName(second.join(known, on, "left_anti"))


def coordinate_sort(df: DataFrame) -> DataFrame:
    """Rows by chrom, start and end; a total order over range partitions."""
    return df.orderBy("chrom", "start", "end")


def by_class(df: DataFrame, column: str, texts: list[str], keep: bool = True) -> DataFrame:
    """Rows whose class holds one of some texts, or, with ``keep`` false, none of them; a null class holds none."""
    hit = reduce(lambda x, y: x | y, [F.coalesce(F.col(column).contains(t), F.lit(False)) for t in texts])
    return df.where(hit if keep else ~hit)
