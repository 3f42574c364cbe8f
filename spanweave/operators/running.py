"""Running values along an order, in two levels: rows of a block of the order in one window, and the blocks' totals in another.

A window over a whole chromosome or path is one task, however long it is. Here a task orders one block of about
``BLOCK_ROWS`` rows, and what crosses the blocks is one row for each of them. Nulls in ``by`` form a group of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
#: A group with no more rows than this needs no blocks: one task may order it.
WHOLE_ROWS = 1 << 16
#: Rows of a task, about, where the session's number of shuffle partitions would give it more.
TASK_ROWS = 1 << 20


def _axis(df: DataFrame, pos: str, by: list[str], rows: int) -> tuple[int, int]:
    groups = df.groupBy(*by).agg(F.count(pos).alias("_n"), F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    dense = F.when(F.col("_n") > WHOLE_ROWS, (F.col("_hi") - F.col("_lo")) * F.lit(rows) / F.col("_n"))
    low, high, width, n = groups.agg(F.min("_lo"), F.max("_hi"), F.min(dense), F.sum("_n")).first()
    if low is None:
        return 1, 0
    return max(1, int(high - low) + 1 if width is None else int(width)), n


def block_span(df: DataFrame, pos: str, by: list[str], rows: int = BLOCK_ROWS) -> int:
    """Width of blocks of the axis that hold about ``rows`` rows of the densest large group on average; the whole axis if all groups are small, so that
    groups are not cut into more blocks than they need."""
    return _axis(df, pos, by, rows)[0]


def in_blocks(df: DataFrame, pos: str, span: int) -> DataFrame:
    """Adds ``_block`` for ``running``."""
    return df.withColumn("_block", F.floor(F.col(pos) / span))


def keyed(df: DataFrame, by: list[str], pos: str, span: int | None = None) -> DataFrame:
    """df with ``_key`` (the group and the block) instead of the columns ``by``: several ``running`` values of one df then share a shuffle. ``unkeyed`` undoes it."""
    n = 0
    if span is None:
        span, n = _axis(df, pos, by, BLOCK_ROWS)
    rows = in_blocks(df, pos, span).select(F.struct(*by, "_block").alias("_key"), *[c for c in df.columns if c not in by])
    parts = -(-n // TASK_ROWS)
    return rows.repartition(parts, "_key") if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def unkeyed(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*[F.col("_key").getField(c).alias(c) for c in by], *[c for c in df.columns if c != "_key"])


def running(df: DataFrame, by: list[str], order: list[str], name: str, value: Column, kind: str, inclusive: bool = True, reverse: bool = False) -> DataFrame:
    """Adds ``name``: the max, sum or last (not null) of ``value`` over the rows of a group up to this one in the order
    (``_block``, order), without it unless ``inclusive``; ``reverse``: over this row and those after it. df is ``keyed``, or has the columns ``by`` and ``_block``.

    Rows equal in the order must not differ in value for ``last``."""
    own = "_key" not in df.columns
    # a struct with nulls equals itself, so the rows meet the totals by a plain join, where the window has dealt them already
    rows = (df.withColumn("_key", F.struct(*by, "_block")) if own else df).withColumn("_v", value)
    turned = [F.desc(c) if reverse else F.asc(c) for c in order]
    inside = Window.partitionBy("_key").orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    group = [F.col("_key").getField(c) for c in by]
    block = F.col("_key").getField("_block")
    across = Window.partitionBy(*group).orderBy(block.desc() if reverse else block.asc()).rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(F.col("_v").isNotNull(), F.struct(*order))
    pick = F.min_by if reverse else F.max_by
    total = {"max": F.max("_v"), "sum": F.sum("_v"), "last": pick("_v", place)}[kind]
    over = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, True)}[kind]
    carried = rows.groupBy("_key").agg(total.alias("_t")).select("_key", over("_t").over(across).alias("_c")).where("_c is not null")
    rows = rows.withColumn("_i", over("_v").over(inside)).join(carried, "_key", "left")
    both = {
        "max": F.greatest("_i", "_c"),
        "sum": F.when(F.col("_i").isNotNull() | F.col("_c").isNotNull(), F.coalesce("_i", F.lit(0)) + F.coalesce("_c", F.lit(0))),
        "last": F.coalesce("_i", "_c"),
    }[kind]
    return rows.select(*([] if own else ["_key"]), *[c for c in df.columns if c != "_key"], both.alias(name))
