"""Keyset pages and top-k, the shape of all ranked listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 20


def top(rows: DataFrame, score: str, limit: int = LIMIT, tie: str = "id") -> DataFrame:
    """The first rows by score and then id, both falling: a top-k, never a full sort."""
    return rows.orderBy(F.col(score).desc_nulls_last(), F.col(tie).desc_nulls_last()).limit(limit)


def after(rows: DataFrame, score: str, bound: DataFrame, tie: str = "id") -> DataFrame:
    """Rows that follow the bound, a one-row table of (score, tie); all rows if it is empty.

    The bound is compared at the score's own precision.
    """
    one = bound.select(F.col(score).alias("__bs"), F.col(tie).alias("__bt")).limit(1)
    behind = (F.col(score) < F.col("__bs")) | ((F.col(score) == F.col("__bs")) & (F.col(tie) < F.col("__bt")))
    return rows.join(F.broadcast(one), F.lit(True), "left").where(F.col("__bs").isNull() | behind).drop("__bs", "__bt")


def page(rows: DataFrame, score: str, last: object = None, limit: int = LIMIT, tie: str = "id") -> DataFrame:
    """The page after the row whose ``tie`` is ``last``; the first page for None."""
    if last is None:
        return top(rows, score, limit, tie)
    return top(after(rows, score, rows.where(F.col(tie) == last)), score, limit, tie)


def two_tier(rows: DataFrame, pinned: Column, score: str, limit: int = LIMIT, tie: str = "id") -> DataFrame:
    """Pinned rows first (newest first), the rest of the page from the ranking; with column ``tier``."""
    first = rows.where(pinned).orderBy(F.col(tie).desc()).limit(limit).withColumn("tier", F.lit(0))
    rest = top(rows.where(~pinned), score, limit, tie).withColumn("tier", F.lit(1))
    return first.unionByName(rest).orderBy("tier", F.when(F.col("tier") == 1, F.col(score).cast("double")).desc_nulls_last(), F.col(tie).desc()).limit(limit)


def top_per_group(rows: DataFrame, group: str, order: Column, limit: int) -> DataFrame:
    """The first rows of each group; Spark keeps no more than ``limit`` a group and task."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("__at", at).where(F.col("__at") <= limit).drop("__at")


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__at", at).where("__at = 1").drop("__at")
