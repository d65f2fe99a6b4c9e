"""Caps, samples and orders within and across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_per_group(rows: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """At most ``limit`` rows of each group.  Spark keeps only ``limit`` rows per group and task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("group_rank", rank).where(F.col("group_rank") <= limit)


def round_robin(rows: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first of each group, then the second of each, and so on, ``limit`` rows in all."""
    capped = cap_per_group(rows, group, order, limit)
    return capped.orderBy("group_rank", group).limit(limit)


def batches(rows: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """Rows with ``batch_id``: each group dealt in runs of ``size``."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("batch_id", F.floor((rank - 1) / size).cast("int"))


def changes(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows with ``previous`` (the key's value before) and ``changed`` (both there and different)."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("previous", before).withColumn("changed", F.coalesce(F.col("previous") != F.col(value), F.lit(False)))


def sections(rows: DataFrame, group: str, section: str, order: list[str]) -> DataFrame:
    """Rows with ``section_no``: how often the section has changed so far."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = rows.withColumn("tw_new", F.when(F.lag(section).over(w).eqNullSafe(F.col(section)), 0).otherwise(1))
    return marked.withColumn("section_no", F.sum("tw_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("tw_new")
