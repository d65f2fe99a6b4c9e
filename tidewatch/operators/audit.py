"""Counts and shares by source, status and method, and merging of sets and audits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n) for each column, in one pass over the rows.

    Spark expands each row once per column before the partial aggregate.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def share_where(rows: DataFrame, group: str, flag: Column, least: float = 0.0) -> DataFrame:
    """(group, rows, flagged, share) of groups in which at least ``least`` of the rows are flagged."""
    found = rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("flagged"))
    return found.withColumn("share", F.round(F.col("flagged") / F.col("rows"), 3)).where(F.col("flagged") >= least * F.col("rows"))


def conditional_counts(rows: DataFrame, group: str, flags: Mapping[str, Column]) -> DataFrame:
    """One row per group with the number of rows for which each flag is true."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def rate(part: Column, whole: Column) -> Column:
    """Share to three places; null of nothing."""
    return F.round(F.try_divide(part, whole), 3)


def side_by_side(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Rows of each table by key, 0 where a table lacks the key; one shuffle for all tables."""
    tagged = None
    for name, df in tables.items():
        part = df.select(F.col(key).alias(key), F.lit(name).alias("tw_table"))
        tagged = part if tagged is None else tagged.unionByName(part)
    flags = {name: F.col("tw_table") == name for name in tables}
    return tagged.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


def samples(rows: DataFrame, group: str, order: str, limit: int = 5) -> DataFrame:
    """(group, total, examples): the number of rows and the first ``limit`` by ``order``."""
    from tidewatch.operators.ranking import cap_per_group

    totals = rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    first = cap_per_group(rows.select(group, order), group, [F.col(order)], limit)
    return totals.join(first.groupBy(group).agg(F.array_sort(F.collect_list(order)).alias("examples")), group, "left")


def matrix(rows: DataFrame, row: str, column: str, values: list[str], cell: Column) -> DataFrame:
    """One row per ``row`` with a column for each of ``values``, filled by the aggregate ``cell``."""
    return rows.groupBy(row).pivot(column, values).agg(cell)
