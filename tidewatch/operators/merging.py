"""Merging rows of one key, keeping first or last ones, and folding in order."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_filled(c: str, order: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", order))


def longest(c: str, order: Column) -> Column:
    """The longest text, the first of equals."""
    return F.max_by(c, F.struct(F.length(F.coalesce(F.col(c), F.lit(""))), -order))


def united(c: str) -> Column:
    """Sorted union of arrays."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(c), F.array().cast("array<string>"))))))


def merge(rows: DataFrame, key: str, order: str, fill: Sequence[str] = (), lengthen: Sequence[str] = (), unite: Sequence[str] = ()) -> DataFrame:
    """One row per key: first filled, longest, and united values.  All parts combine on the map side."""
    o = F.col(order)
    parts = [F.min(order).alias(order), F.count(F.lit(1)).alias("merged_rows")]
    parts += [first_filled(c, o).alias(c) for c in fill]
    parts += [longest(c, o).alias(c) for c in lengthen]
    parts += [united(c).alias(c) for c in unite]
    return rows.groupBy(key).agg(*parts)


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by aggregation rather than a window: hot keys combine on the map side."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.min_by(whole, order).alias("tw_row")).select("tw_row.*")


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, order).alias("tw_row")).select("tw_row.*")


def recent_distinct(rows: DataFrame, key: str, value: str, order: str, limit: int = 12) -> DataFrame:
    """(key, values): each key's last ``limit`` values by first appearance, in that order."""
    once = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("tw_at"))
    ranked = once.withColumn("tw_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("tw_at"), F.desc(value))))
    kept = ranked.where(F.col("tw_rank") <= limit)
    pairs = F.array_sort(F.collect_list(F.struct("tw_at", value)))
    return kept.groupBy(key).agg(F.transform(pairs, lambda p: p[value]).alias("values"))


def fold_titles(rows: DataFrame, scope: str, url: str, title: str, order: str, telling: Column) -> DataFrame:
    """(order, kept_order): rows taken in order join an earlier row of their scope with their URL, else with their telling title.

    A row that joined by title does not lend its URL to later ones; that
    depends on the order, so each scope is folded by itself in one pass.
    """
    narrow = rows.select(F.col(scope).alias("s"), F.col(url).alias("u"), F.when(telling, F.col(title)).alias("t"), F.col(order).cast("bigint").alias("o"))
    # only rows that share a URL or a title with another can join: the fold sees no others
    shared_url = narrow.where("u IS NOT NULL").groupBy("s", "u").count().where("count > 1").drop("count")
    shared_title = narrow.where("t IS NOT NULL").groupBy("s", "t").count().where("count > 1").drop("count")
    marked = narrow.join(shared_url.withColumn("su", F.lit(True)), ["s", "u"], "left").join(shared_title.withColumn("st", F.lit(True)), ["s", "t"], "left")
    lone = marked.where("su IS NULL AND st IS NULL").select(F.col("o").alias(order), F.col("o").alias("kept_order"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        by_url: dict[str, int] = {}
        by_title: dict[str, int] = {}
        kept = []
        group = group.sort_values("o")
        for u, t, o in zip(group["u"], group["t"], group["o"]):
            if u is not None and u in by_url:
                kept.append(by_url[u])
            elif t is not None and t in by_title:
                kept.append(by_title[t])
            else:
                if u is not None:
                    by_url[u] = o
                if t is not None:
                    by_title.setdefault(t, o)
                kept.append(o)
        return pd.DataFrame({order: group["o"], "kept_order": kept})

    contested = marked.where("su OR st").select("s", "u", "t", "o")
    return lone.unionByName(contested.groupBy("s").applyInPandas(fold, f"`{order}` bigint, kept_order bigint"))
