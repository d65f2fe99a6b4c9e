"""Joins of items, sources and runs on what is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reported_before(items: DataFrame, ledger: DataFrame, key: str, url: str, reported: str, urls: str) -> DataFrame:
    """``items`` with ``reported``: whether an entry with the item's key or one of its URLs has been reported."""
    done = ledger.where(F.col(reported).isNotNull())
    signs = done.select(F.explode(F.concat(F.array(F.concat(F.lit("k:"), F.col(key))), F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.concat(F.lit("u:"), u)))).alias("tw_sign"))
    own = items.select("*", F.array(F.concat(F.lit("k:"), F.col(key)), F.concat(F.lit("u:"), F.col(url))).alias("tw_signs"))
    hit = own.select("item_id", F.explode("tw_signs").alias("tw_sign")).join(signs.distinct(), "tw_sign", "left_semi").select(F.col("item_id").alias("tw_hit")).distinct()
    return items.join(hit, F.col("item_id") == F.col("tw_hit"), "left").withColumn("reported", F.col("tw_hit").isNotNull()).drop("tw_hit")


def notes_merged(left: DataFrame, right: DataFrame, key: str, between: str) -> DataFrame:
    """(key, note): the notes of both sides, joined by ``between`` where both have one; one shuffle, no outer join."""
    both = left.select(key, F.col("note").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(right.select(key, F.lit(None).cast("string").alias("a"), F.col("note").alias("b")))
    found = both.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return found.select(key, F.concat_ws(between, "a", "b").alias("note"))


def filled_up(fresh: DataFrame, backlog: DataFrame, key: str, order: str) -> DataFrame:
    """Fresh rows, and of the backlog those whose key no fresh row has; of several rows of a key the first by ``order``."""
    both = fresh.withColumn("tw_rank", F.lit(0)).unionByName(backlog.withColumn("tw_rank", F.lit(1)))
    whole = F.struct(*fresh.columns, (F.col("tw_rank") == 1).alias("from_backlog"))
    return both.groupBy(key).agg(F.min_by(whole, F.struct("tw_rank", order)).alias("tw_row")).select("tw_row.*")


def prepared(new: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """(key, is_new, pending_waiting, force_refresh): new items and waiting ones together; those that waited are fetched again."""
    tagged = new.select(key, F.lit(True).alias("n"), F.lit(False).alias("p")).unionByName(pending.select(key, F.lit(False).alias("n"), F.lit(True).alias("p")))
    found = tagged.groupBy(key).agg(F.bool_or("n").alias("is_new"), F.bool_or("p").alias("pending_waiting"))
    return found.withColumn("force_refresh", F.col("pending_waiting"))


def newest(rows: DataFrame, at: str, tie: str, limit: int = 5000) -> DataFrame:
    """The newest rows, as a cache of ``limit`` entries keeps them; Spark keeps that many per task."""
    return rows.orderBy(F.desc(at), F.asc(tie)).limit(limit)


def mean_score(score: Column) -> Column:
    """Average of a group, 0 without any."""
    return F.coalesce(F.avg(score), F.lit(0.0))
