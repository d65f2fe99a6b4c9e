"""The ledger of items seen: first and last sightings, upserts, replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.merging import recent_distinct


def sightings(rows: DataFrame, key: str, run: str) -> DataFrame:
    """(key, first_seen, last_seen, run_count): each run counts once, however often the key came up in it."""
    per_run = rows.groupBy(key, run).agg(F.count(F.lit(1)).alias("n"))
    return per_run.groupBy(key).agg(F.min(run).alias("first_seen"), F.max(run).alias("last_seen"), F.count(F.lit(1)).alias("run_count"))


def upsert(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger after a batch; both have key, first_seen, last_seen and run_count.

    Dates widen, counts add up; keys new to the ledger are inserted.  One
    union and aggregate, so a batch may itself repeat keys.
    """
    columns = ["key", "first_seen", "last_seen", "run_count"]
    both = ledger.select(*columns).unionByName(batch.select(*columns))
    return both.groupBy("key").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("run_count").alias("run_count"))


def merge_entries(entries: DataFrame, key: str, order: str, limit: int = 12) -> DataFrame:
    """Entries of one key as one: earliest first dates, latest last dates, largest count, bounded titles, all URLs.

    ``entries`` has first_seen_run_date, last_seen_run_date, seen_run_count,
    content_hash, titles and urls.  The smallest hash is kept.
    """
    heads = entries.groupBy(key).agg(
        F.min("first_seen_run_date").alias("first_seen_run_date"),
        F.max("last_seen_run_date").alias("last_seen_run_date"),
        F.max("seen_run_count").alias("seen_run_count"),
        F.min("content_hash").alias("content_hash"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("urls", F.array().cast("array<string>")))))).alias("urls"),
    )
    titles = entries.select(key, order, F.posexplode("titles").alias("tw_pos", "title"))
    titles = titles.select(key, "title", (F.col(order) * 1000 + F.col("tw_pos")).alias("tw_at"))
    return heads.join(recent_distinct(titles, key, "title", "tw_at", limit).withColumnRenamed("values", "titles"), key, "left")


def checkpoints(rows: DataFrame, source: str, at: str, overlap_hours: int = 6) -> DataFrame:
    """(source, checkpoint, resume_from): how far each source has been read, and where to go on, some hours before."""
    found = rows.groupBy(source).agg(F.max(at).alias("checkpoint"))
    return found.withColumn("resume_from", F.col("checkpoint") - F.expr(f"INTERVAL {overlap_hours} HOURS"))
