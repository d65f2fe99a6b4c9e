"""The ledger kept by a stream: micro-batches of sightings merged into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.ledger import sightings, upsert
from tidewatch.sources.state import VersionedTable

LEDGER = "key string, first_seen date, last_seen date, run_count bigint, batches array<bigint>"


def ledger_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, LEDGER)


def merge_batch(table: VersionedTable, batch: DataFrame, batch_id: int, key: str, run: str) -> None:
    """Merge one micro-batch, once: a batch the table has already is left out, so a restart can't count it twice."""
    state = table.read()
    done = state.select(F.explode("batches").alias("b")).where(F.col("b") == batch_id)
    if not done.isEmpty():
        return
    seen = sightings(batch, key, run).withColumnRenamed(key, "key")
    merged = upsert(state, seen)
    kept = state.select(F.col("key").alias("k"), "batches")
    mark = F.array(F.lit(batch_id).cast("bigint"))
    new = merged.join(kept, F.col("key") == F.col("k"), "left").join(seen.select(F.col("key").alias("s")), F.col("key") == F.col("s"), "left")
    batches = F.when(F.col("s").isNotNull(), F.slice(F.array_union(F.coalesce("batches", F.array().cast("array<bigint>")), mark), -1, 1)).otherwise(F.col("batches"))
    table.write(new.select("key", "first_seen", "last_seen", "run_count", batches.alias("batches")))


def run_available(stream: DataFrame, table: VersionedTable, checkpoint: str, key: str, run: str) -> StreamingQuery:
    """Read everything there is now, micro-batch by micro-batch, into the ledger."""
    query = (
        stream.writeStream.foreachBatch(lambda df, n: merge_batch(table, df, n, key, run))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def late_events(events: DataFrame, at: str, key: str, delay: str = "6 hours") -> DataFrame:
    """Events deduplicated by key within the watermark, so re-read overlaps count once."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
