"""State kept between runs: versioned tables behind a pointer, histories, page caches, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionedTable:
    """A table written as whole versions; readers follow a pointer that changes last.

    A version is complete before the pointer names it, and the one before is
    kept, so a run that dies leaves the table as it was.  Files go through
    Hadoop's file system: the folder may be on any store the cluster mounts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hpath(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The newest version whose marker is there; 0 without any.  Fails if versions stand there without a marker."""
        if not self._fs.exists(self._hpath("")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hpath(""))]
        marked = [int(n[len("current-") :]) for n in names if n.startswith("current-")]
        if not marked and any(n.startswith("v") for n in names):
            raise RuntimeError(f"{self.path} has versions but no pointer")
        return max(marked, default=0)

    def read(self) -> DataFrame:
        v = self.version()
        if not v:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}")

    def write(self, df: DataFrame) -> int:
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{v}")  # a half-written version of a dead run is replaced
        self._fs.create(self._hpath(f"current-{v}"), False).close()  # fails if another writer was faster
        if v > 2:
            self._fs.delete(self._hpath(f"v{v - 2}"), True)
            self._fs.delete(self._hpath(f"current-{v - 2}"), False)
        return v


def append_history(df: DataFrame, path: str, day: str) -> None:
    """Append rows to a history partitioned by day; a run repeated for a day adds to it."""
    df.write.mode("append").partitionBy(day).parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, name_pattern: str) -> DataFrame:
    """JSON lines with ``run_date`` taken from the file name; corrupt lines are dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("run_date", F.to_date(F.regexp_extract(F.col("_metadata.file_name"), name_pattern, 1)))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def cache_rows(pages: DataFrame, request: str, canonical: str, key_of) -> DataFrame:
    """Each page under the keys of its requested and its canonical URL."""
    urls = F.array_distinct(F.filter(F.array(F.col(request), F.col(canonical)), lambda u: u.isNotNull() & (u != "")))
    return pages.withColumn("tw_url", F.explode(urls)).withColumn("cache_key", key_of(F.col("tw_url"))).drop("tw_url")


def cached(requests: DataFrame, cache: DataFrame, now, hours: int = 168) -> DataFrame:
    """``requests`` with ``cache_status``: fresh, stale or miss, by age; both have ``cache_key``, the cache ``cached_at``."""
    newest = cache.groupBy(F.col("cache_key").alias("tw_key")).agg(F.max("cached_at").alias("cached_at"))
    found = requests.join(newest, F.col("cache_key") == F.col("tw_key"), "left").drop("tw_key")
    limit = now - F.expr(f"INTERVAL {hours} HOURS")
    return found.withColumn("cache_status", F.when(F.col("cached_at").isNull(), "miss").when(F.col("cached_at") >= limit, "fresh").otherwise("stale"))
