"""Session, input tables and intermediate tables.

Lineage is cut only by tables written to the folder that the cluster names in
``spark.checkpoint.dir``: every executor can read it, so a lost executor costs
a task retry and nothing else.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes, as written, up to which a table may be broadcast; in memory it may take a few times as much.
BROADCAST_BYTES = 16 << 20


def build_session(app: str = "tidewatch", master: str | None = None, cpus: int = 8) -> SparkSession:
    """A session with the settings the library expects; a cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(cpus))
        builder = builder.config("spark.driver.memory", "8g")
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(context, "_tidewatch_shipped", False) or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="tidewatch-")) / "tidewatch.zip"  # on the driver only; Spark serves it to executors
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((root / "tidewatch").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    context._tidewatch_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the session's ``spark.checkpoint.dir``.  Only a local master without
    that setting (tests) gets a temporary folder of its own; a cluster without
    it is an error, because no machine-local folder could take its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _hadoop_path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a folder."""
    where, fs = _hadoop_path(spark, path)
    return fs.getContentSummary(where).getLength()


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _hadoop_path(spark, path)
    fs.delete(where, True)


_open_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside are deleted at the end, but for those given to ``keep``."""
    mine: list[str] = []
    _open_scopes.append(mine)
    try:
        yield
    finally:
        _open_scopes.remove(mine)
        for path in mine:
            remove(spark, path)
        release(spark)


def keep(df: DataFrame) -> DataFrame:
    """Take a materialised table out of the open scratch; it then belongs to the one around it."""
    path = df._tidewatch_path
    for n, scope in enumerate(_open_scopes):
        if path in scope:
            scope.remove(path)
            if n:
                _open_scopes[n - 1].append(path)
    return df


def release(spark: SparkSession) -> None:
    """Let go of shuffle files: Spark deletes them when the driver has dropped the plans that wrote them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str, parted_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table into the shared folder, parted by a column if one is given, and read it back.

    The copy is columnar, so later readers prune columns, and its size is known
    to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(parted_by) if parted_by else df.write).parquet(path)
    if _open_scopes:
        _open_scopes[-1].append(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._tidewatch_path = path
    return copy


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES, of: DataFrame | None = None) -> DataFrame:
    """Mark a table for broadcast if what is written of it has at most ``max_bytes``.

    ``df`` is a materialised table, or columns and rows of the one given as
    ``of``; anything else is materialised first.  A larger table comes back as
    it is; the join then shuffles, and adaptive execution splits its hot keys.
    """
    path = getattr(of if of is not None else df, "_tidewatch_path", None)
    if path is None:
        df = materialize(df, "side")
        path = df._tidewatch_path
    return F.broadcast(df) if written_bytes(df.sparkSession, path) <= max_bytes else df
