"""Session helpers: a builder with the settings this package relies on, and shared scratch folders."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.errors import SharedFolderError

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "tidegauge", master: str | None = None, **settings: str) -> SparkSession:
    """Session with adaptive execution, UTC and Arrow; dots in setting names are written as double underscores."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Root of intermediate tables: ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise SharedFolderError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tidegauge-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def small_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """Metadata rows as a local relation (no scan job, size known to the optimizer)."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again, so that it is computed once and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes up to which a counted table is broadcast.
BROADCAST_BYTES = 16_000_000


def broadcast_if_small(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked for broadcast when its counted rows are small; else Spark joins by shuffling."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path, as Spark's own readers and writers see them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Move a written folder to its place, over what an earlier try left there; done already if only the target is there."""
    files, old = _file_system(spark, source)
    _, new = _file_system(spark, target)
    if not files.exists(old) and files.exists(new):
        return
    files.delete(new, True)
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"could not move {source} to {target}")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder of this package."""
    files, place = _file_system(spark, path)
    files.delete(place, True)
