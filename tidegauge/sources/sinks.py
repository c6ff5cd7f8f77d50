"""Sinks: Parquet tables and parts, JSON records, event log, explanation artifacts, fitted models."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = "yyyyMMdd_HHmmss"
PART_ROWS = 100_000


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_parts(df: DataFrame, path: str, rows_per_file: int = PART_ROWS) -> None:
    """Part files of limited size, straight from the tasks; no merge of the whole table in one place."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def compact(spark: SparkSession, source: str, target: str, target_bytes: int = 256 << 20) -> int:
    """Rewrite many part files as few, without a shuffle; the number of files follows from their size. Returns it."""
    size = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        .load(source).agg(F.sum("length")).first()[0]
    )
    files = max(1, -(-(size or 0) // target_bytes))
    spark.read.parquet(source).coalesce(files).write.mode("overwrite").parquet(target)
    return files


def append_metrics(metrics: DataFrame, path: str, dataset: str, model: str, at: Column | None = None) -> None:
    """One JSON record per metrics row: dataset, model, timestamp, f1."""
    record = metrics.select(
        F.lit(dataset).alias("dataset"),
        F.lit(model).alias("model"),
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        "f1",
    )
    record.write.mode("append").json(path)


def metrics_payload(comparison: DataFrame, cross_validation: DataFrame, dataset: str) -> DataFrame:
    """(dataset, model, test_metrics{}, cv_metrics{}) from two tables with one row per model."""
    test = F.struct("accuracy", "precision", "recall", "f1").alias("test_metrics")
    folds = F.struct("accuracy_mean", "accuracy_std", "f1_mean", "f1_std").alias("cv_metrics")
    return comparison.select("model", test).join(cross_validation.select("model", folds), "model", "left").select(
        F.lit(dataset).alias("dataset"), "model", "test_metrics", "cv_metrics"
    )


def write_payload(payload: DataFrame, path: str) -> None:
    """Replaces the record of the datasets in the payload; other datasets stay."""
    payload.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").json(path)


def log_events(rows: DataFrame, event_type: str, path: str, at: Column | None = None) -> None:
    """Appends JSON lines {timestamp, event_type, payload}; the payload is the whole row."""
    rows.select(
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        F.lit(event_type).alias("event_type"),
        F.struct(*rows.columns).alias("payload"),
    ).write.mode("append").json(path)


def artifacts(explanations: DataFrame, dataset: str, scope: str, model: str, at: Column, identifier: Column | None = None) -> DataFrame:
    """Adds _meta and the artifact's name <model>_<time>[_<identifier>].json."""
    stamp = F.date_format(at, STAMP)
    meta = F.struct(
        F.lit(dataset).alias("dataset"), F.lit(model).alias("model"), F.lit(scope).alias("scope"), stamp.alias("created_at")
    )
    parts = [F.lit(model), stamp, *([] if identifier is None else [identifier.cast("string")])]
    return explanations.withColumns(
        {
            "_meta": meta,
            "artifact": F.concat(F.concat_ws("_", *parts), F.lit(".json")),
            "dataset": F.lit(dataset),
            "scope": F.lit(scope),
        }
    )


def write_artifacts(rows: DataFrame, base_path: str) -> None:
    """Below <base>/dataset=<dataset>/scope=<scope>, one JSON line per explanation."""
    rows.write.mode("append").partitionBy("dataset", "scope").json(base_path)


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """Any saved MLlib model; its class is read from the saved metadata."""
    return DefaultParamsReader.loadParamsInstance(path, spark)
