"""Drift of each event-time window against a frozen baseline.

State holds bin counts only (windows x features x bins). PSI is not additive, so it is taken from the counts of closed
windows. Rows later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.config import RAW_LIMITS, DriftLimits
from tidegauge.functions.columns import quoted
from tidegauge.operators.drift import BaselineProfile, bin_counts, psi_from_counts, report_from_psi

WINDOW = ["window"]


def with_window(df: DataFrame, time: str, width: str) -> DataFrame:
    """Adds the tumbling window of the event time, which must be a timestamp with time zone semantics."""
    return df.withColumn("window", F.window(quoted(time), width))


def window_counts(stream: DataFrame, profile: BaselineProfile, time: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(window, position, bin, n) of a stream or a table; NTZ event times are read as UTC."""
    timed = stream.withColumn(time, quoted(time).cast("timestamp")).withWatermark(time, delay)
    return bin_counts(with_window(timed, time, width), profile, WINDOW)


def window_report(counts: DataFrame, profile: BaselineProfile, limits: DriftLimits = RAW_LIMITS) -> DataFrame:
    """Drift report per window."""
    return report_from_psi(psi_from_counts(counts, profile, WINDOW), limits, WINDOW)


def window_snapshots(report: DataFrame, dataset: str, limits: DriftLimits = RAW_LIMITS) -> DataFrame:
    """One snapshot per window: worst psi, its level, severe features in column order."""
    psi = F.max("psi")
    level = F.when(psi > limits.high, "high").when(psi > limits.low, "medium").otherwise("low")
    severe: Column = F.collect_list(F.when(F.col("status") == "severe_drift", F.struct("position", "feature")))
    return (
        report.groupBy("window")
        .agg(psi.alias("psi"), level.alias("drift_level"), F.array_sort(severe).alias("severe"))
        .select(
            F.col("window.end").alias("timestamp"),
            F.lit(dataset).alias("dataset"),
            "psi",
            "drift_level",
            F.col("severe.feature").alias("features"),
        )
    )


def stream_window_drift(
    stream: DataFrame,
    profile: BaselineProfile,
    dataset: str,
    target: str,
    checkpoint: str,
    time: str,
    width: str = "1 day",
    delay: str = "1 hour",
) -> StreamingQuery:
    """Writes one snapshot per closed window; each batch replaces its own ``batch`` partition."""

    def handle(closed: DataFrame, number: int) -> None:
        snapshots = window_snapshots(window_report(closed, profile), dataset)
        snapshots.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        window_counts(stream, profile, time, width, delay)
        .writeStream.outputMode("append")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
