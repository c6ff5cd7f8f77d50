"""Alert state kept up to date from a stream of state events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidegauge.operators.alerts import latest_states
from tidegauge.session import move_folder, remove_folder


def stream_alert_state(events: DataFrame, target: str, checkpoint: str, key: str = "alert_id", order: str = "updated_at") -> StreamingQuery:
    """Appends the newest state of every alert in a batch to ``target``; ``current_states`` of that table is the current state.

    The stream itself keeps nothing: the state is the table, which ``compact_states`` brings back to one row per alert.
    """

    def handle(batch: DataFrame, number: int) -> None:
        latest_states(batch, key, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        events.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_states(spark: SparkSession, target: str, key: str = "alert_id", order: str = "updated_at") -> DataFrame:
    return latest_states(spark.read.parquet(target).drop("batch"), key, order)


def compact_states(spark: SparkSession, target: str, key: str = "alert_id", order: str = "updated_at") -> int:
    """Gather all batches into one with a row per alert; returns how many were gathered. Run it while no batch is written.

    Compacted batches have negative numbers. The new one is in place before any it was made of is removed, and rows met
    twice change nothing, so it can be interrupted at any point and run again.
    """
    table = spark.read.parquet(target)
    gathered = sorted(r[0] for r in table.select("batch").distinct().collect())
    if not gathered or (len(gathered) == 1 and gathered[0] < 0):
        return 0
    number = min(gathered[0], 0) - 1
    staging = f"{target.rstrip('/')}-compacting"
    latest_states(table.drop("batch"), key, order).write.mode("overwrite").parquet(staging)
    move_folder(spark, staging, f"{target}/batch={number}")
    for old in gathered:
        remove_folder(spark, f"{target}/batch={old}")
    return len(gathered)
