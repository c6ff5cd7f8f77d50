"""Incremental contract load: every micro-batch is mapped, enforced and validated on its own.

A batch is read once: its quality is observed while it is written to a staging folder, which then moves to its place, so
nothing is kept in memory and readers never see a batch that was not judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.contract import FLOW_SCHEMA, Contract, UniversalSchema
from tidegauge.operators.quality import checks, quality_aggregates, reasons_of
from tidegauge.plans.load import to_flows
from tidegauge.session import move_folder, remove_folder


def stream_flows(
    raw: DataFrame,
    contract: Contract,
    accepted: str,
    rejected: str,
    checkpoint: str,
    schema: UniversalSchema = FLOW_SCHEMA,
) -> StreamingQuery:
    """Writes passing batches to ``accepted`` and failing ones, with the reason, to ``rejected``.

    Each batch replaces its own ``batch`` partition, so a batch that is retried after a failure is not written twice.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark, staging = batch.sparkSession, f"{checkpoint}-staging/batch={number}"
        flows, seen = to_flows(batch, contract, schema), Observation()
        watched = flows.observe(seen, *quality_aggregates(flows, contract, schema.label))
        watched.write.mode("overwrite").parquet(staging)
        staged, metrics = spark.read.schema(flows.schema).parquet(staging), seen.get
        facts = spark.range(1).select(*[F.lit(value).alias(name) for name, value in metrics.items()])
        reasons = reasons_of(checks(facts, staged, contract), staged, contract, schema.label)
        if not reasons:
            move_folder(spark, staging, f"{accepted}/batch={number}")
            return
        staged.withColumn("reason", F.lit("; ".join(reasons))).write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        remove_folder(spark, staging)

    return (
        raw.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
