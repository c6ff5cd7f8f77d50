"""Append-only record tables (drift, performance, alerts) and their newest-first views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.config import HISTORY_LIMIT
from tidegauge.functions.columns import without_record_ids
from tidegauge.operators.mapping import project_record
from tidegauge.operators.sampling import newest

TEXT, NUMBER, TIME = T.StringType(), T.DoubleType(), T.TimestampType()


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DRIFT_RECORD = _record(timestamp=TIME, dataset=TEXT, psi=NUMBER, drift_level=TEXT, features=T.ArrayType(TEXT))
HEALTH_RECORD = _record(timestamp=TIME, model=TEXT, status=TEXT, action=TEXT, reason=TEXT)
ALERT_RECORD = _record(
    alert_id=TEXT,
    state=TEXT,
    created_at=TIME,
    updated_at=TIME,
    type=TEXT,
    feature=TEXT,
    psi=NUMBER,
    dataset=TEXT,
    model_version=TEXT,
    timestamp=TIME,
    message=TEXT,
)

RECORDS = {"drift": DRIFT_RECORD, "performance": HEALTH_RECORD, "alerts": ALERT_RECORD}
RETRAINING = "retrain_scheduled"


#: Columns that tell records of one time apart.
TIES = {"drift": ("dataset", "psi"), "performance": ("model", "status"), "alerts": ("alert_id", "state")}


def newest_first(records: DataFrame, ties: Sequence[str], limit: int = HISTORY_LIMIT, time: str = "timestamp") -> DataFrame:
    """The latest records without store ids, of equal times in order of ``ties``; tasks keep only their own top rows."""
    return newest(without_record_ids(records), limit, *ties, time=time)


def retraining(alerts: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The latest alerts that scheduled a retraining."""
    return newest_first(alerts.where(F.col("state") == RETRAINING), TIES["alerts"], limit, "created_at")


def envelope(rows: DataFrame) -> DataFrame:
    """One row {count, data}; only for limited rows."""
    return rows.agg(F.count("*").alias("count"), F.collect_list(F.struct(*rows.columns)).alias("data"))


@dataclass(frozen=True)
class HistoryStore:
    """Record tables below one folder."""

    spark: SparkSession
    path: str

    def append(self, kind: str, records: DataFrame) -> None:
        """Appends records with exactly the declared fields; a missing field is an error."""
        project_record(records, RECORDS[kind]).write.mode("append").parquet(f"{self.path}/{kind}")

    def read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(RECORDS[kind]).parquet(f"{self.path}/{kind}")

    def latest(self, kind: str, limit: int = HISTORY_LIMIT) -> DataFrame:
        return newest_first(self.read(kind), TIES[kind], limit, "created_at" if kind == "alerts" else "timestamp")
