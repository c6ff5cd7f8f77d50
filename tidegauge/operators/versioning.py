"""Version stamp of a run."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import small_table


@dataclass(frozen=True)
class RunVersion:
    """Model and dataset version with a run id and time."""

    model_version: str
    dataset_version: str
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    timestamp: str = field(default_factory=lambda: datetime.now(timezone.utc).replace(tzinfo=None).isoformat())

    def as_row(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, [vars(self)], pa.schema([(name, pa.string()) for name in vars(self)]))

    def stamp(self, df: DataFrame, column: str | None = None) -> DataFrame:
        """Adds the version as columns, or as one struct column."""
        literals = {name: F.lit(value) for name, value in vars(self).items()}
        if column is None:
            return df.withColumns(literals)
        return df.withColumn(column, F.struct(*[c.alias(n) for n, c in literals.items()]))
