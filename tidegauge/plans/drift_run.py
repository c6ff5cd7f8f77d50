"""One drift run: report, alerts, summary, health and risk index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.config import CONFIDENCE_ROWS, RAW_LIMITS, DriftLimits
from tidegauge.operators.alerts import create_alerts
from tidegauge.operators.drift import BaselineProfile, drift_report, drift_snapshot
from tidegauge.operators.policy import combined_risk, drift_facts, health_verdict, policy_alerts, risk_band
from tidegauge.operators.sampling import fixed_sample
from tidegauge.operators.versioning import RunVersion
from tidegauge.sources.history import HistoryStore


@dataclass(frozen=True)
class DriftRun:
    """Lazy tables of a run. All are derived from ``report``, which holds one row per feature."""

    report: DataFrame
    alerts: DataFrame
    snapshot: DataFrame
    outcome: DataFrame

    def record(self, store: HistoryStore) -> None:
        """Appends snapshot, health and alerts to the history."""
        store.append("drift", self.snapshot)
        store.append("performance", self.outcome)
        store.append("alerts", self.alerts)


def mean_confidence(scored: DataFrame, key: str, rows: int = CONFIDENCE_ROWS) -> Column:
    """Mean confidence of a fixed keyed sample, as a scalar subquery."""
    return fixed_sample(scored, rows, key).agg(F.avg("confidence")).scalar()


def run_drift(
    current: DataFrame,
    profile: BaselineProfile,
    dataset: str,
    version: RunVersion,
    confidence: Column,
    at: Column | None = None,
    limits: DriftLimits = RAW_LIMITS,
    keep_report: bool = True,
) -> DriftRun:
    """Summary first, then health and index, so that both see the drift level.

    The current table is scanned once: the report is a few rows and is kept for the tables derived from it.
    """
    at = F.current_timestamp() if at is None else at
    report = drift_report(current, profile, limits)
    if keep_report:
        report = report.persist()
    payload = policy_alerts(report, dataset, version.model_version, at, limits)
    facts = drift_facts(report, limits).withColumn("verdict", health_verdict(F.col("drift_level"), F.col("severe_ratio")))
    outcome = facts.withColumn("confidence", confidence).select(
        at.alias("timestamp"),
        F.lit(dataset).alias("dataset"),
        F.lit(version.model_version).alias("model"),
        "drift_level",
        "severe_count",
        "moderate_count",
        "total_features",
        "severe_ratio",
        "moderate_ratio",
        "max_psi",
        "alert_count",
        "retrain_required",
        "verdict.*",
        combined_risk(F.col("drift_level"), F.col("confidence"), F.col("severe_ratio")).alias("alert_index"),
    )
    outcome = outcome.withColumn("risk_band", risk_band(F.col("alert_index")))
    return DriftRun(
        report, create_alerts(payload, version.run_id, at), drift_snapshot(report, dataset, at, limits), outcome
    )
