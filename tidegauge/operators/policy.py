"""Drift policy, model health and risk index. Works on drift reports (one row per feature)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.config import (
    CONFIDENCE_WEIGHT,
    DRIFT_WEIGHT,
    LEVEL_SCORES,
    MODERATE_SHARE_MEDIUM,
    RAW_LIMITS,
    SEVERE_SHARE_HIGH,
    SEVERE_SHARE_MEDIUM,
    DriftLimits,
)

# Alert messages.
MESSAGES = {
    "warning": "Moderate drift detected. Monitor closely.",
    "critical": "Severe drift detected. Retraining recommended.",
}

# Health verdicts as (status, action, reason).
CRITICAL = ("critical", "retrain_required", "widespread_severe_drift")
DEGRADING = ("degrading", "monitor_closely", "moderate_distribution_shift")
HEALTHY = ("healthy", "none", "within_safe_limits")


def _verdict(values: tuple[str, str, str]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(values, ("status", "action", "reason"))])


def policy_alerts(
    report: DataFrame,
    dataset: str,
    model_version: str,
    at: Column | None = None,
    limits: DriftLimits = RAW_LIMITS,
) -> DataFrame:
    """A warning or critical alert per feature whose rounded psi is above the limits."""
    kind = F.when(F.col("psi") <= limits.high, "warning").otherwise("critical")
    return report.where(F.col("psi") > limits.low).select(
        kind.alias("type"),
        "feature",
        "psi",
        F.lit(dataset).alias("dataset"),
        F.lit(model_version).alias("model_version"),
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        F.when(kind == "warning", MESSAGES["warning"]).otherwise(MESSAGES["critical"]).alias("message"),
    )


def drift_facts(report: DataFrame, limits: DriftLimits = RAW_LIMITS) -> DataFrame:
    """Everything the one-row verdicts need, in a single aggregate over the report.

    An empty report is an error when the row is evaluated.
    """
    counted = report.agg(
        F.count("*").alias("total_features"),
        F.count_if(F.col("status") == "severe_drift").alias("severe_count"),
        F.count_if(F.col("status") == "moderate_drift").alias("moderate_count"),
        F.count_if(F.col("psi") > limits.low).alias("alert_count"),
        F.coalesce(F.bool_or(F.col("psi") > limits.high), F.lit(False)).alias("retrain_required"),
        F.max("psi").alias("max_psi"),
    )
    features = F.when(F.col("total_features") > 0, F.col("total_features")).otherwise(
        F.raise_error(F.lit("the drift report has no features")).cast("bigint")
    )
    shares = counted.withColumns(
        {"severe_share": F.col("severe_count") / features, "moderate_share": F.col("moderate_count") / features}
    )
    severe, moderate = F.col("severe_share"), F.col("moderate_share")
    level = (
        F.when(severe > SEVERE_SHARE_HIGH, "high")
        .when((severe > SEVERE_SHARE_MEDIUM) | (moderate > MODERATE_SHARE_MEDIUM), "medium")
        .otherwise("low")
    )
    return shares.withColumns(
        {
            "drift_level": level,
            "severe_ratio": F.round(severe, 3),
            "moderate_ratio": F.round(moderate, 3),
        }
    )


def drift_summary(report: DataFrame, limits: DriftLimits = RAW_LIMITS) -> DataFrame:
    """Counts and shares of severe and moderate features, and the level they imply."""
    return drift_facts(report, limits).select(
        "drift_level", "severe_count", "moderate_count", "total_features", "severe_ratio", "moderate_ratio"
    )


def policy_decision(report: DataFrame, model_version: str, limits: DriftLimits = RAW_LIMITS) -> DataFrame:
    return drift_facts(report, limits).select(
        "alert_count", "retrain_required", "max_psi", F.lit(model_version).alias("model_version")
    )


def health_verdict(drift_level: Column, severe_ratio: Column) -> Column:
    """Struct (status, action, reason)."""
    return (
        F.when((drift_level == "high") | (severe_ratio > SEVERE_SHARE_HIGH), _verdict(CRITICAL))
        .when(drift_level == "medium", _verdict(DEGRADING))
        .otherwise(_verdict(HEALTHY))
    )


def model_health(
    report: DataFrame, model_version: str, at: Column | None = None, limits: DriftLimits = RAW_LIMITS
) -> DataFrame:
    """Health record of a model; level and shares are known before the verdict is taken."""
    return (
        drift_facts(report, limits)
        .withColumn("verdict", health_verdict(F.col("drift_level"), F.col("severe_ratio")))
        .select(
            (F.current_timestamp() if at is None else at).alias("timestamp"),
            F.lit(model_version).alias("model"),
            "verdict.*",
            "max_psi",
            "drift_level",
            "severe_ratio",
        )
    )


def level_score(level: Column) -> Column:
    """Score of a drift level; an unknown level is an error."""
    chain = F.when(level.isNull(), F.raise_error(F.lit("drift level is missing")).cast("double"))
    for name, score in LEVEL_SCORES.items():
        chain = chain.when(level == name, F.lit(score))
    return chain.otherwise(F.raise_error(F.concat(F.lit("unknown drift level: "), level)).cast("double"))


def alert_index(level: Column, confidence: Column) -> Column:
    return F.round(DRIFT_WEIGHT * level_score(level) + CONFIDENCE_WEIGHT * (1 - confidence), 3)


def combined_risk(level: Column, confidence: Column, severe_ratio: Column) -> Column:
    """Alert index plus the share of severe features, at most 1."""
    return F.least(alert_index(level, confidence) + F.round(severe_ratio, 3), F.lit(1.0))


def risk_band(index: Column) -> Column:
    """Gauge colour of a risk index."""
    return F.when(index < 0.3, "green").when(index < 0.6, "orange").otherwise("red")


def staleness(report: DataFrame, limits: DriftLimits = RAW_LIMITS) -> DataFrame:
    """Stale when retraining is required, else healthy without an action."""
    stale = F.col("retrain_required")
    return drift_facts(report, limits).select(
        F.when(stale, "stale").otherwise("healthy").alias("status"),
        F.when(stale, "drift_threshold_exceeded").otherwise("no_significant_drift").alias("reason"),
        F.when(stale, "schedule_retraining").alias("action"),
    )


def health_flag(status: Column) -> Column:
    """1 for healthy, else 0."""
    return F.when(status == "healthy", 1).otherwise(0)


def retraining_reason(reason: Column) -> Column:
    """Reason text; missing and empty texts get the default."""
    return F.when(F.length(reason) > 0, reason).otherwise("Retrain Scheduled")
