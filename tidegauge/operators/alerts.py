"""Alerts as append-only state events; the current alert is the newest event per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.errors import UnknownAlertError

OPEN = "open"


def create_alerts(payload: DataFrame, run_id: str, at: Column | None = None) -> DataFrame:
    """Opens one alert per payload row; the id is repeatable for a run, dataset and feature."""
    now = F.current_timestamp() if at is None else at
    identity = F.sha2(F.concat_ws("|", F.lit(run_id), "dataset", "feature"), 256)
    return payload.select(
        identity.alias("alert_id"),
        F.lit(OPEN).alias("state"),
        now.alias("created_at"),
        now.alias("updated_at"),
        *payload.columns,
    )


def state_changes(alerts: DataFrame, changes: DataFrame, check: bool = True) -> DataFrame:
    """Events (alert_id, state, updated_at) for changes of existing alerts; unknown ids are an error when checked."""
    known = alerts.select("alert_id").distinct()
    if check:
        unknown = changes.select("alert_id").join(known, "alert_id", "left_anti").limit(1).collect()
        if unknown:
            raise UnknownAlertError(f"no alert has the id {unknown[0][0]}")
    return changes.join(known, "alert_id", "left_semi").select("alert_id", "state", "updated_at")


def unknown_alerts(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes whose alert does not exist."""
    return changes.join(alerts.select("alert_id").distinct(), "alert_id", "left_anti")


def latest_states(events: DataFrame, key: str = "alert_id", order: str = "updated_at") -> DataFrame:
    """The newest event per id; of equally new ones the largest in the other columns, NULL being smallest.

    Each task sends one row per id it saw, so busy ids do not pile up.
    """
    columns = [c for c in events.columns if c != key]
    newest = F.max(F.struct(order, *[c for c in columns if c != order])).alias("newest")
    return events.groupBy(key).agg(newest).select(key, *[F.col("newest")[c].alias(c) for c in columns])


def alerts_in_state(current: DataFrame, state: str | None = None) -> DataFrame:
    return current if state is None else current.where(F.col("state") == state)
