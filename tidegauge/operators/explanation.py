"""Explanations from attributions: top contributors, summaries, drift context, global importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import quoted

# Texts of the explanations.
RAISED = "High influence from "
RAISED_END = " increased attack likelihood"
LOWERED = "Features like "
LOWERED_END = " reduced risk score"
INTERPRETATION = (
    "Model decisions are primarily influenced by traffic volume, connection behavior, "
    "and destination activity features such as "
)
NO_CONTEXT = "No drift context available"
DRIFTING = "Some influential features are drifting"
STABLE = "Top features are stable"

CONTEXT_TYPE = (
    "struct<drifting_features:array<struct<feature:string,impact:double,drift_status:string>>,"
    "stable_features:array<string>,note:string>"
)


def strongest(impacts: Column, top_k: int = 5) -> Column:
    """The top_k entries by absolute impact; equal ones stay in feature order."""
    ranked = F.transform(
        impacts,
        lambda item, place: F.struct(
            (-F.abs(item["impact"])).alias("order"), place, item["feature"].alias("feature"), item["impact"].alias("impact")
        ),
    )
    return F.transform(
        F.slice(F.sort_array(ranked), 1, top_k),
        lambda item: F.struct(item["feature"].alias("feature"), item["impact"].alias("impact")),
    )


def contributors(top: Column) -> Column:
    """Array of (feature, impact rounded to 6 digits, direction); only positive impacts increase risk."""
    return F.transform(
        top,
        lambda item: F.struct(
            item["feature"].alias("feature"),
            F.round(item["impact"], 6).alias("impact"),
            F.when(item["impact"] > 0, "increase_risk").otherwise("decrease_risk").alias("direction"),
        ),
    )


def summary_text(top: Column) -> Column:
    """Sentence naming up to two raising and two lowering features."""

    def phrase(before: str, after: str, chosen: Column) -> Column:
        names = F.array_join(F.slice(F.transform(chosen, lambda item: item["feature"]), 1, 2), ", ")
        return F.concat(F.lit(before), F.nullif(names, F.lit("")), F.lit(after))

    raised = phrase(RAISED, RAISED_END, F.filter(top, lambda item: item["impact"] > 0))
    lowered = phrase(LOWERED, LOWERED_END, F.filter(top, lambda item: item["impact"] < 0))
    return F.concat(F.concat_ws(". ", raised, lowered), F.lit("."))


def alert_id(dataset: str, key: Column) -> Column:
    return F.concat_ws("-", F.upper(F.lit(dataset)), key.cast("string"))


def local_explanations(
    attributed: DataFrame,
    prediction: Column,
    confidence: Column,
    identifier: Column | None = None,
    top_k: int = 5,
    impacts: str = "impacts",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One explanation per row of an attributed table; no shuffle."""
    top = strongest(F.col(impacts), top_k)
    ranked = attributed.select(
        *map(quoted, keep),
        (F.lit(None).cast("string") if identifier is None else identifier).alias("alert_id"),
        prediction.cast("string").alias("prediction"),
        F.round(confidence, 4).alias("confidence"),
        top.alias("_top"),
    )
    return ranked.select(
        *map(quoted, keep),
        "alert_id",
        "prediction",
        "confidence",
        contributors(F.col("_top")).alias("top_contributors"),
        summary_text(F.col("_top")).alias("summary"),
    )


def with_drift_context(explanations: DataFrame, drift_report: DataFrame | None, top_k: int = 5) -> DataFrame:
    """Splits the top contributors into drifting and stable ones.

    The report (one row per feature) is folded into a single map that every row looks up; rows are not shuffled.
    Without a report, or with an empty one, the context says so.
    """
    none = F.struct(
        F.array().alias("drifting_features"),
        F.lit(None).alias("stable_features"),
        F.lit(NO_CONTEXT).alias("note"),
    ).cast(CONTEXT_TYPE)
    if drift_report is None:
        return explanations.withColumn("drift_context", none)
    folded = drift_report.agg(F.map_from_entries(F.collect_list(F.struct("feature", "status"))).alias("statuses"))
    marked = F.transform(
        F.slice("top_contributors", 1, top_k),
        lambda item: F.struct(
            item["feature"].alias("feature"),
            item["impact"].alias("impact"),
            F.coalesce(F.element_at("statuses", item["feature"]), F.lit("no_drift")).alias("drift_status"),
        ),
    )
    drifting = F.filter("_marked", lambda item: item["drift_status"] != "no_drift")
    stable = F.transform(F.filter("_marked", lambda item: item["drift_status"] == "no_drift"), lambda item: item["feature"])
    context = F.struct(
        "drifting_features",
        stable.alias("stable_features"),
        F.when(F.size("drifting_features") > 0, DRIFTING).otherwise(STABLE).alias("note"),
    )
    return (
        explanations.withColumn("statuses", folded.scalar())
        .withColumn("_marked", marked)
        .withColumn("drifting_features", drifting)
        .withColumn("drift_context", F.when(F.size("statuses") > 0, context).otherwise(none))
        .drop("statuses", "_marked", "drifting_features")
    )


def global_importance(
    attributed: DataFrame, features: Sequence[str], top_k: int | None = 10, impacts: str = "impacts"
) -> DataFrame:
    """(feature, mean_abs_impact), strongest first; equal ones in feature order. One aggregate, no row explosion."""
    means = [F.avg(F.abs(F.col(impacts)[i]["impact"])).alias(f"m{i}") for i in range(len(features))]
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean_abs_impact"), F.lit(i).alias("position"))
            for i, f in enumerate(features)
        ]
    )
    ranked = attributed.agg(*means).select(F.inline(rows)).orderBy(F.desc("mean_abs_impact"), "position")
    return (ranked if top_k is None else ranked.limit(top_k)).select("feature", "mean_abs_impact")


def policy_report(
    attributed: DataFrame, features: Sequence[str], dataset: str, model: str, top_k: int = 10, impacts: str = "impacts"
) -> DataFrame:
    """One row: top_global_features with 6-digit impacts and an interpretation that names the first five."""
    means = [F.avg(F.abs(F.col(impacts)[i]["impact"])).alias(f"m{i}") for i in range(len(features))]
    entries = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("impact")) for i, f in enumerate(features)]
    )
    return (
        attributed.agg(*means)
        .select(strongest(entries, top_k).alias("top"))
        .select(
            F.lit(dataset).alias("dataset"),
            F.lit(model).alias("model"),
            F.transform(
                "top",
                lambda item: F.struct(
                    item["feature"].alias("feature"), F.round(item["impact"], 6).alias("mean_shap_impact")
                ),
            ).alias("top_global_features"),
            F.concat(F.lit(INTERPRETATION), F.array_join(F.slice(F.col("top.feature"), 1, 5), ", ")).alias(
                "interpretation"
            ),
        )
    )
