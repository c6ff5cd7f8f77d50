"""End-to-end local explanation of a table: score, attribute, explain, add versions and drift context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import quoted
from tidegauge.operators.attribution import attribution
from tidegauge.operators.explanation import alert_id, local_explanations, with_drift_context
from tidegauge.operators.mapping import align_features, row_at
from tidegauge.operators.models import LabelDictionary, score
from tidegauge.operators.versioning import RunVersion
from tidegauge.sources.sinks import log_events


def score_rows(df: DataFrame, model: Model, features: Sequence[str], key: str) -> DataFrame:
    """(key, features, prediction, confidence) of every row."""
    table = VectorAssembler(inputCols=list(features), outputCol="features").transform(align_features(df, features, [key]))
    return score(model, table, [key, *[f for f in features if f != key]], by_cell=True).drop("probability")


def explain_rows(
    df: DataFrame,
    model: Model,
    features: Sequence[str],
    key: str,
    dataset: str,
    version: RunVersion,
    drift_report: DataFrame | None = None,
    background: DataFrame | None = None,
    top_k: int = 5,
    log_path: str | None = None,
    labels: LabelDictionary | None = None,
    explained_class: str = "positive",
) -> DataFrame:
    """Explanations of all rows. Rows are not shuffled and not joined: score and attribution travel with the row.

    Impacts are those on the positive class, or, with ``explained_class="predicted"``, on the class predicted for the row.
    With ``labels`` predictions are shown by name.
    """
    if explained_class not in ("positive", "predicted"):
        raise ValueError(f"explained is the 'positive' or the 'predicted' class, not '{explained_class}'")
    scored = score_rows(df, model, features, key)
    attributed = attribution(
        scored, model, features, keep=[key, "prediction", "confidence"], background=df if background is None else background,
        target="prediction" if explained_class == "predicted" else None,
    )
    explained = local_explanations(
        attributed,
        labels.decode(F.col("prediction")) if labels else F.col("prediction"),
        F.col("confidence"),
        alert_id(dataset, quoted(key)),
        top_k,
        keep=[key],
    )
    if log_path:
        log_events(
            explained.select(F.lit(dataset).alias("dataset"), "alert_id", "prediction", "confidence"), "explanation", log_path
        )
    return with_drift_context(version.stamp(explained, "metadata"), drift_report, top_k)


def explain_test_row(parts: DataFrame, position: int, model: Model, features: Sequence[str], key: str, dataset: str, version: RunVersion, **options) -> DataFrame:
    """Explanation of one row of the test part, by its position in key order; the training part is the background."""
    row = row_at(parts.where(F.col("part") == "test").drop("part"), key, position)
    train = parts.where(F.col("part") == "train")
    return explain_rows(row, model, features, key, dataset, version, background=train, **options)
