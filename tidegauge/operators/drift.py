"""Feature drift by the population stability index (PSI) against a frozen baseline profile."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import PSI_BINS, PSI_EPSILON, RAW_LIMITS, SEED, DriftLimits
from tidegauge.errors import EmptyReportError
from tidegauge.functions.columns import (
    cell_index,
    drift_level,
    drift_status,
    is_numeric,
    measurable,
    numeric_columns,
    quoted,
)
from tidegauge.operators.ranks import exact_quantiles, long_rows
from tidegauge.session import small_table

NO_BIN = -1

PROFILE_SCHEMA = pa.schema(
    [
        ("position", pa.int32()),
        ("feature", pa.string()),
        ("numeric", pa.bool_()),
        ("baseline_rows", pa.int64()),
        ("edges", pa.list_(pa.float64())),
        ("bin_rows", pa.list_(pa.int64())),
    ]
)


@dataclass(frozen=True)
class FeatureBaseline:
    """Inner bin edges of a feature and the baseline rows per bin; no edges means the feature is never scored."""

    feature: str
    numeric: bool
    edges: tuple[float, ...] = ()
    bin_rows: tuple[int, ...] = ()


@dataclass(frozen=True)
class BaselineProfile:
    """Frozen baseline: a few numbers per feature, however large the table was."""

    rows: int
    features: tuple[FeatureBaseline, ...]
    keep_infinite: bool = False

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            {
                "position": i,
                "feature": f.feature,
                "numeric": f.numeric,
                "baseline_rows": self.rows,
                "edges": list(f.edges),
                "bin_rows": list(f.bin_rows),
            }
            for i, f in enumerate(self.features)
        ]
        return small_table(spark, rows, PROFILE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_df(spark).withColumn("keep_infinite", F.lit(self.keep_infinite)).coalesce(1).write.mode(
            "overwrite"
        ).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BaselineProfile:
        rows = spark.read.parquet(path).orderBy("position").collect()
        features = tuple(
            FeatureBaseline(r["feature"], r["numeric"], tuple(r["edges"]), tuple(r["bin_rows"])) for r in rows
        )
        return BaselineProfile(rows[0]["baseline_rows"], features, rows[0]["keep_infinite"])


def fit_profile(
    baseline: DataFrame, features: Sequence[str] | None = None, bins: int = PSI_BINS, keep_infinite: bool = False
) -> BaselineProfile:
    """Quantile bin edges and bin frequencies of every numeric feature.

    Edges are linear-interpolated percentiles of the baseline without repeats; the outermost bins are open. Constant
    and non-numeric features, and those with fewer than two bins, get no edges. Infinite values do not shape the
    edges; with ``keep_infinite`` +inf counts in the last bin.
    """
    names = list(features or baseline.columns)
    types = {f.name: f.dataType for f in baseline.schema.fields}
    numeric = [n for n in names if is_numeric(types[n])]
    shares = [float(s) for s in np.linspace(0, 100, bins + 1)[1:-1] / 100]
    infinite = {n: F.count_if(quoted(n).cast("double") == F.lit(float("inf"))).alias(n) for n in numeric if keep_infinite}
    counted = baseline.agg(F.count("*").alias("baseline_rows"), *infinite.values()).first()
    rows = counted["baseline_rows"]
    found = exact_quantiles(baseline, {n: measurable(quoted(n)) for n in numeric}, shares, rows)
    profiled = []
    for name in names:
        if name not in found:
            profiled.append(FeatureBaseline(name, False))
            continue
        count, quantiles = found[name]
        through = {q.value: q.through for q in quantiles if q.below > 0 and q.through < count}
        edges = tuple(sorted(through))
        marks = [0, *[through[e] for e in edges], count + (counted[name] if keep_infinite else 0)]
        bin_rows = tuple(b - a for a, b in zip(marks, marks[1:])) if edges else ()
        profiled.append(FeatureBaseline(name, True, edges, bin_rows))
    return BaselineProfile(rows, tuple(profiled), keep_infinite)


def bin_counts(df: DataFrame, profile: BaselineProfile, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (by, feature position, bin) in one scan; missing values and unscored features are in bin -1.

    The bin is found by comparisons with literals, and a task sends one row per group, feature and bin, so the shuffle
    does not grow with the table. Works on streams as well.
    """
    cells = []
    for baseline in profile.features:
        if baseline.edges:
            cells.append(cell_index(baseline.feature, baseline.edges, NO_BIN, profile.keep_infinite))
        else:
            cells.append(F.lit(NO_BIN))
    names = [f"bin_{i}" for i in range(len(cells))]
    prepared = df.select(*by, *[cell.alias(name) for cell, name in zip(cells, names)])
    return (
        long_rows(prepared, list(by), names, "bin")
        .groupBy(*by, F.col("number").cast("int").alias("position"), "bin")
        .agg(F.count("*").alias("n"))
    )


def histograms(counts: DataFrame, profile: BaselineProfile, by: Sequence[str] = ()) -> DataFrame:
    """(by, position, histogram, binned_rows, current_rows): the bins of a feature as an array.

    Works on the few counted rows.
    """
    width = max([1, *[len(f.bin_rows) for f in profile.features]])
    folded = counts.groupBy(*by, "position").agg(
        F.expr("sum(n) AS current_rows"),
        F.expr("sum(IF(bin >= 0, n, 0L)) AS binned_rows"),
        *[F.expr(f"sum(IF(bin = {b}, n, 0L)) AS n{b}") for b in range(width)],
    )
    bins = F.expr(f"array({', '.join(f'n{b}' for b in range(width))}) AS histogram")
    return folded.select(*by, "position", bins, "binned_rows", "current_rows")


def bin_frequencies(counts: DataFrame, profile: BaselineProfile) -> DataFrame:
    """(feature, bin, expected_rows, actual_rows) of every bin of every scored feature."""
    grid = profile.to_df(counts.sparkSession).join(F.broadcast(histograms(counts, profile)), "position", "left")
    expected = grid.select("feature", "histogram", F.posexplode("bin_rows").alias("bin", "expected_rows"))
    actual = F.coalesce(F.get("histogram", F.col("bin")), F.lit(0).cast("bigint"))
    return expected.select("feature", "bin", "expected_rows", actual.alias("actual_rows"))


# Sum over the bins of (actual - expected) * ln((actual + eps) / (expected + eps)), with shares of the binned rows.
PSI = f"""
aggregate(
  zip_with(
    slice(histogram, 1, size(bin_rows)), bin_rows,
    (n, b) -> (n / binned_rows - b / baseline_binned)
      * ln((n / binned_rows + {PSI_EPSILON!r}D) / (b / baseline_binned + {PSI_EPSILON!r}D))
  ),
  0D, (total, term) -> total + term
)"""


def psi_from_counts(counts: DataFrame, profile: BaselineProfile, by: Sequence[str] = ()) -> DataFrame:
    """(by, position, feature, psi_raw, baseline_rows, current_rows) from ``bin_counts``.

    A feature without bins or without current rows scores 0. Without ``by`` every profiled feature is listed, also for
    an empty table. Either broadcast side holds one row per feature.
    """
    total = F.expr("aggregate(bin_rows, 0L, (total, n) -> total + n) AS baseline_binned")
    grid = profile.to_df(counts.sparkSession).select("position", "feature", "bin_rows", "baseline_rows", total)
    folded = histograms(counts, profile, by)
    if by:
        joined = folded.join(F.broadcast(grid), "position")
    else:
        joined = grid.join(F.broadcast(folded), "position", "left")
    return joined.select(
        *by,
        "position",
        "feature",
        F.expr(f"IF(size(bin_rows) > 0 AND binned_rows > 0, {PSI}, 0D) AS psi_raw"),
        "baseline_rows",
        F.expr("coalesce(current_rows, 0L) AS current_rows"),
    )


def drift_report(
    current: DataFrame, profile: BaselineProfile, limits: DriftLimits = RAW_LIMITS, by: Sequence[str] = ()
) -> DataFrame:
    """One row per feature, worst first: psi (4 digits), psi_raw, status (by psi_raw) and the row counts."""
    return report_from_psi(psi_from_counts(bin_counts(current, profile, by), profile, by), limits, by)


def report_from_psi(psi: DataFrame, limits: DriftLimits = RAW_LIMITS, by: Sequence[str] = ()) -> DataFrame:
    return psi.select(
        *by,
        "feature",
        F.round("psi_raw", 4).alias("psi"),
        drift_status(F.col("psi_raw"), limits).alias("status"),
        "baseline_rows",
        "current_rows",
        "psi_raw",
        "position",
    ).orderBy(*by, F.desc("psi"), "feature")


def feature_drift(
    baseline: DataFrame,
    current: DataFrame,
    features: Sequence[str] | None = None,
    simulate: bool = False,
    limits: DriftLimits = RAW_LIMITS,
) -> DataFrame:
    """Profile a baseline and report the drift of a current table against it."""
    profile = fit_profile(baseline, features)
    names = [f.feature for f in profile.features]
    return drift_report(perturb(current, names) if simulate else current, profile, limits)


def perturb(df: DataFrame, features: Sequence[str] | None = None, factor: float = 1.4, cols: int = 3) -> DataFrame:
    """What-if drift: scale the first ``cols`` features."""
    chosen = list(features or df.columns)[:cols]
    return df.withColumns({name: quoted(name) * F.lit(factor) for name in chosen})


def perturb_numeric(df: DataFrame, cols: int = 5, low: float = 2.5, high: float = 4.0, seed: int = SEED) -> DataFrame:
    """What-if drift: scale the first numeric columns, each by a seeded factor between ``low`` and ``high``."""
    factors = np.random.default_rng(seed).uniform(low, high, cols)
    return df.withColumns({n: quoted(n) * F.lit(float(f)) for n, f in zip(numeric_columns(df)[:cols], factors)})


def drift_snapshot(report: DataFrame, dataset: str, at: Column | None = None, limits: DriftLimits = RAW_LIMITS) -> DataFrame:
    """One record per run: worst psi, level of the worst feature, severe features in column order."""
    severe = F.collect_list(F.when(F.col("status") == "severe_drift", F.struct("position", "feature")))
    return report.agg(F.max("psi").alias("psi"), F.array_sort(severe).alias("severe")).select(
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        F.lit(dataset).alias("dataset"),
        "psi",
        drift_level(F.col("psi"), limits).alias("drift_level"),
        F.col("severe.feature").alias("features"),
    )


def status_rows(report: DataFrame, status: str) -> DataFrame:
    return report.where(F.col("status") == status)


def require_rows(report: DataFrame) -> DataFrame:
    """The report, or an error when it is empty."""
    if report.isEmpty():
        raise EmptyReportError("the drift report has no features")
    return report
