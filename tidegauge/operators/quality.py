"""Data-quality checks: share of missing values, label domain, required columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.contract import Contract
from tidegauge.errors import QualityError
from tidegauge.functions.columns import is_missing, quoted
from tidegauge.session import small_table

LABEL = "label"
OFFENDERS_SHOWN = 20


def missing_ratio(df: DataFrame) -> DataFrame:
    """One row: (rows, missing_ratio), the mean over the columns of their share of NULL or NaN."""
    return df.agg(*_missing_aggregates(df))


def _missing_aggregates(df: DataFrame):
    cells = [F.when(is_missing(quoted(f.name), f.dataType), 1).otherwise(0) for f in df.schema.fields]
    per_row = cells[0]
    for cell in cells[1:]:
        per_row = per_row + cell
    return F.count("*").alias("rows"), F.try_divide(F.avg(per_row), F.lit(len(cells))).alias("missing_ratio")


def label_violations(df: DataFrame, contract: Contract, label: str = LABEL) -> DataFrame:
    """Labels outside the contract's domain, with their rows. Only distinct labels are compared."""
    found = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))
    rows = [{"text": None if v is None else str(v)} for v in contract.label_values]
    allowed = small_table(df.sparkSession, rows, pa.schema([("text", pa.string())]))
    typed = allowed.select("text", F.col("text").try_cast(df.schema[label].dataType).alias("allowed"))
    readable = typed.where(F.col("text").isNull() | F.col("allowed").isNotNull())
    return found.join(F.broadcast(readable), found["label"].eqNullSafe(readable["allowed"]), "left_anti")


def missing_columns(df: DataFrame, contract: Contract) -> list[str]:
    return [c for c in contract.required_columns if c not in df.columns]


def _outside(df: DataFrame, contract: Contract, label: str):
    """True for labels outside the domain, NULL included."""
    data_type = df.schema[label].dataType
    inside = F.lit(False)
    for value in contract.label_values:
        if value is None:
            inside = inside | F.col(label).isNull()
        else:
            inside = inside | F.coalesce(F.col(label) == F.lit(str(value)).try_cast(data_type), F.lit(False))
    return ~inside


def quality_report(df: DataFrame, contract: Contract, label: str = LABEL) -> DataFrame:
    """(check, value, limit, passed) for rows, missing, labels and columns, in one aggregate without a shuffle of rows.

    ``value`` counts rows, the missing ratio, rows with an invalid label, and missing columns. An empty table fails
    ``rows``; its missing ratio is unknown, which passes.
    """
    return checks(df.agg(*quality_aggregates(df, contract, label)), df, contract)


def quality_aggregates(df: DataFrame, contract: Contract, label: str = LABEL) -> list[Column]:
    """Rows, missing ratio and rows with an invalid label; also fit for ``DataFrame.observe`` while a table is written."""
    invalid = F.count_if(_outside(df, contract, label)) if label in df.columns else F.count_if(F.lit(False))
    return [*_missing_aggregates(df), invalid.alias("invalid_labels")]


def checks(facts: DataFrame, df: DataFrame, contract: Contract) -> DataFrame:
    """The report that one row of ``quality_aggregates`` of ``df`` gives."""
    absent = len(missing_columns(df, contract))
    lines = F.array(
        _check("rows", F.col("rows"), 1.0, F.col("rows") >= 1),
        _check(
            "missing",
            F.col("missing_ratio"),
            contract.max_missing_pct,
            ~F.coalesce(F.col("missing_ratio") > contract.max_missing_pct, F.lit(False)),
        ),
        _check("labels", F.col("invalid_labels"), 0.0, F.col("invalid_labels") == 0),
        _check("columns", F.lit(absent), 0.0, F.lit(absent == 0)),
    )
    return facts.select(F.inline(lines))


def _check(name, value, limit, passed):
    return F.struct(
        F.lit(name).alias("check"),
        value.cast("double").alias("value"),
        F.lit(float(limit)).alias("limit"),
        passed.alias("passed"),
    )


def validate(df: DataFrame, contract: Contract, label: str = LABEL, allow_empty: bool = True) -> DataFrame:
    """The table itself when it passes, else an error naming the first failed check (missing, labels, columns)."""
    reasons = failures(df, contract, label, allow_empty)
    if reasons:
        raise QualityError(reasons[0])
    return df


def failures(df: DataFrame, contract: Contract, label: str = LABEL, allow_empty: bool = True) -> list[str]:
    """Reasons why a table fails, in the order missing, labels, columns, rows."""
    return reasons_of(quality_report(df, contract, label), df, contract, label, allow_empty)


def reasons_of(report: DataFrame, df: DataFrame, contract: Contract, label: str = LABEL, allow_empty: bool = True) -> list[str]:
    """Reasons of a known report; the table is read again only to show invalid labels."""
    lines = {r["check"]: r for r in report.collect()}
    reasons = []
    if not lines["missing"]["passed"]:
        reasons.append(f"share of missing values is {lines['missing']['value']:.2f}, above the contract's limit")
    if not lines["labels"]["passed"]:
        found = label_violations(df, contract, label)
        shown = [r["label"] for r in found.orderBy(F.desc("rows"), "label").limit(OFFENDERS_SHOWN).collect()]
        more = found.count() - len(shown)
        reasons.append(f"invalid labels, outside the contract's domain: {shown}" + (f" and {more} more, see label_violations" if more > 0 else ""))
    if not lines["columns"]["passed"]:
        reasons.append(f"the contract needs columns that the table lacks: {missing_columns(df, contract)}")
    if not lines["rows"]["passed"] and not allow_empty:
        reasons.append("the table is empty")
    return reasons
