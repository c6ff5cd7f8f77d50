"""Contract mapping, schema enforcement and projections. All lazy, without a shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.contract import CATEGORY, Contract, UniversalSchema
from tidegauge.errors import ContractError, SchemaError
from tidegauge.functions.columns import is_numeric, quoted, to_number
from tidegauge.operators.ranks import order_statistics

LABEL = "label"
UNKNOWN = "unknown"
EXACT_DOUBLE = 2**53


def binary_label(label: Column, contract: Contract) -> Column:
    """0 for the benign raw label, 1 for everything else, including NULL and unmapped labels."""
    return F.when(label.cast("string") == contract.benign_label, 0).otherwise(1)


def map_columns(df: DataFrame, contract: Contract) -> DataFrame:
    """Rename the label and aliased columns, and make the label binary when the contract maps it.

    Aliases are looked up among the raw columns. Two columns ending up under one name is an error.
    """
    raw = set(df.columns)
    if contract.label_column not in raw:
        raise ContractError(f"the table has no column '{contract.label_column}', which the contract names as label")
    label = quoted(contract.label_column)
    if contract.label_mapping:
        label = binary_label(label, contract)
    columns = []
    for name in df.columns:
        if name == contract.label_column:
            columns.append((contract.column_aliases.get(LABEL, LABEL) if LABEL in raw else LABEL, label))
        else:
            columns.append((contract.column_aliases.get(name, name), quoted(name)))
    repeated = [name for name, n in Counter(name for name, _ in columns).items() if n > 1]
    if repeated:
        raise ContractError(f"several columns map to the same name: {sorted(repeated)}")
    return df.select(*[column.alias(name) for name, column in columns])


def enforce_schema(df: DataFrame, schema: UniversalSchema) -> DataFrame:
    """Features and label in schema order. Absent features are filled; unreadable numbers become NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if schema.label not in types:
        raise SchemaError(f"the schema's label '{schema.label}' is no column of the table")
    columns = []
    for name, kind in schema.features.items():
        if name not in types:
            column = F.lit(UNKNOWN) if kind == CATEGORY else F.lit(0.0)
        elif kind == CATEGORY:
            column = quoted(name)
        else:
            column = to_number(quoted(name), types[name])
        columns.append(column.alias(name, metadata={"logical_type": kind}))
    label = to_number(quoted(schema.label), types[schema.label])
    return df.select(*columns, label.alias(schema.label, metadata={"logical_type": "binary"}))


def validate_schema(df: DataFrame, schema: UniversalSchema, require_label: bool = False) -> DataFrame:
    """Strict projection: missing numbers (or a required label) are an error, missing categories are filled."""
    missing = [n for n, kind in schema.features.items() if n not in df.columns and kind != CATEGORY]
    if missing:
        raise SchemaError(f"the table lacks features of the schema: {missing}")
    if require_label and schema.label not in df.columns:
        raise SchemaError(f"the schema's label '{schema.label}' is no column of the table")
    columns = [quoted(n) if n in df.columns else F.lit(UNKNOWN).alias(n) for n in schema.features]
    return df.select(*columns, *([quoted(schema.label)] if require_label else []))


def normalize_columns(df: DataFrame, label_column: str, label: str = "__label__") -> DataFrame:
    """Strip blanks around column names and give the label its internal name, as last column."""
    stripped = df.toDF(*[c.strip() for c in df.columns])
    if label_column.strip() not in stripped.columns:
        raise ContractError(f"the table has no column '{label_column}' to take as label")
    features = [quoted(c) for c in stripped.columns if c != label_column.strip()]
    return stripped.select(*features, quoted(label_column.strip()).alias(label))


def split_features_label(df: DataFrame, label: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, labels); the key stays on both sides, as rows have no position."""
    keys = [quoted(key)] if key else []
    return df.drop(label), df.select(*keys, quoted(label))


def align_features(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the expected features in order; extra columns are dropped, missing ones are an error."""
    missing = [n for n in expected if n not in df.columns]
    if missing:
        raise SchemaError(f"features missing at scoring time: {missing}")
    return df.select(*[quoted(k) for k in keep if k not in expected], *map(quoted, expected))


def cast_all_string(df: DataFrame) -> DataFrame:
    """Every column as text; missing values stay NULL."""
    return df.select(*[quoted(c).cast("string").alias(c) for c in df.columns])


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(f.name) for f in df.schema.fields if is_numeric(f.dataType)])


def project_record(df: DataFrame, record: T.StructType) -> DataFrame:
    """The record's fields with their types, in order; a missing field is an error, extra ones are dropped."""
    missing = [f.name for f in record.fields if f.name not in df.columns]
    if missing:
        raise SchemaError(f"record fields missing: {missing}")
    return df.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in record.fields])


def row_at(df: DataFrame, key: str, position: int) -> DataFrame:
    """The row at a position (from 0) in the order of a unique numeric key; the table is not sorted for it."""
    found = order_statistics(df, {key: quoted(key)}, lambda _name, count: [position] if position < count else [])
    value = found[key].values.get(position)
    if value is None:
        return df.where(F.lit(False))
    if abs(value) < EXACT_DOUBLE:
        return df.where(quoted(key) == F.lit(value))
    same = df.where(quoted(key).cast("double") == F.lit(value))  # larger keys share a double with their neighbours
    return same.orderBy(quoted(key)).offset(position - found[key].below[position]).limit(1)


def row_by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Rows with a key value; the filter reaches the scan."""
    return df.where(quoted(key) == F.lit(value))
