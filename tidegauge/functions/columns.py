"""Column expressions shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.config import DriftLimits

# Texts that count as numbers (signs, decimals, exponents, infinities and not-a-number).
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"

HASH_DIGITS = 13
HASH_RANGE = float(16**HASH_DIGITS)


def quoted(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col(sql_name(name))


def is_numeric(data_type: T.DataType) -> bool:
    """Numbers and booleans take part in numeric operators."""
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def to_number(column: Column, data_type: T.DataType) -> Column:
    """Number or NULL. Text must be a plain number: Java suffixes such as ``1d`` do not count."""
    if is_numeric(data_type):
        return column.cast("double")
    if isinstance(data_type, T.StringType):
        return F.when(column.rlike(NUMBER_TEXT), column.try_cast("double"))
    return F.lit(None).cast("double")


def present(column: Column, data_type: T.DataType) -> Column:
    """The value, with NaN turned into NULL."""
    return F.nanvl(column, F.lit(None)) if isinstance(data_type, (T.DoubleType, T.FloatType)) else column


def is_missing(column: Column, data_type: T.DataType) -> Column:
    """NULL and NaN count as missing."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def measurable(column: Column) -> Column:
    """Finite value as double, else NULL. NaN sorts above all numbers."""
    value = column.cast("double")
    return F.when((value > F.lit(-math.inf)) & (value < F.lit(math.inf)), value)


def key_hash(key: Column, seed: int) -> Column:
    """Repeatable 52-bit hash of a row key as an exact double; other engines can compute it as well."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint").cast("double")


def unit_hash(key: Column, seed: int) -> Column:
    """``key_hash`` scaled to [0, 1)."""
    return key_hash(key, seed) / F.lit(HASH_RANGE)


def cell_index(name: str, cuts: Sequence[float], missing: int = -1, keep_infinite: bool = False) -> Column:
    """Index of the right-closed cell ``(cut, next cut]`` a column's value falls into; ``missing`` if not countable."""
    value = f"CAST({sql_name(name)} AS DOUBLE)"
    below = f"NOT isnan({value})" if keep_infinite else f"{value} < {sql_double(math.inf)}"
    cell = bisected([f"{value} <= {sql_double(cut)}" for cut in cuts], [str(k) for k in range(len(cuts) + 1)])
    return F.expr(f"IF({value} > {sql_double(-math.inf)} AND {below}, {cell}, {missing})")


def bisected(tests: Sequence[str], results: Sequence[str]) -> str:
    """SQL for the result before the first true test, or the last one.

    Tests must turn from false to true once; they are bisected, so a value meets a logarithmic number of them. Written
    as text because building hundreds of nested column objects takes longer than running them on a small table.
    """
    if not tests:
        return results[0]
    middle = len(tests) // 2
    before = bisected(tests[:middle], results[: middle + 1])
    after = bisected(tests[middle + 1 :], results[middle + 1 :])
    return f"IF({tests[middle]}, {before}, {after})"


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_double(value: float) -> str:
    """Literal with exactly this value."""
    if math.isinf(value):
        return "DOUBLE('Infinity')" if value > 0 else "DOUBLE('-Infinity')"
    return f"{float(value)!r}D"


def drift_status(psi: Column, limits: DriftLimits) -> Column:
    return (
        F.when(psi > limits.high, "severe_drift").when(psi > limits.low, "moderate_drift").otherwise("no_drift")
    )


def drift_level(psi: Column, limits: DriftLimits) -> Column:
    """Level of the worst feature."""
    return F.when(psi > limits.high, "high").when(psi > limits.low, "medium").otherwise("low")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def total(columns: Iterable[Column]) -> Column:
    return reduce(lambda left, right: left + right, columns)


def without_record_ids(df: DataFrame, name: str = "_id") -> DataFrame:
    """Drop the store's record id at every nesting level."""
    return df.select(*[_strip(quoted(f.name), f.dataType, name).alias(f.name) for f in df.schema if f.name != name])


def _strip(column: Column, data_type: T.DataType, name: str) -> Column:
    if not _mentions(data_type, name):
        return column
    if isinstance(data_type, T.StructType):
        kept = [
            _strip(column.getField(f.name), f.dataType, name).alias(f.name) for f in data_type.fields if f.name != name
        ]
        return F.when(column.isNotNull(), F.struct(*kept))
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda item: _strip(item, data_type.elementType, name))
    kept = column
    if isinstance(data_type.keyType, T.StringType):
        kept = F.map_filter(kept, lambda key, _item: key != F.lit(name))
    if not _mentions(data_type.valueType, name):
        return kept
    return F.transform_values(kept, lambda _key, item: _strip(item, data_type.valueType, name))


def _mentions(data_type: T.DataType, name: str) -> bool:
    if isinstance(data_type, T.StructType):
        return any(f.name == name or _mentions(f.dataType, name) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return _mentions(data_type.elementType, name)
    if isinstance(data_type, T.MapType):
        return isinstance(data_type.keyType, T.StringType) or _mentions(data_type.valueType, name)
    return False
