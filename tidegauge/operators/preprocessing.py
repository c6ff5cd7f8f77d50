"""Impute, one-hot encode and standardise, as a fitted model that transforms with a single projection.

Categories that are too many to be columns live in a dictionary table (value, position) and come out as a sparse vector.
Preprocessors are ML stages: a ``Pipeline`` of one and a classifier is fitted, saved and loaded as one unit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.contract import UniversalSchema
from tidegauge.errors import CategoryLimitError, InfiniteValueError, NotFittedError
from tidegauge.functions.columns import measurable, quoted
from tidegauge.operators.ranks import exact_quantiles, long_rows, numbered
from tidegauge.session import small_table, written

#: Categories that become one column each; a column with more becomes a sparse vector.
CATEGORY_LIMIT = 2_000
#: One in so many rows makes a category heavy: at most so many are broadcast, and their rows are not shuffled.
HEAVY = 1_000
#: Keys that no category has, over which rows with a heavy category are spread in the join of the others.
SPREAD = 4_096
MISSING = "missing_value"  # mode of a column without values

STATE_SCHEMA = pa.schema(
    [
        ("position", pa.int32()),
        ("feature", pa.string()),
        ("kind", pa.string()),
        ("median", pa.float64()),
        ("mean", pa.float64()),
        ("scale", pa.float64()),
        ("mode", pa.string()),
        ("categories", pa.list_(pa.string())),
    ]
)


@dataclass(frozen=True)
class NumberState:
    """Median of the present values; mean and population deviation after imputation (1 for a constant)."""

    feature: str
    median: float
    mean: float
    scale: float


@dataclass(frozen=True)
class CategoryDictionary:
    """Written table (value, n, position) of a column's categories in order, with their number and the rows counted."""

    table: DataFrame = field(compare=False)
    size: int
    rows: int

    def with_position(self, df: DataFrame, value: Column, output: str) -> DataFrame:
        """``df`` with the place of a value in the dictionary, or its size for a value it does not hold.

        Heavy categories, at most ``HEAVY``, are broadcast. The others are joined by value, for which rows with a heavy
        one get spread keys that match nothing, so that no key gathers a large share of the rows.
        """
        names = [f"{output}_{x}" for x in ("value", "key", "heavy_value", "heavy", "other_key", "other")]
        value_, key, heavy_value, heavy, other_key, other = names
        top = self.table.where(F.col("n") * HEAVY >= self.rows).select(F.col("value").alias(heavy_value), F.col("position").alias(heavy))
        rest = self.table.where(F.col("n") * HEAVY < self.rows)
        rest = rest.select(F.concat(F.lit("v"), "value").alias(other_key), F.col("position").alias(other))
        spread = F.concat(F.lit("h"), F.pmod(F.xxhash64(*[quoted(c) for c in df.columns if c != value_]), F.lit(SPREAD)).cast("string"))
        found = df.withColumn(value_, value).join(F.broadcast(top), F.col(value_) == F.col(heavy_value), "left")
        found = found.withColumn(key, F.when(F.col(heavy).isNull(), F.concat(F.lit("v"), value_)).otherwise(spread))
        found = found.join(rest, F.col(key) == F.col(other_key), "left")
        return found.withColumn(output, F.coalesce(heavy, other, F.lit(self.size)).cast("double")).drop(*names)

    def encoder(self, column: str, output: str) -> Model:
        """Positions to sparse vectors; the place after the last category is all zeros."""
        encoder = OneHotEncoder(inputCols=[column], outputCols=[output], handleInvalid="keep", dropLast=True)
        return encoder.fit(self.table.select(F.col("position").cast("double").alias(column)))


@dataclass(frozen=True)
class CategoryState:
    """Most frequent value (the smallest of equals) and all values in order, too many of them as a dictionary table."""

    feature: str
    mode: str
    categories: tuple[str, ...]
    dictionary: CategoryDictionary | None = None


def _category(column: Column) -> Column:
    return column.cast("string")


class _StateWriter(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata=self.stage.settings())
        if isinstance(self.stage, FlowPreprocessorModel):
            self.stage.write_state(self.sparkSession, path)


class _StateReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        settings = {name: metadata[name] for name in ("categories", "numbers", "keep", "vector", "infinite") if name in metadata}
        stage = self.kind.read_state(self.sparkSession, path, settings) if self.kind is FlowPreprocessorModel else self.kind(**settings)
        stage._resetUid(metadata["uid"])
        return stage


class _SavedStage(MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class FlowPreprocessor(Estimator, _SavedStage):
    """Fits imputation, encoding and scaling; use on training rows only.

    With ``vector`` the model adds that vector to the columns it is given, else it gives ``keep`` and a column per feature.
    Infinite numbers are an error, or count as missing with ``infinite="missing"``.
    """

    def __init__(self, categories: Sequence[str], numbers: Sequence[str], keep: Sequence[str] = (), vector: str | None = None, infinite: str = "error"):
        super().__init__()
        if infinite not in ("error", "missing"):
            raise ValueError(f"infinite values are an 'error' or 'missing', not '{infinite}'")
        self.categories, self.numbers, self.keep = list(categories), list(numbers), list(keep)
        self.vector, self.infinite = vector, infinite

    @staticmethod
    def for_schema(schema: UniversalSchema, keep: Sequence[str] = ()) -> FlowPreprocessor:
        return FlowPreprocessor(schema.categories, schema.numbers, keep)

    def settings(self) -> dict:
        return {name: getattr(self, name) for name in ("categories", "numbers", "keep", "vector", "infinite")}

    def _fit(self, dataset: DataFrame) -> FlowPreprocessorModel:
        categories, numbers = fit_categories(dataset, self.categories), fit_numbers(dataset, self.numbers, self.infinite)
        return FlowPreprocessorModel(categories, numbers, self.keep, self.vector, self.infinite)


def fit_categories(df: DataFrame, columns: Sequence[str]) -> list[CategoryState]:
    """Mode and values per column from one written count per (column, value); the counts are partially aggregated."""
    if not columns:
        return []
    text = df.select(*[_category(quoted(c)).alias(c) for c in columns])
    counts = long_rows(text, [], list(columns), "value").where(F.col("value").isNotNull())
    counts = written(counts.groupBy("number", "value").agg(F.count("*").alias("n")), "categories")
    first = F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"]
    facts = {r["number"]: r for r in counts.groupBy("number").agg(first.alias("mode"), F.count("*").alias("size"), F.sum("n").alias("rows")).collect()}
    narrow = [number for number, r in facts.items() if r["size"] <= CATEGORY_LIMIT]
    values = {number: [] for number in narrow}
    for r in counts.where(F.col("number").isin(narrow)).select("number", "value").collect() if narrow else []:
        values[r["number"]].append(r["value"])
    states = []
    for i, name in enumerate(columns):
        known = facts.get(str(i))
        if known is None:
            states.append(CategoryState(name, MISSING, (MISSING,)))
        elif str(i) in values:
            states.append(CategoryState(name, known["mode"], tuple(sorted(values[str(i)]))))
        else:
            table = written(numbered(counts.where(F.col("number") == str(i)).select("value", "n"), "value"), "dictionary")
            states.append(CategoryState(name, known["mode"], (), CategoryDictionary(table, known["size"], known["rows"])))
    return states


def sparse_encoder(columns: Sequence[str], suffix: str = "_encoded") -> Pipeline:
    """One-hot encoding as a sparse vector per column, for categories too many to be columns of their own.

    Values are in order; unknown and missing ones encode to all zeros, as the extra slot they share is dropped.
    """
    indexed = [f"{c}_index" for c in columns]
    indexer = StringIndexer(inputCols=list(columns), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc")
    encoder = OneHotEncoder(inputCols=indexed, outputCols=[f"{c}{suffix}" for c in columns], dropLast=True)
    return Pipeline(stages=[indexer, encoder])


def fit_numbers(df: DataFrame, columns: Sequence[str], infinite: str = "error") -> list[NumberState]:
    """Exact medians, then moments of the imputed column, derived from those of the present values."""
    if not columns:
        return []
    values = {c: measurable(quoted(c)) for c in columns}
    aggregates = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        aggregates += [f(values[c]).alias(f"{n}{i}") for n, f in _MOMENTS.items()]
        aggregates.append(F.count_if(F.abs(quoted(c).cast("double")) == float("inf")).alias(f"infinite{i}"))
    facts = df.agg(*aggregates).first()
    for i, c in enumerate(columns):
        if infinite == "error" and facts[f"infinite{i}"]:
            raise InfiniteValueError(f"'{c}' has {facts[f'infinite{i}']} infinite values")
    found = exact_quantiles(df, values, [0.5], facts["rows"])
    states = []
    for i, c in enumerate(columns):
        count, quantiles = found[c]
        if not count:
            states.append(NumberState(c, 0.0, 0.0, 1.0))
            continue
        median, filled, rows = quantiles[0].value, facts["rows"] - count, facts["rows"]
        mean = (facts[f"avg{i}"] * count + median * filled) / rows
        spread = count * (facts[f"var{i}"] + (facts[f"avg{i}"] - mean) ** 2) + filled * (median - mean) ** 2
        constant = facts[f"min{i}"] == facts[f"max{i}"] and (not filled or median == facts[f"min{i}"])
        states.append(NumberState(c, median, mean, 1.0 if constant else (spread / rows) ** 0.5))
    return states


_MOMENTS = {"avg": F.avg, "var": F.var_pop, "min": F.min, "max": F.max}


class FlowPreprocessorModel(Model, _SavedStage):
    """One-hot columns first (``feature_value``), then the scaled numbers; unknown categories encode to all zeros."""

    def __init__(self, categories: Sequence[CategoryState] = (), numbers: Sequence[NumberState] = (), keep: Sequence[str] = (), vector: str | None = None, infinite: str = "error"):
        super().__init__()
        self.categories, self.numbers, self.keep = list(categories), list(numbers), list(keep)
        self.vector, self.infinite = vector, infinite

    def settings(self) -> dict:
        return {name: getattr(self, name) for name in ("keep", "vector", "infinite")}

    def _require_columns(self) -> None:
        wide = [s.feature for s in self.categories if s.dictionary]
        if wide:
            raise CategoryLimitError(f"more than {CATEGORY_LIMIT} categories in {wide}: too many for columns, use with_vector")

    @property
    def feature_names(self) -> list[str]:
        self._require_columns()
        encoded = [f"{s.feature}_{v}" for s in self.categories for v in s.categories]
        return [*encoded, *[s.feature for s in self.numbers]]

    def imputed(self) -> list[Column]:
        """Categories and numbers with missing values filled, unscaled."""
        return [c.alias(s.feature) for s, c in [*self._filled_categories(), *self._filled_numbers()]]

    def _filled_categories(self):
        return [(s, F.coalesce(_category(quoted(s.feature)), F.lit(s.mode))) for s in self.categories]

    def _filled_numbers(self):
        return [(s, F.coalesce(self._finite(s.feature), F.lit(s.median))) for s in self.numbers]

    def _finite(self, feature: str) -> Column:
        value = measurable(quoted(feature))
        if self.infinite == "missing":
            return value
        refused = F.raise_error(F.lit(f"'{feature}' has infinite values")).cast("double")
        return F.when(F.abs(quoted(feature).cast("double")) == float("inf"), refused).otherwise(value)

    def encoded(self) -> list[Column]:
        self._require_columns()
        return [c for state, column in self._filled_categories() for c in self._flags(state, column)]

    @staticmethod
    def _flags(state: CategoryState, column: Column) -> list[Column]:
        return [F.when(column == F.lit(value), 1.0).otherwise(0.0).alias(f"{state.feature}_{value}") for value in state.categories]

    def scaled(self) -> list[Column]:
        return [((c - F.lit(s.mean)) / F.lit(s.scale)).alias(s.feature) for s, c in self._filled_numbers()]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.categories and not self.numbers:
            raise NotFittedError("the preprocessor is not fitted")
        if self.vector:
            return self._assembled(dataset, dataset.columns, self.vector)
        return dataset.select(*map(quoted, self.keep), *self.encoded(), *self.scaled())

    def with_vector(self, dataset: DataFrame, vector: str = "features") -> DataFrame:
        """Kept columns and the feature vector for model training, sparse where a category has a dictionary."""
        if not self.categories and not self.numbers:
            raise NotFittedError("the preprocessor is not fitted")
        return self._assembled(dataset, self.keep, vector)

    def _assembled(self, dataset: DataFrame, keep: Sequence[str], vector: str) -> DataFrame:
        part = "_part"
        while any(c.startswith(part) for c in dataset.columns):
            part += "_"
        # all parts are made in one projection; only categories with a dictionary are joined
        inputs, columns, wide = [], {}, []
        for i, (state, value) in enumerate(self._filled_categories()):
            if state.dictionary:
                columns[f"{part}{i}t"] = value
                wide.append((state.dictionary, f"{part}{i}t", f"{part}{i}p", f"{part}{i}v"))
                inputs.append(f"{part}{i}v")
            else:
                columns |= {f"{part}{i}c{k}": flag for k, flag in enumerate(self._flags(state, value))}
                inputs += [f"{part}{i}c{k}" for k in range(len(state.categories))]
        columns |= {f"{part}n{i}": scaled for i, scaled in enumerate(self.scaled())}
        inputs += [f"{part}n{i}" for i in range(len(self.numbers))]
        table = dataset.select(*map(quoted, keep), *[c.alias(name) for name, c in columns.items()])
        for dictionary, text, place, flags in wide:
            table = dictionary.with_position(table, F.col(text), place)
            table = dictionary.encoder(place, flags).transform(table)
        return VectorAssembler(inputCols=inputs, outputCol=vector).transform(table).select(*map(quoted, keep), vector)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            {"feature": s.feature, "kind": "category", "mode": s.mode, "categories": list(s.categories)}
            for s in self.categories
        ]
        rows += [
            {"feature": s.feature, "kind": "number", "median": s.median, "mean": s.mean, "scale": s.scale}
            for s in self.numbers
        ]
        return small_table(spark, [{"position": i, **row} for i, row in enumerate(rows)], STATE_SCHEMA)

    def write_state(self, spark: SparkSession, path: str) -> None:
        """State rows and dictionaries below the stage's folder."""
        self.to_df(spark).coalesce(1).write.parquet(f"{path}/state")
        for i, state in enumerate(self.categories):
            if state.dictionary:
                sizes = {"size": F.lit(state.dictionary.size), "rows": F.lit(state.dictionary.rows)}
                state.dictionary.table.withColumns(sizes).write.parquet(f"{path}/dictionary-{i}")

    @staticmethod
    def read_state(spark: SparkSession, path: str, settings: dict) -> FlowPreprocessorModel:
        rows = spark.read.parquet(f"{path}/state").orderBy("position").collect()
        categories = []
        for i, r in enumerate(r for r in rows if r["kind"] == "category"):
            dictionary = None
            if not r["categories"]:
                table = spark.read.parquet(f"{path}/dictionary-{i}")
                size, counted = table.select("size", "rows").first()
                dictionary = CategoryDictionary(table.drop("size", "rows"), size, counted)
            categories.append(CategoryState(r["feature"], r["mode"], tuple(r["categories"]), dictionary))
        numbers = [NumberState(r["feature"], r["median"], r["mean"], r["scale"]) for r in rows if r["kind"] == "number"]
        return FlowPreprocessorModel(categories, numbers, **settings)
