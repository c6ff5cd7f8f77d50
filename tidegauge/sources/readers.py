"""Table sources: Parquet, CSV with and without header, CSV sets, named datasets, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.errors import DatasetNotFoundError
from tidegauge.session import small_table


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Whole Parquet table; given a schema, no footer has to be read for it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Types come from the schema; without one they are inferred by an extra pass."""
    reader = spark.read.option("header", True)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, name, length) of the files below a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "length")
    )
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def numbered_files(spark: SparkSession, folder: str, prefix: str = "data_", pattern: str = "*.csv") -> DataFrame:
    """(number, path, name) of ``<prefix><number>`` files or table folders in number order, without name files."""
    root = folder.rstrip("/")
    inside = F.col("path").substr(F.locate(root, F.col("path")) + len(root), F.length("path"))
    number = F.regexp_extract(inside, rf"/{prefix}(\d+)\.", 1)
    return (
        list_files(spark, folder, pattern)
        .withColumn("inside", inside)
        .where((number != "") & ~F.lower("inside").contains("names"))
        .select(number.cast("int").alias("number"), "path", "name")
        .orderBy("number", "path")
    )


def merge_csv(spark: SparkSession, paths: Sequence[str], schemas: Mapping[str, T.StructType] | None = None) -> DataFrame:
    """Union of CSV files by column name; columns a file lacks are NULL.

    Files with equal headers and types are read by one scan; types that differ are widened by the union. Headers are
    looked up only for paths without a given schema.
    """
    schemas = schemas or {}
    groups: dict[tuple, list[str]] = {}
    for path in paths:
        schema = schemas.get(path) or spark.read.option("header", True).csv(path).schema
        header = (path in schemas, *[(f.name, f.dataType.simpleString()) for f in schema])
        groups.setdefault(header, []).append(path)
    merged = None
    for header, members in groups.items():
        part = read_csv(spark, members, schemas.get(members[0]))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    if merged is None:
        raise DatasetNotFoundError("no CSV files to merge")
    return merged


def small_names(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Column names as a one-column text table, in order when written as one part."""
    return small_table(spark, [{"value": n} for n in names], pa.schema([("value", pa.string())]))


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Column names from a one-column side file, in file order."""
    lines = spark.read.text(path, wholetext=True).first()[0]
    return [line.split(",")[0].strip() for line in lines.splitlines() if line.strip()]


def read_headerless(spark: SparkSession, paths: str | list[str], names: Sequence[str]) -> DataFrame:
    """CSV without header, all columns as text; empty fields are NULL."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("header", False).csv(paths)


@dataclass(frozen=True)
class Dataset:
    """Where a named dataset lives."""

    path: str
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    schema: T.StructType | None = None


class Catalog:
    """Datasets by name."""

    def __init__(self, datasets: Mapping[str, Dataset]):
        self.datasets = dict(datasets)

    @staticmethod
    def parquet_folder(folder: str, names: Sequence[str], suffix: str = ".parquet") -> Catalog:
        return Catalog({n: Dataset(f"{folder.rstrip('/')}/{n}{suffix}") for n in names})

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        """The named table; unknown names and missing files are a typed error."""
        if name not in self.datasets:
            raise DatasetNotFoundError(f"unknown dataset '{name}'")
        dataset = self.datasets[name]
        reader = spark.read.format(dataset.format).options(**dataset.options)
        if dataset.schema is not None:
            reader = reader.schema(dataset.schema)
        try:
            return reader.load(dataset.path)
        except (AnalysisException, Py4JJavaError) as error:
            raise DatasetNotFoundError(f"dataset '{name}' not found at {dataset.path}") from error


def table_parts(df: DataFrame) -> DataFrame:
    """(part, rows) per file of a file-based table."""
    return (
        df.select(F.col("_metadata.file_path").alias("part")).groupBy("part").agg(F.count("*").alias("rows")).orderBy("part")
    )


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """(table, column_names, column_count, parts, total_rows); total rows are summed over the parts."""
    return table_parts(df).agg(
        F.lit(name).alias("table"),
        F.lit(",".join(df.columns)).alias("column_names"),
        F.lit(len(df.columns)).alias("column_count"),
        F.count("*").alias("parts"),
        F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("total_rows"),
    )


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)
