"""Helpers shared by the operators: written tables, code on executors, checked broadcasts, packed Arrow batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import remove_folder, scratch_path

#: Bytes up to which a written table may be broadcast; its rows are counted first.
BROADCAST_BYTES = 16_000_000
#: Bytes of an Arrow batch where the session has no setting of its own; Spark's 64 MB are held in the JVM and in Python.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000
#: Spark's setting by which shuffle files are removed once the query that wrote them has ended.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, so that tasks import it and keep its caches."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = os.path.realpath(tempfile.mkdtemp(prefix="package-"))
    archive = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with the package on the executors, in batches of bounded bytes however long the texts are."""
    ship(df.sparkSession)
    if BATCH_SETTING not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(function.__module__)
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


_KEPT: dict[str, list] = {}


def kept(function):
    """``lru_cache`` of a Python worker, emptied as soon as the worker runs another module's tasks."""
    cached = lru_cache(maxsize=2)(function)
    _KEPT.setdefault(function.__module__, []).append(cached)
    return cached


def forget_others(module: str) -> None:
    """Empty the caches of other modules, as a worker lives through many stages."""
    for owner, caches in _KEPT.items():
        if owner != module:
            for cached in caches:
                cached.cache_clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system; a worker without a task keeps what it has for a minute."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: cuts lineage, survives lost executors.

    The shuffle files of the write go with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(RELEASE, None)  # None: not set by the session
    spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove tables of ``saved`` that nothing reads again."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            remove_folder(table.sparkSession, folder)


def small(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked for broadcast when its counted rows stay below ``BROADCAST_BYTES``."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` is called so in any case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def tally(key: Column) -> Column:
    """A second 64-bit hash of the same value, independent of ``xxhash64(key)``."""
    return F.xxhash64(F.lit(7), key)


def texts(column: pa.Array) -> list[str]:
    """Python strings, empty for null."""
    return [x or "" for x in column.to_pylist()]


def slabs(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches whose texts have about ``size`` bytes in all, one row at least; with the byte lengths."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(lengths) // size
        cuts = np.flatnonzero(np.diff(part)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(first, last - first), lengths[first:last]


def joined_bytes(column: pa.Array) -> np.ndarray:
    """The UTF-8 bytes of all rows, one after another."""
    return np.frombuffer(b"".join(x or b"" for x in column.cast(pa.binary()).to_pylist()), np.uint8)


def lists(values: np.ndarray | pa.Array, lengths: np.ndarray) -> pa.Array:
    """A list array from concatenated values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


class Memo(dict):
    """Results of ``compute`` by key, at most ``2 * limit`` of them: when full, all but recently used ones are forgotten."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.compute(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
