"""Repeatable samples, hold-out splits and folds, drawn by a hash of the row key.

Exact quotas need, per class, the rows at a few ranks in (hash, key) order. The leading bits of the hash deal a class
into buckets of equal chance; counting (class, bucket) with a map side says which bucket holds a rank, and only such
buckets are read and ordered, each in a task of its own. The rows found are the boundaries, a table that is joined by
class (Spark broadcasts it by the size of its files). There may be any number of classes, and no class is ever sorted or
collected as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.config import BACKGROUND_ROWS, FOLDS, SEED, TEST_SIZE
from tidegauge.errors import SplitKeyError
from tidegauge.functions.columns import HASH_RANGE, key_hash, quoted, unit_hash
from tidegauge.session import written

#: Leading bits of the hash that number a class's buckets: a bucket holds one in 65,536 of the class's rows.
BUCKET_BITS = 16


def bucket_counts(df: DataFrame, label: str, key: str, seed: int, bits: int = BUCKET_BITS) -> DataFrame:
    """(class, bucket, rows, before) from a written count; ``before`` are the class's rows in earlier buckets."""
    bucket = F.floor(key_hash(quoted(key), seed) / F.lit(HASH_RANGE / 2**bits))
    counts = df.groupBy(quoted(label).alias("class"), bucket.alias("bucket")).agg(F.count("*").alias("rows"))
    counts = written(counts, "class-buckets")
    if not counts.where("bucket is null").isEmpty():
        raise SplitKeyError(f"'{key}' has NULL values, such rows cannot be assigned")
    earlier = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))


def class_quotas(counts: DataFrame, test_size: float) -> DataFrame:
    """(class, size, quota): ceil(share of all rows), spread in proportion, by largest remainder, then class order, NULL first."""
    sizes = written(counts.groupBy("class").agg(F.sum("rows").alias("size")), "class-sizes")
    rows = sizes.agg(F.sum("size")).first()[0] or 0
    target = math.ceil(rows * test_size)
    product = f"(CAST(size AS DECIMAL(18,0)) * {target}BD)"
    whole, rest = F.expr(f"CAST({product} div {max(rows, 1)}BD AS BIGINT)"), F.expr(f"{product} % {max(rows, 1)}BD")
    shares = sizes.select("class", "size", whole.alias("whole"), rest.alias("rest"))
    spare = target - (shares.agg(F.sum("whole")).first()[0] or 0)
    more = shares.orderBy(F.desc("rest"), F.asc_nulls_first("class")).limit(spare).select(F.col("class").alias("more"), F.lit(1).alias("one"))
    joined = shares.join(more, F.col("class").eqNullSafe(F.col("more")), "left")
    return joined.select("class", "size", (F.col("whole") + F.coalesce("one", F.lit(0))).alias("quota"))


def class_boundaries(df: DataFrame, label: str, key: str, counts: DataFrame, ends: DataFrame, seed: int, bits: int = BUCKET_BITS) -> DataFrame:
    """Written: (class, cuts), the (hash, key) of the last row of each group of first rows, ascending.

    ``ends`` (class, end) says after how many rows of the class a group ends, from 1 to the class size.
    """
    here = F.col("class").eqNullSafe(F.col("end_class")) & (F.col("before") < F.col("end")) & (F.col("end") <= F.col("before") + F.col("rows"))
    places = counts.join(ends.withColumnRenamed("class", "end_class"), here)
    places = written(places.select("class", "bucket", (F.col("end") - F.col("before")).alias("place")), "class-places")
    wanted = places.select(F.col("class").alias("w_class"), F.col("bucket").alias("w_bucket"))
    hashed = key_hash(quoted(key), seed)
    rows = df.select(quoted(label).alias("class"), hashed.alias("hash"), quoted(key).alias("key"))
    rows = rows.withColumn("bucket", F.floor(F.col("hash") / F.lit(HASH_RANGE / 2**bits)))
    same = F.col("class").eqNullSafe(F.col("w_class")) & (F.col("bucket") == F.col("w_bucket"))
    near = rows.join(wanted, same, "left_semi")
    line = Window.partitionBy("class", "bucket").orderBy("hash", "key")
    near = near.withColumn("rank", F.row_number().over(line)).withColumn("shared", F.coalesce(F.lead("key").over(line) == F.col("key"), F.lit(False)))
    near = near.select(F.col("class").alias("n_class"), F.col("bucket").alias("n_bucket"), "rank", "hash", "key", "shared")
    at = F.col("class").eqNullSafe(F.col("n_class")) & (F.col("bucket") == F.col("n_bucket")) & (F.col("place") == F.col("rank"))
    cuts = F.array_sort(F.collect_list(F.struct("hash", "key")))
    found = places.join(near, at).groupBy("class").agg(cuts.alias("cuts"), F.max("shared").alias("shared"))
    found = written(found, "class-boundaries")
    if not found.where("shared").isEmpty():
        raise SplitKeyError(f"'{key}' is not unique, rows with the same key cannot be split")
    return found.drop("shared")


def passed_cuts(df: DataFrame, label: str, key: str, boundaries: DataFrame, seed: int, output: str) -> DataFrame:
    """``df`` with the number of its class's cuts that lie before each row."""
    names = {c: f"{c}_of_{output}" for c in ("class", "cuts")}
    while set(names.values()) & set(df.columns):
        names = {c: f"{n}_" for c, n in names.items()}
    table = boundaries.select(*[F.col(c).alias(n) for c, n in names.items()])
    me = F.struct(key_hash(quoted(key), seed).alias("hash"), quoted(key).alias("key"))
    passed = F.coalesce(F.size(F.filter(quoted(names["cuts"]), lambda cut: me > cut)), F.lit(0))
    joined = df.join(table, quoted(label).eqNullSafe(quoted(names["class"])), "left")
    return joined.withColumn(output, F.when(quoted(names["cuts"]).isNull(), -1).otherwise(passed)).drop(*names.values())


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    exact: bool = True,
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """Adds ``part`` (train or test). Exact class quotas, or independent draws per row in a single lazy pass."""
    if not exact:
        return df.withColumn("part", F.when(unit_hash(quoted(key), seed) < test_size, "test").otherwise("train"))
    counts = bucket_counts(df, label, key, seed, bits)
    ends = class_quotas(counts, test_size).where("quota > 0").select("class", F.col("quota").alias("end"))
    marked = passed_cuts(df, label, key, class_boundaries(df, label, key, counts, ends, seed, bits), seed, "part")
    return marked.withColumn("part", F.when(F.col("part") == 0, "test").otherwise("train"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = FOLDS, seed: int = SEED, bits: int = BUCKET_BITS) -> DataFrame:
    """Adds ``fold`` (0 to k-1); within a class, fold sizes differ by at most one row."""
    counts = bucket_counts(df, label, key, seed, bits)
    sizes = counts.groupBy("class").agg(F.sum("rows").alias("size"))
    even, rest = F.expr(f"size div {k}"), F.col("size") % k
    cuts = F.array(*[F.lit(i) * even + F.least(F.lit(i), rest) for i in range(1, k)]) if k > 1 else F.array().cast("array<bigint>")
    ends = sizes.select("class", "size", F.explode(cuts).alias("end")).where("end < size").select("class", "end").distinct()
    marked = passed_cuts(df, label, key, class_boundaries(df, label, key, counts, ends, seed, bits), seed, "fold")
    return marked.withColumn("fold", F.greatest(F.col("fold"), F.lit(0)).cast("int"))


def fraction_sample(df: DataFrame, fraction: float, key: str | None = None, seed: int = SEED) -> DataFrame:
    """Share of the rows, taken while scanning; repeatable on any partitioning when a key is given."""
    if key is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.where(unit_hash(quoted(key), seed) < fraction)


def fixed_sample(df: DataFrame, rows: int = BACKGROUND_ROWS, key: str | None = None, seed: int = SEED) -> DataFrame:
    """A fixed number of rows; each task keeps only its own candidates."""
    order = [F.rand(seed)] if key is None else [key_hash(quoted(key), seed), quoted(key)]
    return df.orderBy(*order).limit(rows)


def newest(df: DataFrame, rows: int, tie: str, *ties: str, time: str = "timestamp") -> DataFrame:
    """The latest rows, newest first, rows without a time last; of equal times the smallest ``tie`` first, NULL before all."""
    return df.orderBy(F.desc_nulls_last(time), *[quoted(t).asc_nulls_first() for t in (tie, *ties)]).limit(rows)
