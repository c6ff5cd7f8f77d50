"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``. A Misra-Gries summary names the digests that
may hold a large share of the rows; their winners are verified by an exact aggregation and broadcast, so rows of a hot
group never meet in one task. All other digests are shuffled as usual.

Defined cases: a null text is an empty text; of rows equal in length the smallest key stays, null keys last; of repeated
rows with one key exactly one stays; an empty table gives an empty result; texts of any length are hashed whole; keys are integers; other
columns, whatever their names, are ignored by ``exact_groups`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import free_names, saved, small

WHITE = " \t\n\x0b\x0c\r"
#: Digests above this share of the rows are certainly found; at most 1 / SUPPORT digests are broadcast.
SUPPORT = 0.001
#: Bytes of a dropped row's key and digest, for the check before a broadcast.
ROW_BYTES = 64


def normalised(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def digest_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Narrow written table: key, row, code points of the original text, digest."""
    original = F.coalesce(F.col(text), F.lit(""))
    return saved(
        docs.select(
            F.col(key).alias("key"),
            F.monotonically_increasing_id().alias("row"),
            F.length(original).cast("long").alias("points"),
            F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        ),
        "digests",
    )


def _winners(rows: DataFrame) -> DataFrame:
    """One row per digest; bitwise complements turn the largest struct into the smallest key, without overflow."""
    best = F.max(F.struct("points", F.bitwise_not("key").alias("key"), F.bitwise_not("row").alias("row")))
    return (
        rows.groupBy("digest")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
        .select(
            "digest",
            F.bitwise_not(F.col("best.key")).alias("keep_key"),
            F.bitwise_not(F.col("best.row")).alias("keep_row"),
            "group_size",
        )
    )


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """Per row: key, keep_key, group_size, kept, digest."""
    rows = digest_table(docs, key, text)
    frequent = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    frequent = saved(frequent.where("digest is not null").distinct(), "frequent")
    heavy_winners = saved(_winners(rows.join(F.broadcast(frequent), "digest")), "winners")
    heavy = rows.join(F.broadcast(heavy_winners), "digest")
    rest = rows.join(F.broadcast(frequent), "digest", "left_anti")
    both = heavy.unionByName(rest.join(_winners(rest), "digest"))
    return both.select("key", "keep_key", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with all their columns.

    Dropped keys are removed by an anti join on key and digest, so texts are compared nowhere. Rows repeated with one
    key (equal in key and digest) are told apart by nothing but their place; they alone are reduced by grouping.
    """
    groups = saved(exact_groups(docs, key, text, support), "groups")
    digest, other_key, other, shown, whole = free_names(docs, "digest", "other_key", "other", "points", "whole")
    marked = docs.withColumn(digest, F.unhex(F.sha2(normalised(text).cast("binary"), 256)))
    ids = groups.groupBy("key", "digest").agg(F.count("*").alias("copies"), F.max("kept").alias("stays"))
    odd = saved(ids.where("copies > 1 or not stays").select("key", "digest", "stays"), "odd")
    same = F.col(key).eqNullSafe(F.col(other_key)) & (F.col(digest) == F.col(other))
    named = odd.select(F.col("key").alias(other_key), F.col("digest").alias(other))
    kept = marked.join(small(named, ROW_BYTES), same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if odd.where("stays").isEmpty():
        return kept
    points = F.length(F.coalesce(F.col(text), F.lit("")))
    rows = F.struct(points.alias(shown), *[F.col(f"`{c}`") for c in docs.columns])
    named = odd.where("stays").select(F.col("key").alias(other_key), F.col("digest").alias(other))
    repeated = marked.join(small(named, ROW_BYTES), same, "left_semi").groupBy(key, digest).agg(F.max_by(rows, points).alias(whole))
    return kept.union(repeated.select(*[F.col(f"{whole}.`{c}`") for c in docs.columns]))
