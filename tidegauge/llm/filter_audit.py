"""Which filter removes what: an audit of all orders of some filters by the potential of the removal game.

Every row fails a set of filters, kept as bits. Per part, 2^k counts say how many rows each coalition of filters catches;
everything else is arithmetic on them. The Hart-Mas-Colell potential P of the game "rows caught by S" is computed
recursively, ``P(S) = (caught(S) + sum of P(S without i)) / |S|``, and a filter's Shapley value is ``P(all) - P(all
without it)``. In an order, a step removes ``caught(filters so far with it) - caught(filters so far)``. Potentials are kept
times k!, which makes them whole numbers, so a value is the filter's removed rows summed over all orders.

Rows are counted with a map side and texts are met as digests only, so neither a hot part nor a large group of copies
meets in one task: the smallest key of a text is an aggregate, and it is joined back by digest and key together.

Defined cases: a null text is an empty text; a null part is the empty string; a null key is neither a copy of a smaller one
nor makes others copies; rows repeated with one key are no copies of each other; of a key labelled more than once each
label counts that any row gives; an empty table gives no part and so no rows; other columns are ignored; texts of any
length are taken whole.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import saved

FILTERS = "ABCDE"
COPY = "E"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SPACES, SYMBOLS = "\t\n\x0b\x0c\r", "[#$%&*|]"
CAPITALS = "".join(map(chr, range(ord("A"), ord("Z") + 1)))


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_failures(docs: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """key, part, digest and the failed conditions A to D of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), body.alias("body"))
    rows = rows.withColumn("words", F.array_remove(F.split(F.translate("body", SPACES, " " * len(SPACES)), " "), ""))
    points, words, distinct = F.length("body"), F.size("words"), F.size(F.array_distinct("words"))
    capitals = points - F.length(F.translate("body", CAPITALS, ""))
    fails = {
        "A": words < FEWEST_WORDS,
        "B": 100 * distinct < DISTINCT_PERCENT * words,
        "C": 100 * capitals > CAPITAL_PERCENT * points,
        "D": F.col("body").rlike(SYMBOLS),
    }
    bits = sum((F.when(c, F.lit(bit(name))).otherwise(0) for name, c in fails.items()), F.lit(0))
    return rows.select("key", "part", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"), bits.alias("fails"))


def label_flags(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per labelled key: good (quality 1), toxic (toxic 1)."""
    rows = labels.select(F.col(key).alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return rows.where("key is not null").groupBy("key").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (key, digest, fails, ...) with the bit of filter E on rows whose digest a smaller key has."""
    first = rows.where("key is not null").groupBy("digest").agg(F.min("key").alias("first_key"))
    first = first.select(F.col("digest").alias("first_digest"), "first_key")
    same = (F.col("digest") == F.col("first_digest")) & (F.col("key") == F.col("first_key"))
    copy = F.col("first_key").isNull() & F.col("key").isNotNull()
    return rows.join(first, same, "left").withColumn("fails", F.col("fails") + F.when(copy, bit(COPY)).otherwise(0)).drop("first_digest", "first_key")


def failure_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """(part, fails, good, toxic, n) over all rows: at most 4 * 2^k rows per part."""
    rows = text_failures(docs, key, part, text).join(label_flags(labels, key), "key", "left")
    no = F.lit(False)
    rows = saved(rows.select("key", "part", "digest", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")), "failures")
    return with_copies(rows).groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n"))


def coalitions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part: total, and by coalition (bits as index) the arrays caught, caught_good, caught_toxic, potential."""
    k = len(filters)
    groups = range(1, 2**k)

    def caught(s: int, flag: Column) -> Column:
        return F.sum(F.when((F.col("fails").bitwiseAND(s) != 0) & flag, F.col("n")).otherwise(0))

    kinds = {"caught": F.lit(True), "caught_good": F.col("good"), "caught_toxic": F.col("toxic")}
    sums = [caught(s, flag).alias(f"{name}_{s}") for name, flag in kinds.items() for s in groups]
    table = counts.groupBy("part").agg(F.sum("n").alias("total"), *sums).withColumn("p_0", F.lit(0).cast("long"))
    for members in range(1, k + 1):
        level = {}
        for s in groups:
            if s.bit_count() == members:
                without = " + ".join(f"p_{s ^ (1 << i)}" for i in range(k) if s >> i & 1)
                level[f"p_{s}"] = F.expr(f"({factorial(k)} * caught_{s} + {without}) div {members}")
        table = table.withColumns(level)
    zero = F.lit(0).cast("long")
    arrays = [F.array(zero, *[F.col(f"{name}_{s}") for s in groups]).alias(name) for name in kinds]
    return table.select("part", "total", *arrays, F.array(*[F.col(f"p_{s}") for s in range(2**k)]).alias("potential"))


def step_table(filters: str = FILTERS) -> str:
    """SQL of an array of (filter_order, step, own, before, after), one entry per order and step, sets as bits."""
    entries = []
    for order in permutations(filters):
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << filters.index(name)
            entries.append(f"struct('{''.join(order)}' AS filter_order, {step} AS step, {own} AS own, {before} AS before, {before | own} AS after)")
            before |= own
    return f"array({', '.join(entries)})"


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, redundant and lost, and the filter's Shapley value."""
    every = 2 ** len(filters) - 1
    rows = coalitions(counts, filters).withColumn("s", F.explode(F.expr(step_table(filters))))

    def at(name: str, coalition: Column | str) -> Column:
        return F.get(name, F.col(coalition) if isinstance(coalition, str) else coalition)

    def gained(name: str) -> Column:
        return at(name, "s.after") - at(name, "s.before")

    rest = F.lit(every).bitwiseXOR(F.col("s.own"))
    return rows.select(
        "part", "s.filter_order", "s.step",
        (F.col("total") - at("caught", "s.after")).alias("kept"),
        gained("caught").alias("removed"),
        (at("caught", "s.own") - gained("caught")).alias("redundant"),
        (at("caught", F.lit(every)) - at("caught", rest)).alias("unique_fails"),
        gained("caught_good").alias("good_lost"),
        gained("caught_toxic").alias("toxic_lost"),
        (at("potential", F.lit(every)) - at("potential", rest)).alias("shapley"),
    )
