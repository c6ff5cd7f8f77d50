"""A Merkle manifest of a table: leaves per row, a tree per part, a tree over the parts, proofs and their verification.

Every level equijoins its nodes with their siblings' computed slots (exclusive or for two, slot offsets for more), and
the rows in slot zero of a run emit the parent. Proofs are handed down: a level's node joins its parent's proof and puts its
own siblings before it, so a proof meets each row once. Joins are by part and slot, which are unique, so a hot part is dealt
over all tasks; places within a part come from a range sort and counts per partition, no part is numbered in one task.

Defined cases: a null field is ``-``; the null part comes first; rows of a part ascend by key, null keys first, rows of
one key by leaf, equal rows in any order; a part of one row has its leaf as root; an empty table gives no rows; other columns
are ignored; texts of any length are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import saved, small

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
DIGEST = 32
#: Bits of ``monotonically_increasing_id`` below the partition's number.
PLACE_BITS = 33
#: Bytes of a run's or a part's row, for the check before a broadcast.
RUN_BYTES, PART_BYTES = 100, 2_000


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_text(raw: Column | str) -> Column:
    return F.lower(F.hex(raw))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``slot``, the place from 0 within the group by ``order`` (nulls first), and ``size`` of the group.

    A range sort writes each row's place in its partition; the counts of (partition, group) say where a run starts.
    """
    by = [F.col(c).asc_nulls_first() for c in (*group, *order, "tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = saved(dealt.drop("tie").withColumn("place", F.monotonically_increasing_id()), "placed")
    task = F.shiftright("place", PLACE_BITS)
    runs = dealt.groupBy(*group, task.alias("task")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("size", F.sum("n").over(Window.partitionBy(*group)))
    runs = saved(runs.select(*[F.col(c).alias(f"run_{c}") for c in group], F.col("task").alias("run_task"), "first", "start", "size"), "runs")
    same = task == F.col("run_task")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"run_{c}"))
    joined = dealt.join(small(runs, RUN_BYTES), same).withColumn("slot", F.col("place") - F.col("first") + F.col("start"))
    return joined.drop("place", "first", "start", "run_task", *[f"run_{c}" for c in group])


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (part, slot, hash, ...) with ``others``: the digests of the run's other nodes from left to right."""
    own = F.col("slot") % arity
    for shift in range(1, arity):
        place = F.col("slot").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("slot") - own + (own + shift) % arity
        side = nodes.select(F.col("part").alias(f"part_{shift}"), F.col("slot").alias(f"slot_{shift}"), F.col("hash").alias(f"hash_{shift}"))
        source = nodes if shift == 1 else found
        found = source.join(side, (F.col("part") == F.col(f"part_{shift}")) & (place == F.col(f"slot_{shift}")), "left")
    spread = [F.coalesce(F.col(f"hash_{s}"), F.lit(b"")) for s in range(1, arity)]
    # the sibling at offset s sits in slot (own + s) % arity: those that wrap around stand left of the node
    ordered = F.concat(*[F.when(own + s >= arity, spread[s - 1]).otherwise(F.lit(b"")) for s in range(1, arity)],
                       *[F.when(own + s < arity, spread[s - 1]).otherwise(F.lit(b"")) for s in range(1, arity)])
    return found.withColumn("others", ordered).drop(*[f"{c}_{s}" for c in ("part", "slot", "hash") for s in range(1, arity)])


def parent(own: Column | str, others: Column | str, slot: Column | str, arity: int) -> Column:
    """The digest above a node, from the node, its siblings and its slot."""
    own, others, slot = (F.col(c) if isinstance(c, str) else c for c in (own, others, slot))
    left = ((slot % arity) * DIGEST).cast("int")
    run = F.concat(F.substring(others, F.lit(1), left), own, F.substring(others, left + 1, F.lit(DIGEST * arity)))
    return digest(as_text(run))


def grown(nodes: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The written levels of all parts' trees, and (part, hash) of their roots, from nodes (part, slot, size, hash, ...).

    Level 0 holds every node with all its columns; a part takes no part above the level that gives its root.
    """
    longest = nodes.agg(F.max("size")).first()[0] or 0
    levels, live, roots = [], nodes, nodes.where("size = 1").select("part", "hash")
    while longest > 1 or not levels:
        level = saved(with_siblings(live, arity), f"level-{len(levels)}")
        levels.append(level)
        above = F.ceil(F.col("size") / arity).cast("long")
        up = level.where((F.col("slot") % arity == 0) & (F.col("size") > 1))
        up = up.select("part", F.expr(f"slot div {arity}").alias("slot"), above.alias("size"), parent("hash", "others", "slot", arity).alias("hash"))
        roots = roots.union(up.where("size = 1").select("part", "hash"))
        live = up.where("size > 1")
        longest = -(-longest // arity)
    return levels, roots


def handed_down(levels: list[DataFrame], arity: int = ARITY) -> DataFrame:
    """Level 0 with ``path``: the ``others`` of the node and of each node above it, upwards."""
    above = None
    for level in reversed(levels):
        path = F.when(F.col("size") > 1, F.array("others")).otherwise(F.array().cast("array<binary>"))
        if above is None:
            above = level.withColumn("path", path).drop("others")
            continue
        upper = above.select(F.col("part").alias("up_part"), F.col("slot").alias("up_slot"), F.col("path").alias("up_path"))
        same = (F.col("part") == F.col("up_part")) & (F.expr(f"slot div {arity}") == F.col("up_slot"))
        rest = F.coalesce("up_path", F.array().cast("array<binary>"))
        above = level.join(upper, same, "left").withColumn("path", F.concat(path, rest)).drop("others", "up_part", "up_slot", "up_path")
    return above


def folded(own: Column, slot: Column | str, path: Column | str, arity: int = ARITY) -> Column:
    """The root that a node and its path give."""
    start = F.struct(own.alias("hash"), (F.col(slot) if isinstance(slot, str) else slot).alias("slot"))
    step = lambda x, others: F.struct(parent(x["hash"], others, x["slot"], arity).alias("hash"), F.floor(x["slot"] / arity).cast("long").alias("slot"))
    return F.aggregate(path, start, step, lambda x: x["hash"])


def manifest(rows: DataFrame, arity: int = ARITY) -> DataFrame:
    """Rows (part value ``group``, ``key``, ``leaf``, ...) with subroot, root, and the two paths of their proof.

    The subroots, in order of the part value, are the leaves of the upper tree.
    """
    names = placed(rows.select("group").distinct().withColumn("all", F.lit(0)), ["all"], ["group"])
    names = saved(names.select(F.col("group").alias("name"), F.col("slot").alias("part")), "parts")
    leaves = placed(rows, ["group"], ["key", "leaf"]).join(small(names, RUN_BYTES), F.col("group").eqNullSafe(F.col("name"))).drop("name")
    levels, roots = grown(leaves.withColumnRenamed("leaf", "hash"), arity)
    roots = saved(roots, "subroots")
    tops = roots.select(F.lit(0).cast("long").alias("part"), F.col("part").alias("slot"), F.lit(names.count()).cast("long").alias("size"), "hash")
    top_levels, root = grown(tops, arity)
    upper = handed_down(top_levels, arity).select(F.col("slot").alias("top_slot"), F.col("hash").alias("subroot"), F.col("path").alias("top_path"), F.col("part").alias("top"))
    upper = saved(upper.join(root.select(F.col("part").alias("top"), F.col("hash").alias("root")), "top").drop("top"), "upper")
    paths = handed_down(levels, arity).withColumnRenamed("hash", "leaf")
    return paths.join(small(upper, PART_BYTES), F.col("part") == F.col("top_slot"))


def verified(rows: DataFrame, claimed: Column, arity: int = ARITY) -> DataFrame:
    """``manifest`` rows with proof digest, the root folded from the ``claimed`` leaf and the original siblings, and whether it holds."""
    whole = F.aggregate(F.concat("path", "top_path"), F.lit(b""), lambda x, y: F.concat(x, y))
    rows = rows.withColumn("proof", F.sha2(as_text(whole).cast("binary"), 256))
    rows = rows.withColumn("folded_subroot", folded(claimed, "slot", "path", arity))
    rows = rows.withColumn("folded_root", folded(F.col("folded_subroot"), "top_slot", "top_path", arity)).drop("folded_subroot")
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def audited(docs: DataFrame, tampered: Column, part: str = "lang", key: str = "doc_id", arity: int = ARITY, fields: tuple[str, ...] = FIELDS, counter: str = "n_chars") -> DataFrame:
    """The manifest of ``docs``, checked against rows whose ``counter`` is one more wherever ``tampered`` holds.

    Per row: key, leaf, subroot, root, proof, folded_root, verified; digests in binary, the proof's as text.
    """
    changed = [F.col(f) + 1 if f == counter else F.col(f) for f in fields]
    claim = F.when(tampered & F.col(counter).isNotNull(), leaf(changed))
    rows = docs.select(F.col(part).alias("group"), F.col(key).alias("key"), leaf([F.col(f) for f in fields]).alias("leaf"), claim.alias("claim"))
    checked = verified(manifest(rows, arity), F.coalesce("claim", "leaf"), arity)
    return checked.select("key", "leaf", "subroot", "root", "proof", "folded_root", "verified")
