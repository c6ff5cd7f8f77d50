"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results are hash-joined by conversation and call identifier, calls are put in topological order of their
dependencies, arguments are validated against the tools' schemas, and every message is serialised as canonical JSON
(keys sorted, no white space, numbers and strings in one form).

Levels are found by path doubling: an edge to a call that has few dependencies left is replaced by edges to these, with
the longest way there as weight, after edges that a longer way makes needless have gone. Known ways double in each round,
so chains, calls that each need the few before them, and layers of a few calls take about log2(n) rounds; ``few`` is what
keeps the counted paths of a round within ``ROOM`` times the calls and needs, one at least, so a graph with more
dependencies than that can take a round per level. A round touches only calls whose level is still open. Identifiers, not
conversations, are the keys of every shuffle: a conversation with a third of all calls is spread like any other, and no
group is gathered in a row or a task.

Defined cases: null identifiers link with nothing; of calls with one identifier the first by position (then by JSON) is
the call and the others are ``duplicate``, likewise for results; calls without a result are ``pending``, results without
a call ``orphan``; calls on or behind a cycle are ``cyclic`` and come last; a dependency on an unknown call is an error
of the call and does not order it; arguments that are no JSON object are an error; unknown tools are an error; empty and
very long arguments and contents are kept whole; repeated rows come out as often as they came in; without calls and
results there are no rows; columns beside those named are not carried, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import saved, small

#: JSON types by the first word of Spark's name for a variant's type.
TYPES = {"BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object", "VOID": "null"}
ROW_BYTES = 200
#: Paths of one round, as a multiple of calls and needs, and the numbers of dependencies stepped over that are tried.
ROOM, WIDTHS = 4, [1 << k for k in range(7)]


def canonical(json: Column) -> Column:
    """Canonical form of a JSON text: keys in order, no white space; null for anything that is no JSON."""
    return F.to_json(F.try_parse_json(json))


def json_type(value: Column) -> Column:
    word = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), word)


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv, call, level, cyclic): the longest path of dependencies below each call.

    ``calls``: distinct (conv, call); ``needs``: distinct (conv, call, need) between them.
    """
    most = calls.count()
    edges = saved(needs.select("conv", "call", "need", F.lit(1).cast("long").alias("w")), "needs")
    room = ROOM * (most + edges.count())
    start = calls.select("conv", "call", F.lit(0).cast("long").alias("level"), F.lit(False).alias("cyclic"))
    open_, done = _split(start, edges)
    settled = [done]
    while not edges.isEmpty():
        left = edges.groupBy("conv", "call").agg(F.count("*").alias("n"))
        state = open_.join(left, ["conv", "call"], "left").select("conv", F.col("call").alias("need"), "level", "cyclic", F.coalesce("n", F.lit(0)).alias("n"))
        met = saved(edges.join(state, ["conv", "need"]), "met")
        width, least = _width(met, room)
        moved = met.where(F.col("n") <= width)
        legs = edges.select("conv", F.col("call").alias("need"), F.col("need").alias("next"), F.col("w").alias("more"))
        paths = moved.where("n > 0").join(legs, ["conv", "need"])
        paths = saved(paths.select("conv", "call", "need", "next", (F.col("w") + F.col("more")).alias("w")), "paths")

        spare = _spare(edges, paths)
        kept = met.where(F.col("n") > width).select("conv", "call", "need", "w")
        if spare:
            second = spare.select("conv", F.col("call").alias("need"), F.col("need").alias("next"))
            paths = paths.join(spare, ["conv", "call", "need"], "left_anti").join(second, ["conv", "need", "next"], "left_anti")
            kept = kept.join(spare, ["conv", "call", "need"], "left_anti")
        kept = kept.unionByName(paths.select("conv", "call", F.col("next").alias("need"), "w"))
        # a dependency of its own, or a path longer than there are calls, is a cycle
        wrong = (F.col("call") == F.col("need")) | (F.col("w") > most)
        kept = saved(kept.groupBy("conv", "call", "need").agg(F.max("w").alias("w")).withColumn("wrong", wrong), "needs")
        news = moved.select("conv", "call", (F.col("level") + F.col("w")).alias("up"), F.col("cyclic").alias("bad"))
        news = news.unionByName(kept.where("wrong").select("conv", "call", F.lit(0).cast("long").alias("up"), F.lit(True).alias("bad")))
        if least > width:
            news = kept.select("conv", "call", F.lit(0).cast("long").alias("up"), F.lit(True).alias("bad"))
            kept = kept.where("false")
        news = news.groupBy("conv", "call").agg(F.max("up").alias("up"), F.max("bad").alias("bad"))
        risen = open_.join(news, ["conv", "call"], "left").select(
            "conv", "call", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"), (F.col("cyclic") | F.coalesce("bad", F.lit(False))).alias("cyclic")
        )
        edges = saved(kept.where("not wrong").select("conv", "call", "need", "w"), "needs")
        open_, done = _split(risen, edges)
        settled.append(done)
    return reduce(DataFrame.unionByName, settled)


def _width(met: DataFrame, room: int) -> tuple[int, int]:
    """Up to how many dependencies a call may have left to be stepped over, for at most ``room`` paths; the fewest left."""
    sums = [F.coalesce(F.sum(F.when(F.col("n") <= k, F.col("n"))), F.lit(0)) for k in WIDTHS]
    *sums, least = met.agg(*sums, F.coalesce(F.min("n"), F.lit(0))).first()
    return max([k for k, paths in zip(WIDTHS, sums) if paths <= room], default=1), least


def _spare(edges: DataFrame, paths: DataFrame) -> DataFrame | None:
    """Dependencies that a path over another dependency reaches as well, and not on a shorter way; None without any.

    Only paths over identifiers above the dependency's count, or only those below it, whichever spares more: on a cycle
    each call is then left with its highest (lowest) dependency that leads to the cycle, so that no cycle comes undone.
    """
    same = (F.col("e.conv") == F.col("p.conv")) & (F.col("e.call") == F.col("p.call")) & (F.col("e.need") == F.col("p.next"))
    met = edges.alias("e").join(paths.alias("p"), same & (F.col("p.w") >= F.col("e.w")) & (F.col("p.need") != F.col("e.need")))
    above = F.col("p.need") > F.col("e.need")
    found = saved(met.groupBy("e.conv", "e.call", "e.need").agg(F.max(above).alias("above"), F.max(~above).alias("below")), "spare")
    counts = found.agg(F.count_if("above").alias("above"), F.count_if("below").alias("below")).first()
    if not counts.above and not counts.below:
        return None
    return found.where("above" if counts.above >= counts.below else "below").select("conv", "call", "need")


def _split(depth: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calls that the remaining edges touch, and the others, whose level is final."""
    ends = edges.select("conv", "call").union(edges.select("conv", F.col("need").alias("call"))).distinct()
    marked = saved(depth.join(ends.withColumn("touched", F.lit(True)), ["conv", "call"], "left"), "levels")
    return marked.where("touched").drop("touched"), marked.where("touched is null").drop("touched")


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``errors``: what is wrong with the arguments by the schema of the tool, in order.

    ``schemas``: tool, field, type (a JSON type), required; aggregated to one row per tool, and broadcast if small.
    """
    fields = F.array_sort(F.collect_list(F.struct("field", "type", "required")))
    tools = small(saved(schemas.groupBy(F.col("tool").alias("__tool")).agg(fields.alias("__fields")), "tools"), ROW_BYTES * 20)
    parsed = calls.withColumn("__args", F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string,variant>"))
    joined = parsed.join(tools, F.col("name") == F.col("__tool"), "left")
    given = F.col("__args")

    def wrong(field: Column) -> Column:
        value = F.element_at(given, field["field"])
        kind = json_type(value)
        fits = (kind == field["type"]) | ((kind == "integer") & (field["type"] == "number"))
        return F.when(~F.map_contains_key(given, field["field"]), F.when(field["required"], F.concat(F.lit("missing:"), field["field"]))).when(
            ~fits, F.concat(F.lit("type:"), field["field"])
        )

    by_field = F.transform("__fields", wrong)
    extra = F.transform(
        F.array_sort(F.array_except(F.map_keys(given), F.transform("__fields", lambda f: f["field"]))), lambda k: F.concat(F.lit("unknown:"), k)
    )
    errors = (
        F.when(F.col("__tool").isNull(), F.array(F.lit("tool")))
        .when(given.isNull(), F.array(F.lit("json")))
        .otherwise(F.concat(F.filter(by_field, lambda e: e.isNotNull()), extra))
    )
    return joined.withColumn("errors", errors).drop("__args", "__tool", "__fields")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and result: conv, kind, call, position, step, status, errors, message.

    ``calls``: conv, call, position, name, arguments (JSON), needs (array of call identifiers);
    ``results``: conv, call, position, content. Within a conversation the order is (step, position, call, message): a
    call's step is twice its level, its result's one more; cyclic and orphan messages have no step and come last.
    """
    columns = ["position", "name", "arguments", "needs"]
    grouped = calls.groupBy("conv", "call").agg(F.min(F.struct(*columns)).alias("c"))
    first = saved(grouped.where("conv is not null and call is not null").select("conv", "call", "c.*"), "calls")
    answers = results.groupBy("conv", "call").agg(F.min(F.struct("position", "content")).alias("r"))
    answers = saved(answers.where("conv is not null and call is not null").select("conv", "call", F.col("r.position").alias("r_position"), "r.content"), "results")

    asked = first.select("conv", "call", F.explode(F.array_distinct("needs")).alias("need")).where("need is not null")
    known = first.select("conv", F.col("call").alias("need"), F.lit(True).alias("known"))
    asked = saved(asked.join(known, ["conv", "need"], "left"), "asked")
    depth = levels(first.select("conv", "call"), asked.where("known").select("conv", "call", "need"))
    lost = asked.where("known is null").groupBy("conv", "call").agg(F.array_sort(F.collect_set(F.concat(F.lit("needs:"), "need"))).alias("lost"))

    checked = argument_errors(first, schemas).join(depth, ["conv", "call"]).join(lost, ["conv", "call"], "left")
    checked = checked.withColumn("errors", F.concat("errors", F.coalesce("lost", F.array().cast("array<string>"))))
    met = checked.join(answers.hint("shuffle_hash"), ["conv", "call"], "full_outer")
    met = saved(met, "linked")
    called = F.col("errors").isNotNull()
    step = F.when(~F.col("cyclic"), 2 * F.col("level"))

    # fields stand in alphabetical order, as the keys of canonical JSON
    arguments = F.coalesce(F.try_parse_json("arguments"), F.to_variant_object(F.struct(F.col("arguments").alias("text"))))
    call_json = F.to_json(F.struct(arguments.alias("arguments"), F.col("call").alias("id"), "name", F.lit("call").alias("type")))
    result_json = F.to_json(F.struct("content", F.col("call").alias("id"), F.lit("result").alias("type")))
    none = F.array().cast("array<string>")
    calls_out = met.where(called).select(
        "conv", F.lit("call").alias("kind"), "call", "position", step.alias("step"),
        F.when(F.col("cyclic"), "cyclic").when(F.col("r_position").isNull() & F.col("content").isNull(), "pending").otherwise("linked").alias("status"),
        "errors", call_json.alias("message"),
    )
    results_out = met.where(F.col("r_position").isNotNull() | F.col("content").isNotNull()).select(
        "conv", F.lit("result").alias("kind"), "call", F.col("r_position").alias("position"), (step + 1).alias("step"),
        F.when(~called, "orphan").when(F.col("cyclic"), "cyclic").otherwise("linked").alias("status"), none.alias("errors"), result_json.alias("message"),
    )
    return calls_out.unionByName(results_out).unionByName(_others(calls, results, first, answers, call_json, result_json))


def _others(calls: DataFrame, results: DataFrame, first: DataFrame, answers: DataFrame, call_json: Column, result_json: Column) -> DataFrame:
    """Messages beside the linked ones: those without identifiers, and all but the first of an identifier.

    Equal rows are counted, not compared: the linked one of them is taken off the count.
    """
    none = F.array().cast("array<string>")

    def rest(rows: DataFrame, taken: DataFrame, columns: list[str], kind: str, json: Column, status: str) -> DataFrame:
        counted = rows.groupBy("conv", "call", *columns).agg(F.count("*").alias("n"))
        one = taken.select("conv", "call", *columns, F.lit(1).alias("one"))
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("conv", "call", *columns)]
        left = counted.alias("x").join(one.alias("y"), same, "left").select("x.*", (F.col("x.n") - F.coalesce("y.one", F.lit(0))).alias("more"))
        again = left.where("more > 0").withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("more").cast("long"))))
        missing = F.col("conv").isNull() | F.col("call").isNull()
        return again.select(
            "conv", F.lit(kind).alias("kind"), "call", "position", F.lit(None).cast("long").alias("step"),
            F.when(missing, status).otherwise("duplicate").alias("status"), none.alias("errors"), json.alias("message"),
        )

    more_calls = rest(calls, first, ["position", "name", "arguments", "needs"], "call", call_json, "pending")
    found = answers.select("conv", "call", F.col("r_position").alias("position"), "content")
    return more_calls.unionByName(rest(results, found, ["position", "content"], "result", result_json, "orphan"))
