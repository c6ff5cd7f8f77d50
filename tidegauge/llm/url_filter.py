"""URL verdicts by host rules and, where none fits, by a tree of path templates; in DataFrame functions only.

Per host, a path's segments are walked one level at a time: a value that is seen ``MIN_SEEN`` times and in ``MIN_PERCENT``
percent of the URLs at its node stays a branch, all others go on in the node's wildcard; what lies below ``DEPTH`` segments is
one more wildcard. URLs that a rule fits are the labelled ones. Branches that differ in one segment only are merged, from the
deepest segment up, where neighbours in order of their blocked share do not differ statistically. A template is rejected when
its blocked share, smoothed by the share of the whole table, reaches ``PURITY``.

Rows stay where they are: counts have a map side, branches and rejected templates are joined (broadcast only when their
counted rows are small). A node has at most 100 / MIN_PERCENT branches and a wildcard, so no window holds more siblings.

Defined cases: a URL that is null or without ``://`` has host and path ``''`` and is judged like any other; repeated URLs
count once each; empty segments are skipped; of rules of one length the first listed wins; without labelled rows the share of
the whole table is one half; an empty table gives no rows; other columns are ignored; long URLs are taken whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import saved, small

HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
CAPITALS = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
ALLOW, BLOCK = "allow", "block"
#: Segments of a template, before its rest becomes one wildcard.
DEPTH = 4
MIN_SEEN, MIN_PERCENT = 8, 2
#: Labelled rows that a branch needs to be merged; the 95 % point of chi-square with one degree of freedom.
MIN_LABELLED, CRITICAL = 5, 3.841
#: Rows that the whole table's share weighs; the share from which a template is rejected.
STRENGTH, PURITY = 5, 0.8
#: Bytes of a branch or template, for the check before a broadcast.
NODE_BYTES = 300


class Rule(NamedTuple):
    """A verdict for a host with all subdomains, on paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without a URL."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, HOST, 1), CAPITALS, CAPITALS.lower()), F.regexp_extract(url, PATH, 1)


def fitting(host: Column, path: Column, rules: list[Rule], shown: str) -> Column:
    """``shown`` (text or verdict) of the longest rule that fits, else null. Rules are literals: a list of thousands at most."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: -len(r.text))[::-1]:
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, getattr(rule, shown)).otherwise(found)
    return found


def ruled(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """Written: key, host, path, rule, its verdict as label (1 block, 0 allow, else null), segments."""
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    verdict = fitting(F.col("host"), F.col("path"), rules, "verdict")
    return saved(
        rows.select(
            "key", "host", "path", fitting(F.col("host"), F.col("path"), rules, "text").alias("rule"),
            F.when(verdict.isNotNull(), (verdict == BLOCK).cast("int")).alias("label"),
            F.array_remove(F.split("path", "/"), "").alias("segments"),
        ),
        "urls",
    )


def with_templates(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``rows`` with ``template``: a branch as ``/=value``, a wildcard as ``/*``, the rest below ``depth`` as ``/**``."""
    rows = rows.withColumn("template", F.lit(""))
    for level in range(depth):
        segment = F.get("segments", F.lit(level))
        seen = rows.where(F.size("segments") > level).groupBy("host", "template", segment.alias("segment")).agg(F.count("*").alias("n"))
        seen = saved(seen, "seen")
        if seen.isEmpty():
            break
        totals = seen.groupBy("host", "template").agg(F.sum("n").alias("total"))
        kept = seen.where(F.col("n") >= MIN_SEEN).join(totals, ["host", "template"]).where(F.col("n") * 100 >= F.col("total") * MIN_PERCENT)
        kept = saved(kept.select(F.col("host").alias("b_host"), F.col("template").alias("b_template"), F.col("segment").alias("branch")), "branches")
        same = (F.col("host") == F.col("b_host")) & (F.col("template") == F.col("b_template")) & (segment == F.col("branch"))
        step = F.when(segment.isNull(), "").when(F.col("branch").isNull(), "/*").otherwise(F.concat(F.lit("/="), "branch"))
        rows = rows.join(small(kept, NODE_BYTES), same, "left").withColumn("template", F.concat("template", step)).drop("b_host", "b_template", "branch")
    return rows.withColumn("template", F.concat("template", F.when(F.size("segments") > depth, "/**").otherwise("")))


def similar(n: Column, blocked: Column, other_n: Column, other_blocked: Column) -> Column:
    """Whether two blocked shares do not differ at the 5 % level (pooled two-proportion test)."""
    apart = blocked / n - other_blocked / other_n
    pooled = (blocked + other_blocked) / (n + other_n)
    return apart * apart <= CRITICAL * (pooled * (1 - pooled) * (1 / n + 1 / other_n))


def merged(templates: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, template, labelled, blocked) with ``branch``, the template after merging similar siblings.

    Siblings share all segments but one; they are ordered by blocked share, and each neighbour that does not differ
    joins the group before it. A group is named after its first member. Branches with few labelled rows stay alone.
    """
    templates = templates.withColumn("branch", F.col("template"))
    for place in range(depth + 1, 1, -1):  # the text before the first slash is empty
        parts = F.split("branch", "/")
        nodes = templates.groupBy("host", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        nodes = nodes.where((F.col("labelled") >= MIN_LABELLED) & (F.size(parts) >= place))
        head, own, tail = F.slice(parts, 1, place - 1), F.get(parts, F.lit(place - 1)), F.slice(parts, place + 1, depth + 2)
        nodes = nodes.withColumns({"own": own, "head": F.array_join(head, "/"), "tail": F.array_join(F.concat(F.array(F.lit("")), tail), "/")})
        line = Window.partitionBy("host", "head", "tail").orderBy(F.col("blocked") / F.col("labelled"), "own")
        before = {c: F.lag(c).over(line) for c in ("labelled", "blocked")}
        new = F.coalesce((~similar(F.col("labelled"), F.col("blocked"), before["labelled"], before["blocked"])).cast("int"), F.lit(1))
        groups = nodes.withColumn("new", new).withColumn("group", F.sum("new").over(line))
        whole = Window.partitionBy("host", "head", "tail", "group")
        ranked = groups.withColumn("members", F.count("*").over(whole)).withColumn("first", F.first("own").over(whole.orderBy(F.col("blocked") / F.col("labelled"), "own")))
        named = ranked.where("members > 1").select(
            F.col("host").alias("m_host"), F.col("branch").alias("m_branch"), F.concat("head", F.lit("/~"), "first", "tail").alias("to")
        )
        same = (F.col("host") == F.col("m_host")) & (F.col("branch") == F.col("m_branch"))
        templates = templates.join(named, same, "left").withColumn("branch", F.coalesce("to", "branch")).drop("m_host", "m_branch", "to")
    return templates


def rejected(templates: DataFrame) -> DataFrame:
    """(host, template) of the templates whose merged branch has a smoothed blocked share of ``PURITY`` or more."""
    templates = saved(templates, "templates")
    blocked, labelled = templates.agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    share = (blocked + 1) / (labelled + 2)
    branches = templates.groupBy("host", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    bad = branches.where((F.col("blocked") + STRENGTH * share) / (F.col("labelled") + STRENGTH) >= PURITY)
    return templates.join(bad.select("host", "branch"), ["host", "branch"], "left_semi").select("host", "template")


def judged(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", depth: int = DEPTH) -> DataFrame:
    """Per row: key, host, path, rule, verdict, template."""
    rows = with_templates(ruled(pages, rules, key, url), depth)
    counts = rows.groupBy("host", "template").agg(F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    bad = saved(rejected(merged(saved(counts, "counts"), depth)), "rejected")
    bad = bad.select(F.col("host").alias("bad_host"), F.col("template").alias("bad_template"))
    same = (F.col("host") == F.col("bad_host")) & (F.col("template") == F.col("bad_template"))
    block = F.coalesce(F.col("label") == 1, F.col("bad_host").isNotNull())
    found = rows.join(small(bad, NODE_BYTES), same, "left")
    return found.select("key", "host", "path", "rule", F.when(block, BLOCK).otherwise(ALLOW).alias("verdict"), "template")
