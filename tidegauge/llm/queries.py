"""The registered queries of this subpackage and their SQL equivalents, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import (
    bpe, exact_dedup, filter_audit, language_id, merkle, packing, passages, simhash, suffixes, tool_calls, url_filter, vectors, warc
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; digests of the ids and of the decoded bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


TOOLS = [
    ("look_up", "limit", "integer", True),
    ("look_up", "query", "string", True),
    ("rewrite", "query", "string", True),
    ("rewrite", "strict", "boolean", False),
    ("translate", "query", "string", True),
    ("translate", "target", "string", True),
]


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool use: a user's turn calls a tool, the assistant's turn after it is the result.

    A call needs the user's turn before it and, in every fourth turn, the first; which tool, and which arguments are
    wrong, follows from turn and text. Turns of other roles stay messages without a call.
    """
    turns = table(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("look_up", "rewrite", "translate")]), (F.pmod("size", F.lit(3)) + 1).cast("int"))
    arguments = F.struct(
        F.when(F.pmod("size", F.lit(7)) != 0, F.col("text")).alias("query"),
        F.when(kind == "translate", F.lit("fr")).alias("target"),
        F.when(kind == "look_up", F.pmod("size", F.lit(10))).alias("limit"),
        F.when(kind == "rewrite", F.when(F.pmod("size", F.lit(2)) == 0, "true").otherwise("yes")).alias("strict"),
    )
    before = F.when(F.col("turn") >= 2, F.concat(F.lit("c"), F.col("turn") - 2))
    start = F.when((F.col("turn") > 2) & (F.pmod("turn", F.lit(4)) == 0), F.lit("c0"))
    calls = turns.where("role = 'user'").select(
        F.col("conv_id").alias("conv"),
        F.concat(F.lit("c"), "turn").alias("call"),
        F.col("turn").alias("position"),
        kind.alias("name"),
        F.to_json(arguments).alias("arguments"),
        F.filter(F.array(before, start), lambda x: x.isNotNull()).alias("needs"),
    )
    results = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("conv"), F.concat(F.lit("c"), F.col("turn") - 1).alias("call"), F.col("turn").alias("position"), F.col("text").alias("content")
    )
    schemas = spark.createDataFrame(TOOLS, "tool string, field string, type string, required boolean")
    linked = tool_calls.link(calls, results, schemas)
    rest = turns.where("role is null or role not in ('user', 'assistant')").select(
        F.col("conv_id").alias("conv"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call"), F.col("turn").alias("position"),
        F.lit(None).cast("long").alias("step"), F.lit("plain").alias("status"), F.array().cast("array<string>").alias("errors"),
        F.to_json(F.struct(F.col("text").alias("content"), "role", F.lit("message").alias("type"))).alias("message"),
    )
    return linked.unionByName(rest).select(F.col("conv").alias("conv_id"), "kind", "call", "position", "step", "status", F.array_join("errors", ",").alias("errors"), "message")


OP2_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, text, ['look_up', 'rewrite', 'translate'][length(text) % 3 + 1] AS name FROM conversations
), calls AS (SELECT *, 'c' || turn AS call FROM t WHERE role = 'user'
), results AS (SELECT *, 'c' || (turn - 1) AS call FROM t WHERE role = 'assistant'
), needs AS (
  SELECT conv_id, call, 'c' || (turn - 2) AS need FROM calls WHERE turn >= 2
  UNION SELECT conv_id, call, 'c0' FROM calls WHERE turn > 2 AND turn % 4 = 0
), known AS (SELECT needs.* FROM needs JOIN calls ON needs.conv_id = calls.conv_id AND needs.need = calls.call
), lost AS (
  SELECT conv_id, call, list_sort(list('needs:' || need)) AS lost FROM needs ANTI JOIN calls ON needs.conv_id = calls.conv_id AND needs.need = calls.call
  GROUP BY ALL
), walk AS (
  SELECT conv_id, call, 0 AS level FROM calls
  UNION SELECT known.conv_id, known.call, level + 1 FROM walk JOIN known ON walk.conv_id = known.conv_id AND walk.call = known.need
), depth AS (SELECT conv_id, call, max(level) AS level FROM walk GROUP BY ALL
), shown AS (
  SELECT c.conv_id, 'call' AS kind, c.call, c.turn AS position, (2 * level)::BIGINT AS step, CASE WHEN r.call IS NULL THEN 'pending' ELSE 'linked' END AS status,
         array_to_string(list_concat(
           CASE WHEN length(c.text) % 7 = 0 THEN ['missing:query'] ELSE []::VARCHAR[] END,
           CASE WHEN c.name = 'rewrite' THEN ['type:strict'] ELSE []::VARCHAR[] END,
           coalesce(lost, []::VARCHAR[])), ',') AS errors,
         '{"arguments":{' || array_to_string(list_filter([
           CASE WHEN c.name = 'look_up' THEN '"limit":' || length(c.text) % 10 END,
           CASE WHEN length(c.text) % 7 <> 0 THEN '"query":' || to_json(c.text) END,
           CASE WHEN c.name = 'rewrite' THEN '"strict":' || CASE WHEN length(c.text) % 2 = 0 THEN '"true"' ELSE '"yes"' END END,
           CASE WHEN c.name = 'translate' THEN '"target":"fr"' END], lambda x: x IS NOT NULL), ',')
         || '},"id":"' || c.call || '","name":"' || c.name || '","type":"call"}' AS message
  FROM calls c JOIN depth USING (conv_id, call) LEFT JOIN lost USING (conv_id, call) LEFT JOIN results r USING (conv_id, call)
)
SELECT * FROM shown
UNION ALL SELECT r.conv_id, 'result', r.call, r.turn, 2 * level + 1, CASE WHEN level IS NULL THEN 'orphan' ELSE 'linked' END, '',
       '{"content":' || to_json(r.text) || ',"id":"' || r.call || '","type":"result"}'
FROM results r LEFT JOIN depth USING (conv_id, call)
UNION ALL SELECT conv_id, 'message', NULL, turn, NULL, 'plain', '', '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"message"}'
FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant')"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("group").alias("component_id"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the rows that are not held out; every row is predicted."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(F.coalesce(~held_out(), F.lit(True)) & F.col("lang").isNotNull()))
    found = language_id.predict(docs, model)
    return found.select(
        F.col("key").alias("doc_id"), F.col("language").alias("lang_pred"), "score", "ambiguous"
    ).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("key").alias("doc_id"),
        F.col("keep_key").alias("keep_id"),
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back from them."""
    index = warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")))
    read = warc.read_archives(index, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS head FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM f"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("key").alias("vec_id"), "n_links", F.col("group").alias("component_id"), F.col("key").eqNullSafe(F.col("group")).alias("kept")
    )


OP8_SQL = """
WITH RECURSIVE n AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM n
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), degrees AS (SELECT a, count(*) AS n_links FROM links GROUP BY a), lows AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN degrees ON degrees.a = vec_id LEFT JOIN lows ON lows.a = vec_id"""



def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))



def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.fuzzy_passages(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("key").alias("doc_id"), "start", "stop", F.col("other").alias("other_id"), "other_start", "other_stop", "similarity"
    )

def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, per source."""
    return filter_audit.audit(filter_audit.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents
), w AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS first_id FROM d
), marks AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 2 * length(body),
    regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails
  FROM w LEFT JOIN marks USING (doc_id)
), cells AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, list_transform(range(step - 1), lambda i: ascii(filter_order[i + 1]) - 64) AS earlier, ascii(filter_order[step]) - 64 AS own
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), judged AS (
  SELECT *, fails[own] AS hit, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone FROM cells, steps
), shown AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed,
         sum(n) FILTER (hit AND gone) AS redundant, sum(n) FILTER (hit AND alone) AS unique_fails,
         sum(n) FILTER (hit AND NOT gone AND good) AS good_lost, sum(n) FILTER (hit AND NOT gone AND toxic) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM shown"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree per language, one over the languages, every document's proof, and the check of a tampered table."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.audited(docs, F.coalesce(tampered, F.lit(False)))
    return found.select(
        F.col("key").alias("doc_id"), *[merkle.as_text(c).alias(c) for c in ("leaf", "subroot", "root")],
        F.col("proof").alias("proof_sha256"), merkle.as_text("folded_root").alias("folded_root"), "verified",
    )


def _fields(n_chars: str) -> str:
    values = ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), hashed AS (
  SELECT doc_id, lang, {_fields("n_chars")} AS leaf, {_fields("n_chars + 1")} AS changed,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295) AS sum
  FROM documents, crc
), docs AS (
  SELECT doc_id, leaf, CASE WHEN sum % 7 = 0 THEN changed ELSE leaf END AS claim, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS part,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS size
  FROM hashed
), tree AS (
  SELECT part, 0 AS lvl, slot, size, leaf AS h FROM docs
  UNION ALL SELECT part, lvl + 1, slot // 2, any_value(size + 1) // 2, sha256(string_agg(h, '' ORDER BY slot)) FROM tree WHERE size > 1 GROUP BY part, lvl, slot // 2
), subroots AS (SELECT part, h AS subroot FROM tree WHERE size = 1
), top AS (
  SELECT 0 AS lvl, part AS slot, count(*) OVER () AS size, subroot AS h FROM subroots
  UNION ALL SELECT lvl + 1, slot // 2, any_value(size + 1) // 2, sha256(string_agg(h, '' ORDER BY slot)) FROM top WHERE size > 1 GROUP BY lvl, slot // 2
), above AS (
  SELECT a.slot AS part, t.lvl, (a.slot >> t.lvl) % 2 AS side, s.h AS other
  FROM top a JOIN top t ON a.lvl = 0 AND t.slot = a.slot >> t.lvl AND t.size > 1 LEFT JOIN top s ON s.lvl = t.lvl AND s.slot = xor(t.slot, 1)
), path AS (
  SELECT d.part, d.slot, t.lvl, (d.slot >> t.lvl) % 2 AS side, s.h AS other
  FROM docs d JOIN tree t ON t.part = d.part AND t.slot = d.slot >> t.lvl AND t.size > 1
  LEFT JOIN tree s ON s.part = t.part AND s.lvl = t.lvl AND s.slot = xor(t.slot, 1)
  UNION ALL SELECT d.part, d.slot, 1000 + a.lvl, a.side, a.other FROM docs d JOIN above a ON a.part = d.part
), steps AS (
  SELECT part, slot, lvl, side, coalesce(other, '') AS other, row_number() OVER (PARTITION BY part, slot ORDER BY lvl) AS k FROM path
), fold AS (
  SELECT part, slot, 0::BIGINT AS k, claim AS h FROM docs
  UNION ALL SELECT f.part, f.slot, f.k + 1, sha256(CASE WHEN side = 1 THEN other || h ELSE h || other END) FROM fold f JOIN steps s ON s.part = f.part AND s.slot = f.slot AND s.k = f.k + 1
), ends AS (SELECT part, slot, max_by(h, k) AS folded_root FROM fold GROUP BY part, slot
), proofs AS (SELECT part, slot, string_agg(other, '' ORDER BY k) AS proof FROM steps GROUP BY part, slot)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE size = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
       folded_root = (SELECT h FROM top WHERE size = 1) AS verified
FROM docs JOIN subroots USING (part) JOIN ends USING (part, slot) LEFT JOIN proofs USING (part, slot)"""


URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL: by rule where one fits, else by its path template."""
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("key", "page_id")


def _url_sql() -> str:
    """The walk down the tree, the merges up again and the shares, one common table per level."""
    u = url_filter
    rules = sorted(URL_RULES, key=lambda r: -len(r.text))
    fits = [(f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))", r) for r in rules]
    chain = lambda value: "CASE " + " ".join(f"WHEN {test} THEN {value(r)}" for test, r in fits) + " END"
    parts = [f"""
u0 AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{u.HOST}', 1), '{u.CAPITALS}', '{u.CAPITALS.lower()}') AS host,
         regexp_extract(coalesce(url, ''), '{u.PATH}', 1) AS path
  FROM pages
), w0 AS (
  SELECT *, {chain(lambda r: f"'{r.text}'")} AS rule, {chain(lambda r: int(r.verdict == u.BLOCK))} AS label,
         list_filter(string_split(path, '/'), lambda x: x <> '') AS segments, '' AS template
  FROM u0"""]
    for i in range(1, u.DEPTH + 1):
        parts.append(f"""
s{i} AS (SELECT host, template, segments[{i}] AS segment, count(*) AS n FROM w{i - 1} WHERE len(segments) >= {i} GROUP BY ALL
), k{i} AS (
  SELECT host, template, segment FROM (SELECT *, sum(n) OVER (PARTITION BY host, template) AS total FROM s{i}) WHERE n >= {u.MIN_SEEN} AND n * 100 >= total * {u.MIN_PERCENT}
), w{i} AS (
  SELECT page_id, w.host, path, rule, label, segments,
         w.template || CASE WHEN len(segments) < {i} THEN '' WHEN k.segment IS NULL THEN '/*' ELSE '/=' || k.segment END AS template
  FROM w{i - 1} w LEFT JOIN k{i} k ON w.host = k.host AND w.template = k.template AND w.segments[{i}] = k.segment""")
    parts.append(f"""
urls AS (SELECT * REPLACE (template || CASE WHEN len(segments) > {u.DEPTH} THEN '/**' ELSE '' END AS template) FROM w{u.DEPTH}
), t{u.DEPTH + 2} AS (SELECT host, template, template AS branch, count(label) AS labelled, coalesce(sum(label), 0) AS blocked FROM urls GROUP BY host, template""")
    for i in range(u.DEPTH + 1, 1, -1):
        parts.append(f"""
n{i} AS (
  SELECT host, branch, labelled, blocked, parts[{i}] AS own, array_to_string(parts[1:{i - 1}], '/') AS head, array_to_string(list_prepend('', parts[{i + 1}:]), '/') AS tail
  FROM (SELECT host, branch, string_split(branch, '/') AS parts, sum(labelled)::BIGINT AS labelled, sum(blocked)::BIGINT AS blocked FROM t{i + 1} GROUP BY host, branch)
  WHERE labelled >= {u.MIN_LABELLED} AND len(parts) >= {i}
), l{i} AS (
  SELECT *, lag(labelled) OVER o AS n2, lag(blocked) OVER o AS b2 FROM n{i} WINDOW o AS (PARTITION BY host, head, tail ORDER BY blocked / labelled, own)
), p{i} AS (
  SELECT *, (blocked / labelled - b2 / n2) AS apart, (blocked + b2) / (labelled + n2) AS pooled FROM l{i}
), g{i} AS (
  SELECT *, sum(coalesce((NOT (apart * apart <= {u.CRITICAL}::DOUBLE * (pooled * (1 - pooled) * (1 / labelled + 1 / n2))))::INTEGER, 1)) OVER (PARTITION BY host, head, tail ORDER BY blocked / labelled, own) AS grp FROM p{i}
), m{i} AS (
  SELECT host, branch, head || '/~' || first_value(own) OVER (PARTITION BY host, head, tail, grp ORDER BY blocked / labelled, own) || tail AS onto, count(*) OVER (PARTITION BY host, head, tail, grp) AS members FROM g{i}
), t{i} AS (
  SELECT t.host, t.template, CASE WHEN members > 1 THEN onto ELSE t.branch END AS branch, labelled, blocked
  FROM t{i + 1} t LEFT JOIN m{i} m ON t.host = m.host AND t.branch = m.branch""")
    parts.append(f"""
share AS (SELECT (coalesce(sum(blocked), 0) + 1) / (coalesce(sum(labelled), 0) + 2) AS share FROM t2
), bad AS (
  SELECT host, branch FROM t2, share GROUP BY host, branch, share HAVING (sum(blocked) + {u.STRENGTH} * share) / (sum(labelled) + {u.STRENGTH}) >= {u.PURITY}::DOUBLE
), bad_templates AS (SELECT host, template FROM t2 SEMI JOIN bad ON t2.host = bad.host AND t2.branch = bad.branch""")
    return "WITH " + "),".join(parts) + """
)
SELECT page_id, u.host, path, rule, CASE WHEN coalesce(label = 1, b.host IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict, u.template
FROM urls u LEFT JOIN bad_templates b ON u.host = b.host AND u.template = b.template"""


OP13_SQL = _url_sql()


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_tool_calls": op2_tool_calls,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_vectors": op8_vectors,
    "op9_repeats": op9_repeats,
    "op10_passages": op10_passages,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_url_filters": op13_url_filters,
}
ORACLE = {
    "op2_tool_calls": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op8_vectors": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_merkle_manifest": OP12_SQL,
    "op13_url_filters": OP13_SQL,
}
