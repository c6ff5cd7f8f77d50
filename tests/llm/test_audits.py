"""The filter audit, the Merkle manifest and the URL filters against brute force and their SQL, on small odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import difference
from pyspark.sql import functions as F
from tidegauge.llm import filter_audit, merkle, queries, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def documents():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        text = " ".join(rng.choices(words[: rng.choice([3, 60, 400])], k=rng.choice([0, 1, 150, 199, 200, 260])))
        text = rng.choice([text, text.upper(), text + " 50 % off", text.replace(" ", "\n\t "), "same text", "", None])
        rows.append((i, text, rng.choice(["en", "de", None, "é", "Z", "solo" if i == 7 else "en"]), rng.choice(["a", "b", None, ""]), rng.choice([len(text or ""), None])))
    rows += [(3, "same text", "en", "a", 9)] * 3 + [(3, "another text", "en", "b", 1), (None, "same text", "en", "a", 9), (None, None, None, None, None), (10**15, "é% " * 40_000, "de", "b", 1)]
    rng.shuffle(rows)
    return rows


def labels():
    rng = random.Random(6)
    return [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (9999, 1, 1)]


def audit_by_hand(docs, marks):
    good = {k for k, q, _ in marks if q == 1 and k is not None}
    toxic = {k for k, _, t in marks if t == 1 and k is not None}
    smallest = {}
    for key, text, *_ in docs:
        if key is not None:
            smallest[text or ""] = min(key, smallest.get(text or "", key))
    rows = []
    for key, text, _, source, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                 bool(re.search(r"[#$%&*|]", text)), key is not None and key > smallest[text]]
        rows.append((source or "", "".join(n for n, f in zip("ABCDE", fails) if f), key in good, key in toxic))
    shown, sums = [], Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                hit = [r for r in rows if r[0] == part and name in r[1]]
                sums[part, name] += len(gone)
                shown.append((part, order, step, len(left), len(gone), len(hit) - len(gone), sum(r[1] == name for r in hit), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return {(*r, sums[r[0], r[1][r[2] - 1]]) for r in shown}


def test_audit_equals_running_every_order(spark):
    docs, marks = documents(), labels()
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    for name in ("key", "part", "fails", "digest", "first_key", "good", "n", "quality"):
        frame = frame.withColumn(name, F.lit("x"))
    found = filter_audit.audit(filter_audit.failure_counts(frame, spark.createDataFrame(marks, LABELS).withColumn("text", F.lit(1))))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == audit_by_hand(docs, marks)


def test_audit_of_nothing(spark):
    counts = filter_audit.failure_counts(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert filter_audit.audit(counts).count() == 0


def test_shapley_values_add_up_to_the_removed_rows(spark):
    counts = spark.createDataFrame([("p", 3, True, False, 5), ("p", 4, False, False, 2), ("p", 0, False, True, 4)], "part string, fails int, good boolean, toxic boolean, n long")
    first = filter_audit.audit(counts, "XYZ").where("filter_order = 'XYZ'").orderBy("step").collect()
    assert [r.kept for r in first] == [6, 6, 4] and [r.shapley for r in first] == [15, 15, 12] and sum(r.shapley for r in first) == 6 * (11 - 4)
    assert [r.redundant for r in first] == [0, 5, 0] and [r.unique_fails for r in first] == [0, 0, 2]


# --- Merkle manifest


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(row, more=0):
    key, text, lang, source, n = row
    values = [key, source, lang, n if n is None else n + more, text]
    return hashed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_by_hand(hashes, arity):
    """Root and, per leaf, the list of (left siblings, right siblings) upwards."""
    paths, places, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for path, i in zip(paths, places):
            start = i // arity * arity
            path.append((level[start:i], level[i + 1 : start + arity]))
        level = [hashed(*level[i : i + arity]) for i in range(0, len(level), arity)]
        places = [i // arity for i in places]
    return level[0], paths


def manifest_by_hand(docs, arity=2):
    parts = {}
    for row in docs:
        parts.setdefault(row[2], []).append(row)
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for name in names:
        parts[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_hand(r)))
        trees.append(tree_by_hand([leaf_by_hand(r) for r in parts[name]], arity))
    root, tops = tree_by_hand([t[0] for t in trees], arity)
    found = []
    for name, (subroot, paths), top in zip(names, trees, tops):
        for row, path in zip(parts[name], paths):
            whole = path + top
            odd = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
            folded = leaf_by_hand(row, int(odd))
            for left, right in whole:
                folded = hashed(*left, folded, *right)
            found.append((row[0], leaf_by_hand(row), subroot, root, hashed(*[h for left, right in whole for h in left + right]), folded, folded == root))
    return Counter(found)


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_equals_trees_by_hand(spark, arity):
    docs = documents()
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    for name in ("key", "group", "leaf", "slot", "size", "hash", "claim", "part", "tie", "place"):
        frame = frame.withColumn(name, F.lit("x"))
    odd = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    found = merkle.audited(frame, odd, arity=arity)
    text = ["key", *[merkle.as_text(c).alias(c) for c in ("leaf", "subroot", "root")], "proof", merkle.as_text("folded_root").alias("folded_root"), "verified"]
    assert Counter(tuple(r) for r in found.select(*text).collect()) == manifest_by_hand(docs, arity)


@pytest.mark.parametrize("rows", [0, 1, 2])
def test_manifest_of_few_rows(spark, rows):
    docs = documents()[:rows]
    found = merkle.audited(spark.createDataFrame(docs, DOCS), F.lit(False)).collect()
    assert len(found) == rows and all(r.verified for r in found)
    if rows == 1:
        assert bytes(found[0].root).hex() == leaf_by_hand(docs[0]) and found[0].proof == hashed()


# --- URL filters


def pages():
    rng = random.Random(8)
    urls = [None, "", "no scheme/x", "HTTP://Example.ORG", "http://example.org?x=/es/", "http://a.b.example.org/es/1#f", "http://notexample.org/es/1", "ftp://exampleéORG.com/de/", "://x.com/fr/a",
            "http://u@h.com:80/de/x?y://z", "http://x.net/a/b/c/d/e/f", "http://x.net//a///b/", "http://example.org/en/1/é?", "http://com/fr/", "a\nb://x.com/fr/\n", "http://x.com/" + "long/" * 5000]
    for host in ("www.example.com", "m.Other.com", "shop.net", "docs.example.org"):
        for i in range(120):
            path = rng.choice([f"de/{i}", f"fr/{i}", f"es/{i}", f"en/{i}/", f"list/{rng.randrange(3)}/{i}", f"{i}"])
            urls.append(f"http://{host}/{path}{rng.choice(['', '?q=1', '#top', '/a/b/c/d'])}")
    # one host, one template shared by allowed, blocked and unlabelled paths only through the wildcard
    urls += [f"http://bad.com/de/{i}" for i in range(3)] + [f"http://bad.com/{i}" for i in range(400)] + ["http://bad.com/de/1"] * 4
    return [(i, u) for i, u in enumerate(urls)] + [(None, "http://x.com/de/1"), (2, "http://x.com/de/1")]


def written(folder, **tables):
    for name, (rows, schema) in tables.items():
        fields = [f.split() for f in schema.split(", ")]
        columns = [pa.array([r[i] for r in rows], TYPES[kind]) for i, (_, kind) in enumerate(fields)]
        pq.write_table(pa.table(columns, names=[n for n, _ in fields]), f"{folder}/{name}.parquet")
    connection = duckdb.connect()
    for name in tables:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle_manifest", "op13_url_filters"])
def test_queries_equal_their_sql_on_odd_rows(spark, tmp_path, name):
    unique = {r[0]: r for r in documents() if r[0] is not None}.values()  # SQL numbers equal rows as it likes; pandas shows no NULL in whole numbers
    named = [(*r, "<p>") for r in pages() if r[0] is not None]
    connection = written(tmp_path, documents=(list(unique), DOCS), labels=(labels(), LABELS), pages=(named, "page_id long, url string, html string"))
    mine, theirs = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), connection.execute(queries.ORACLE[name]).df()
    assert difference(mine, theirs) is None


def url_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_hosts_paths_and_rules_by_hand(spark):
    frame = spark.createDataFrame(pages(), "page_id long, url string").withColumns({c: F.lit("x") for c in ("key", "host", "path", "rule", "label", "segments", "template", "n", "branch")})
    found = Counter((r.key, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_filter.judged(frame, queries.URL_RULES).collect())
    want = Counter()
    for key, url in pages():
        host, path = url_by_hand(url)
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        want[key, host, path, best and best.text, best and best.verdict] += 1
    assert found == want


def test_urls_without_rows(spark):
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


def test_variable_segments_become_wildcards_and_constant_ones_stay(spark):
    rows = [(i, f"http://h.net/list/{i}") for i in range(40)] + [(100 + i, f"http://h.net/{'ab'[i % 2]}/p/{i}/x/y/z") for i in range(40)] + [(200, "http://h.net/rare")]
    found = {r.key: r.template for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), []).collect()}
    assert found[3] == "/=list/*" and found[100] == "/=a/=p/*/=x/**" and found[101] == "/=b/=p/*/=x/**" and found[200] == "/*"


def test_rejected_templates_reach_urls_without_a_rule(spark):
    """Paths of one template: most are blocked by rule, so the rest is blocked too; a mixed and an unlabelled one are not."""
    rules = [url_filter.Rule("block", "h.com", f"/{i}") for i in range(1, 10)] + [url_filter.Rule("allow", "h.com", "/mix/1"), url_filter.Rule("allow", "k.com", "/")]
    rules += [url_filter.Rule("block", "h.com", "/mix/2")]
    rows = [(i, f"http://h.com/{i}") for i in range(300)] + [(1000 + i, f"http://h.com/mix/{i}") for i in range(100)] + [(2000 + i, f"http://k.com/{i}") for i in range(300)] + [(3000 + i, f"http://n.com/{i}") for i in range(9)]
    found = {r.key: (r.rule, r.verdict) for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert found[0] == (None, "block") and found[1000] == (None, "allow") and found[3000] == (None, "allow") and found[2000] == ("k.com/", "allow")


def test_similar_branches_merge_and_different_ones_do_not(spark):
    counts = [("h", "/=a/*", 50, 48), ("h", "/=b/*", 40, 38), ("h", "/=c/*", 60, 3), ("h", "/=d/*", 2, 2), ("h", "/=e/*", 0, 0), ("i", "/=a/*", 50, 48), ("h", "", 9, 9)]
    found = url_filter.merged(spark.createDataFrame(counts, "host string, template string, labelled long, blocked long"))
    names = {(r.host, r.template): r.branch for r in found.collect()}
    assert names["h", "/=a/*"] == names["h", "/=b/*"] == "/~=b/*"
    assert all(names[k] == k[1] for k in [("h", "/=c/*"), ("h", "/=d/*"), ("h", "/=e/*"), ("i", "/=a/*"), ("h", "")])


def test_deduplicated_rows_keep_columns_of_any_name(spark):
    from tidegauge.llm import exact_dedup

    odd = ["digest", "other_key", "other", "points", "whole", "__digest", "__key", "stays", "KEEP_KEY"]
    rows = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "x"), (3, "x"), (4, None), (None, "")], "doc_id long, text string")
    rows = rows.withColumns({c: F.lit(f"my {c}") for c in odd})
    found = exact_dedup.deduplicate(rows)
    assert found.columns == rows.columns
    assert sorted((r.doc_id, r.text or "") for r in found.collect()) == [(1, "a b"), (3, "x"), (4, "")]
    assert all(r[c] == f"my {c}" for r in found.collect() for c in odd)
