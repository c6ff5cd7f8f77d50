"""WARC bundles, tool calls, vectors and components against brute force."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
import zstandard
from pyspark.sql import functions as F
from tidegauge.llm import graph, queries, tool_calls, vectors, warc
from tidegauge.llm.common import saved

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def rows():
    big = "<p>" + "é" * 100
    return [(1, "http://a/é?\r\nX: y", big), (2, "http://b", big), (3, None, big), (5, "u", ""), (6, "u", None), (7, "u", "short"),
            (8, "u", "short"), (9, "u", "z" * 300_000), (9, "u", "z" * 300_000), (None, "u", big), (None, None, None), (11, "u", "w\r\n\r\nWARC/1.1\r\n" * 20)]


def test_archives_round_trip(spark, rows):
    pages = spark.createDataFrame(rows, PAGES).repartition(2)
    index = warc.write_archives(warc.plan_records(pages), frame_bytes=2000, bundle_bytes=4000)
    got = Counter()
    for r in warc.read_archives(index).collect():
        got[r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload)] += 1
    want, first = Counter(), {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    for key, _, html in rows:
        body = (html or "").encode()
        head = first.get(html or "")
        again = len(body) >= 100 and head is not None and key != head
        want[key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", head if again else None, None if again else body] += 1
    assert {k[:5]: n for k, n in got.items()} == {k[:5]: n for k, n in want.items()}
    assert {k[5] or b"" for k in got} == {k[5] or b"" for k in want}
    assert index.count() == len(rows)


def test_records_are_fetched_by_offset(spark, rows):
    pages = spark.createDataFrame([r for r in rows if r[0] is not None], PAGES)
    index = warc.write_archives(warc.plan_records(pages), frame_bytes=500)
    found = warc.fetch_records(index, spark.createDataFrame([(2,), (7,), (99,)], "page_id long")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found) == [(2, "revisit", 1), (7, "response", None)]


def test_bundles_are_seekable_zstandard(spark, rows):
    index = warc.write_archives(warc.plan_records(spark.createDataFrame(rows, PAGES).coalesce(1)), frame_bytes=500)
    for (path,) in index.select("bundle").distinct().collect():
        system, place = warc.opened(path)
        with system.open_input_file(place) as file:
            frames = warc.seek_table(file)
            file.seek(0)
            data = file.read()
        assert isinstance(system, pafs.LocalFileSystem)
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert len(whole) == sum(size for _, size in frames)


def test_no_pages(spark):
    index = warc.write_archives(warc.plan_records(spark.createDataFrame([], PAGES)))
    assert index.count() == 0 and warc.read_archives(index).count() == 0


# --- tool calls

CALLS = "conv long, call string, position long, name string, arguments string, needs array<string>"
RESULTS = "conv long, call string, position long, content string"
SCHEMAS = "tool string, field string, type string, required boolean"
TOOLS = [("t", "a", "integer", True), ("t", "b", "number", False), ("t", "c", "array", False), ("t", "d", "boolean", False)]


def linked(spark, calls, results):
    frames = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(TOOLS, SCHEMAS)
    return tool_calls.link(*frames).collect()


def test_links_order_and_status(spark):
    calls = [(1, "c", 0, "t", "{}", ["b"]), (1, "b", 1, "t", "{}", ["a", "gone"]), (1, "a", 2, "t", "{}", None), (1, "a", 5, "t", "{}", []),
             (2, "a", 0, "t", "{}", ["b"]), (2, "b", 1, "t", "{}", ["a"]), (2, "x", 2, "t", "{}", ["a"]), (2, "y", 3, "t", "{}", ["y"]),
             (None, "a", 0, "t", "{}", None), (3, None, 0, "t", "{}", None), (2, "ok", 4, "t", "{}", []), (4, "d", 0, "t", "{}", []), (4, "d", 0, "t", "{}", [])]
    results = [(1, "a", 9, "r"), (1, "a", 10, "again"), (2, "zz", 3, None), (2, "a", 8, "")]
    rows = linked(spark, calls, results)
    got = Counter((r.conv, r.kind, r.call, r.position, r.step, r.status) for r in rows)
    assert got == Counter({
        (1, "call", "c", 0, 4, "pending"): 1, (1, "call", "b", 1, 2, "pending"): 1, (1, "call", "a", 2, 0, "linked"): 1,
        (1, "call", "a", 5, None, "duplicate"): 1, (2, "call", "a", 0, None, "cyclic"): 1, (2, "call", "b", 1, None, "cyclic"): 1,
        (2, "call", "x", 2, None, "cyclic"): 1, (2, "call", "y", 3, None, "cyclic"): 1, (2, "call", "ok", 4, 0, "pending"): 1,
        (None, "call", "a", 0, None, "pending"): 1, (3, "call", None, 0, None, "pending"): 1, (4, "call", "d", 0, 0, "pending"): 1,
        (4, "call", "d", 0, None, "duplicate"): 1, (1, "result", "a", 9, 1, "linked"): 1, (1, "result", "a", 10, None, "duplicate"): 1,
        (2, "result", "zz", 3, None, "orphan"): 1, (2, "result", "a", 8, None, "cyclic"): 1,
    })
    assert next(r.errors for r in rows if r.call == "b" and r.conv == 1) == ["missing:a", "needs:gone"]


def test_arguments_and_canonical_json(spark):
    texts = ['{"b": 1.50, "a": 2, "c": [1, {"z": 0, "y": null}], "d": true}', '{"a":"x","zz":1}', "[1]", "{bad", None, '{"b":1,"a":1,"d":0}', '{"a":1,"b":"\\u00e9\\n\\""}']
    calls = [(1, f"k{k}", k, "t", text, []) for k, text in enumerate(texts)] + [(1, "other", 9, "unknown", "{}", [])]
    rows = {r.call: r for r in linked(spark, calls, [])}
    errors = [rows[f"k{k}"].errors for k in range(len(texts))]
    assert errors == [[], ["type:a", "unknown:zz"], ["json"], ["json"], ["json"], ["type:d"], ["type:b"]]
    assert rows["other"].errors == ["tool"]
    assert rows["k0"].message == '{"arguments":{"a":2,"b":1.5,"c":[1,{"y":null,"z":0}],"d":true},"id":"k0","name":"t","type":"call"}'
    for r in rows.values():
        assert r.message == json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_levels_of_random_graphs(spark):
    rnd = random.Random(7)
    calls = [(1, f"n{k}") for k in range(60)] + [(2, f"n{k}") for k in range(300)]
    needs = {(1, f"n{k}", f"n{rnd.randrange(k)}") for k in range(1, 60) for _ in range(3)} | {(2, f"n{k}", f"n{k - 1}") for k in range(1, 300)}
    want = {}
    for conv, call in calls:
        want[conv, call] = max((want[conv, n] + 1 for c, x, n in needs if (c, x) == (conv, call)), default=0)
    frames = spark.createDataFrame(calls, "conv long, call string"), spark.createDataFrame(sorted(needs), "conv long, call string, need string")
    rows = tool_calls.levels(*frames).collect()
    assert {(r.conv, r.call): r.level for r in rows} == want and not any(r.cyclic for r in rows)


GRAPHS = {
    "chain": lambda k: [k - 1],
    "two before": lambda k: [k - 1, k - 2],
    "three before, named backwards": lambda k: [k - 1, k - 2, k - 3],
    "layers of two": lambda k: [k // 2 * 2 - 1, k // 2 * 2 - 2],
}


def test_levels_take_logarithmic_rounds(spark, monkeypatch):
    calls, needs, want, rounds = [], [], {}, []
    for conv, (shape, below) in enumerate(GRAPHS.items()):
        name = (lambda k: f"n{99 - k}") if "backwards" in shape else (lambda k: f"n{10 + k}")
        for k in range(64):
            calls.append((conv, name(k)))
            needs += [(conv, name(k), name(n)) for n in below(k) if n >= 0]
            want[conv, name(k)] = max((want[conv, name(n)] + 1 for n in below(k) if n >= 0), default=0)
    monkeypatch.setattr(tool_calls, "saved", lambda df, table: rounds.append(table) or saved(df, table))
    frames = spark.createDataFrame(calls, "conv long, call string"), spark.createDataFrame(needs, "conv long, call string, need string")
    rows = tool_calls.levels(*frames).collect()
    assert {(r.conv, r.call): r.level for r in rows} == want and not any(r.cyclic for r in rows)
    assert rounds.count("met") <= 10


def test_levels_with_cycles(spark):
    """Calls on or behind a cycle are cyclic, the others have their level, however dependencies shorten each other."""
    rnd = random.Random(17)
    calls, needs = [], set()
    for conv in range(12):
        names = [f"n{k}" for k in range(14)]
        calls += [(conv, n) for n in names]
        needs |= {(conv, rnd.choice(names), rnd.choice(names)) for _ in range(rnd.randrange(5, 26))}
    below = {c: {(c[0], n) for conv, call, n in needs if (conv, call) == c} for c in calls}
    want, changed = {}, True
    while changed:
        ready = [c for c in calls if c not in want and all(n in want for n in below[c])]
        want |= {c: max((want[n] + 1 for n in below[c]), default=0) for c in ready}
        changed = bool(ready)
    frames = spark.createDataFrame(calls, "conv long, call string"), spark.createDataFrame(sorted(needs), "conv long, call string, need string")
    rows = tool_calls.levels(*frames).collect()
    assert len(rows) == len(calls) and {(r.conv, r.call): r.level for r in rows if not r.cyclic} == want


def test_calls_with_columns_of_any_name(spark):
    calls = [(1, "a", 0, "t", '{"a":1}', []), (1, "b", 1, "t", '{"a":1}', ["a"])]
    plain = linked(spark, calls, [(1, "a", 2, "r")])
    frames = [spark.createDataFrame(calls, CALLS), spark.createDataFrame([(1, "a", 2, "r")], RESULTS), spark.createDataFrame(TOOLS, SCHEMAS)]
    for extra in ("level", "cyclic", "n", "w", "need", "next", "known", "lost", "errors", "c", "r", "__tool", "__args", "__k"):
        frames = [f.withColumn(extra, F.lit("x")) for f in frames]
    assert sorted(map(str, tool_calls.link(*frames).collect())) == sorted(map(str, plain))


def test_no_calls(spark):
    assert linked(spark, [], []) == []


# --- vectors


def test_vectors_equal_brute_force(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 16))
    x[100:160] = x[100] + 0.03 * rnd.normal(size=(60, 16))
    x[160:200] = x[160:200] * 0 + x[7]
    x[200] = x[9] * 1e-30
    rows = [(k, [float(np.float32(v)) for v in row]) for k, row in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [1.0]), (305, []), (None, rows[7][1]), (7, rows[7][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = Counter((r.key, r.n_links, r.group) for r in vectors.near_vectors(frame).collect())
    use = [(k, np.array(v, np.float32).astype(float)) for k, v in rows if k is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    keys, m = [k for k, _ in use], np.stack([v / np.abs(v).max() for _, v in use])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.95
    reach = near.copy()
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    want = Counter((k, int(n.sum()) - 1, min(np.array(keys)[r])) for k, n, r in zip(keys, near, reach))
    used = Counter(keys)
    for k, _ in rows:
        if used[k] > 0:
            used[k] -= 1
        else:
            want[k, 0, k] += 1
    assert got == want


def test_vectors_of_every_length_link(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    rows = [(k, rnd.normal(size=8).tolist()) for k in range(40)]
    rows += [(100 + k, [float(k + 1), 2.0 * k + 2, 0.0, 0.0]) for k in range(10)]
    rows += [(200 + k, (rows[0][1] + [0.0])[:9]) for k in range(2)] + [(300, [5.0]), (301, [2.0]), (302, [-1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for sample in (vectors.SAMPLE, 5):  # the rarer lengths in a cell of their own, and in an index of their own
        monkeypatch.setattr(vectors, "SAMPLE", sample)
        got = {r.key: (r.n_links, r.group) for r in vectors.near_vectors(frame).collect()}
        assert len(got) == len(rows)
        assert all(got[100 + k] == (9, 100) for k in range(10))
        assert got[200] == got[201] == (1, 200)
        assert got[300] == got[301] == (1, 300) and got[302] == (0, 302)


def test_traversal_is_in_order_of_the_sum():
    rnd = np.random.default_rng(2)
    a, b = rnd.random((20, 6)), rnd.random((20, 6))
    sums = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    assert (vectors.traversal(a, b, 9) == np.argsort(sums, axis=1)[:, :9]).all()


def test_vector_recall_on_the_given_table(spark):
    frame = queries.table(spark, "/root/testdata/sf0.1", "embeddings")
    noise = frame.select((F.col("vec_id") + 10_000_000).alias("vec_id"), F.transform("embedding", lambda x, k: x + F.lit(0.03) * F.sin(k * 1.0 + F.col("vec_id"))).alias("embedding"))
    both = frame.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(noise).collect()
    ids, x = np.array([r.vec_id for r in both]), np.array([r.embedding for r in both])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    found = {r.key: r.n_links for r in vectors.near_vectors(spark.createDataFrame(both)).collect()}
    got = np.array([found[k] for k in ids.tolist()])
    assert want.sum() > 1000 and (got <= want).all() and got.sum() >= 0.97 * want.sum()


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- components


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(300)] + [(5000, 6000 + k) for k in range(50)]
    group = {}
    for a, b in links:
        for x in (a, b):
            group.setdefault(x, x)
        low, high = sorted((group[a], group[b]))
        group = {k: low if g == high else g for k, g in group.items()}
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r.node: r.root for r in graph.components(frame).collect()}
    assert {k: got.get(k, k) for k in group} == group
    assert graph.components(frame.where("a < 0")).count() == 0
