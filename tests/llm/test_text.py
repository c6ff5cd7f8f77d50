"""Operators on texts against brute force and public libraries, on small tables with every odd case."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from compare import canonical, connect
from pyspark.sql import functions as F
from tidegauge.llm import bpe, exact_dedup, language_id, packing, passages, queries, simhash, suffixes
from tokenizers import Tokenizer

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t ", "a", "x" * 5000, "é" * 700, "a  b", " \x1c\x1f a", "<|endoftext|> b", "日本語 🎉", "it's we'll"]


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(5)
    return ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]


@pytest.fixture(scope="module")
def corpus(words):
    """Odd texts, long ones, copies, near copies, shared passages, repeated rows and null keys."""
    rnd = random.Random(6)
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = prose(70)
    base = prose(300)
    near = base.split()
    near[150] = "changed"
    bodies = [*ODD, base, base, base.replace(" ", "  "), " ".join(near), prose(20000), passage]
    bodies += [f"{prose(90)} {passage} {prose(40)}" for _ in range(4)] + [prose(120) for _ in range(12)]
    bodies += ["la " * 300, "la " * 260 + "lo " * 200]
    rows = [(k, body, "en" if k % 2 else "de", "s", len(body or "")) for k, body in enumerate(bodies)]
    rows += [(13, base, "en", "s", 1), (13, base, "en", "s", 1), (None, base, None, None, None), (None, None, None, None, None), (3, "another text", "en", "t", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- byte-level BPE


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_library_on_random_texts():
    coder, exact = bpe.coder(RANKS, public_tokenizers.PATTERN), library()
    rnd = random.Random(1)
    for _ in range(2000):
        text = "".join(rnd.choice("ab \n'sé1٣日\t\xa0!the ing") for _ in range(rnd.randrange(60)))
        ids = np.frombuffer(coder.encode(text), np.int32)
        assert ids.tolist() == exact.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_bpe_table(docs, corpus, empty):
    exact = library()
    rows = bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows)
    assert got == Counter((k, tuple(exact.encode_ordinary(t or "")), (t or "").encode()) for k, t, *_ in corpus)
    assert bpe.encode_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="exist"):
        bpe.encode_decode(docs.withColumn("ids", F.lit(1)), RANKS, public_tokenizers.PATTERN)


# --- exact dedup


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("support", [0.001, 0.3])
def test_exact_groups(docs, corpus, support):
    groups = {}
    for key, text, *_ in corpus:
        groups.setdefault(plain(text), []).append((-len(text or ""), key is None, key or 0))
    rows = exact_dedup.exact_groups(docs, support=support).collect()
    assert len(rows) == len(corpus)
    stays = Counter()
    for row in rows:
        text = next(t for t in groups if hashlib.sha256(t.encode()).digest() == bytes(row.digest))
        _, null, key = min(groups[text])
        assert (row.keep_key, row.group_size) == (None if null else key, len(groups[text]))
        stays[text] += row.kept
    assert set(stays.values()) == {1}


def test_deduplicate_keeps_columns_and_one_of_each(docs, corpus, empty):
    rows = exact_dedup.deduplicate(docs).collect()
    assert Counter(plain(r.text) for r in rows) == Counter({plain(t): 1 for _, t, *_ in corpus})
    assert exact_dedup.deduplicate(docs).columns == docs.columns
    assert exact_dedup.deduplicate(empty).count() == 0


# --- SimHash


def slow_print(text):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[k : k + 3]) for k in range(len(tokens) - 2)] or [b" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs, corpus, empty):
    prints = [slow_print(t) for _, t, *_ in corpus]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(len(prints)):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group = [group[a] if g == group[b] else g for g in group]
    least = {}
    for (key, *_), g in zip(corpus, group):
        if key is not None:
            least[g] = min(key, least.get(g, key))
    want = Counter((key, p, least.get(g)) for (key, *_), p, g in zip(corpus, prints, group))
    got = Counter((r.key, r["print"] % (1 << 64), r.group) for r in simhash.simhash_groups(docs).collect())
    assert got == want
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_ball_hashing_finds_all_links(spark, radius):
    rnd = random.Random(radius)
    centers = [rnd.getrandbits(64) for _ in range(30)]
    values = set(centers)
    for c in centers:
        for _ in range(6):
            x = c
            for bit in rnd.sample(range(64), rnd.randrange(1, 6)):
                x ^= 1 << bit
            values.add(x)
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "print long").repartition(3)
    parts = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(frame, radius, 6)).collect()}
    group = {v: v for v in values}
    for a in values:
        for b in values:
            if group[a] != group[b] and (a ^ b).bit_count() <= radius:
                old, new = group[b], group[a]
                group = {k: new if g == old else g for k, g in group.items()}
    classes = lambda names: sorted(tuple(sorted(v for v in values if names[v] == n)) for n in set(names.values()))
    assert classes({v: parts.get(v, ("alone", v)) for v in values}) == classes(group)


def test_bucket_slices_lose_nothing(monkeypatch, spark):
    rnd = random.Random(9)
    base = rnd.getrandbits(64)
    values = [base ^ (1 << a) ^ (1 << b) for a in range(0, 60, 3) for b in range(1, 60, 7)]
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in set(values)], "print long").coalesce(1)
    monkeypatch.setattr(simhash, "SLICE", 1000)
    roots = {r.root for r in simhash.components(simhash.links(frame, 3, 6)).collect()}
    assert len(roots) == 1


# --- language identification


def test_language_held_out_accuracy(spark, sf_dir):
    rows = queries.op4_language_id(spark, sf_dir).join(queries.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").collect()
    assert len(held) > 20
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.collect())


def test_language_odd_cases(docs, corpus, empty):
    model = language_id.train(docs.where("lang is not null"))
    rows = language_id.predict(docs, model).collect()
    assert len(rows) == len(corpus)
    lettered = Counter((k, any(c.isalpha() for c in t or "")) for k, t, *_ in corpus)
    assert Counter((r.key, r.language != "und") for r in rows) == lettered
    nothing = language_id.train(empty)
    assert {r.language for r in language_id.predict(docs, nothing).collect()} == {"und"}
    one = language_id.train(docs.where("lang = 'en'"))
    assert {r.language for r in language_id.predict(docs, one).collect()} == {"und", "en"}
    assert language_id.predict(empty, model).count() == 0


@pytest.mark.parametrize("languages", [2, 4, 5, 12, 40])
def test_codewords_differ(languages):
    code = language_id.codewords(languages).astype(int)
    dots = code @ code.T
    assert (dots[~np.eye(languages, dtype=bool)] < code.shape[1]).all()
    assert (np.abs(code.sum(axis=0)) < languages).all()


# --- packing


def test_packing(docs, corpus, empty):
    tokenizer = Tokenizer.from_file(JSON)
    pieces = packing.pack(docs, JSON).collect()
    want = Counter((k, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for k, t, *_ in corpus)
    sequences, whole = {}, {}
    for r in pieces:
        assert len(r.ids) == 4 * r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for r in sorted(pieces, key=lambda r: (r.key is None, r.key or 0, r.doc_tokens, r.start)):
        whole.setdefault((r.key, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for (key, tokens), parts in whole.items():
        copies = sum(n for (k, ids), n in want.items() if (k, len(ids) // 4) == (key, tokens))
        assert sum(len(ids) for _, ids in parts) == 4 * tokens * copies
        if copies == 1:
            assert want[key, b"".join(ids for _, ids in sorted(parts))] == 1
    assert packing.pack(empty, JSON).count() == 0


def test_balance_wastes_less_than_a_sequence():
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(1, 1024, 3000)
    pieces = packing.balance(lengths, 1024)
    assert sum(p[2] for p in pieces) == lengths.sum()
    assert len({p[3] for p in pieces}) == -(-lengths.sum() // 1024)


# --- repeated byte strings


def slow_repeats(bodies, length):
    counts = Counter(hash(b[k : k + length]) for b in bodies for k in range(len(b) - length + 1))
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if counts[hash(b[k : k + length])] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)


@pytest.mark.parametrize(("wide", "wide_bytes"), [(2000, suffixes.WIDE_BYTES), (2, 1000), (2, 1)])
def test_repeats(docs, corpus, empty, monkeypatch, wide, wide_bytes):
    monkeypatch.setattr(suffixes, "WIDE", wide)
    monkeypatch.setattr(suffixes, "WIDE_BYTES", wide_bytes)
    want = Counter(zip([r[0] for r in corpus], slow_repeats([(r[1] or "").encode() for r in corpus], 400)))
    rows = suffixes.remove_repeats(docs).collect()
    assert Counter((r.key, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in rows) == want
    assert suffixes.remove_repeats(empty).count() == 0


def test_repeats_with_anchors_beyond_the_shipped_limit(spark):
    """A passage around which every text differs: its anchors have more bytes than one suffix array may hold."""
    rnd = random.Random(31)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    passage = noise(430)
    bodies = [noise(250) + passage + noise(250) for _ in range(2500)] + [noise(900)]
    frame = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").repartition(5)
    entries = suffixes.entries(suffixes.keyed(frame).select("k1", "k2", "text"), 400)
    assert entries.groupBy("a").agg(F.sum(F.col("n") + 399).alias("b")).where(F.col("b") > suffixes.WIDE_BYTES).count()
    want = Counter(zip(range(len(bodies)), slow_repeats([b.encode() for b in bodies], 400)))
    rows = suffixes.remove_repeats(frame).collect()
    assert Counter((r.key, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in rows) == want


def test_common_prefixes():
    rnd = random.Random(3)
    for length, step in ((20, 50), (20, 7), (21, 7), (400, 50)):
        text = bytes(rnd.choice(b"ab") for _ in range(200)) * 4
        starts = np.array(rnd.sample(range(len(text) - length + 1), 150))
        order = np.array(suffixes.suffix_order(text, starts, length))
        pairs = [(text[i : i + length], text[j : j + length]) for i, j in zip(order, order[1:])]
        want = [next((k for k in range(length) if x[k] != y[k]), length) for x, y in pairs]
        assert suffixes.common_prefixes(text, order, length, step).tolist() == want


def test_suffix_order_is_sorted():
    rnd = random.Random(2)
    for _ in range(60):
        text = bytes(rnd.choice(b"aab") for _ in range(rnd.randrange(20, 300)))
        places = len(text) - 19
        starts = np.array(sorted(rnd.sample(range(places), rnd.randrange(1, places + 1))))
        order = suffixes.suffix_order(text, starts, 20)
        keys = [text[k : k + 20] for k in order]
        assert sorted(order) == starts.tolist() and keys == sorted(keys)


def test_similar_texts_are_told_apart_by_text_where_ids_repeat(spark):
    """Ids repeat with other texts: only the near copy under the id goes, and near texts under one id are one."""
    import corpus_pipeline

    rnd = random.Random(21)
    one, other, third = (" ".join(fresh(rnd, 300)) for _ in range(3))
    rows = [(1, one), (2, one + " "), (2, other), (3, third), (3, third + " "), (None, one + "  ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text.rstrip(" ")) for r in corpus_pipeline.one_of_similar(spark, frame, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, one), (2, other), (3, third), (None, one)], key=str)


# --- fuzzy passages


def test_passages_of_copies_near_copies_and_shared_text(docs, corpus, empty, words):
    rows = passages.fuzzy_passages(docs).collect()
    text = {k: (t or "").lower().split() for k, t, *_ in corpus if k not in (3, None)}
    assert all(r.stop - r.start >= 50 and 0.8 <= r.similarity <= 1 for r in rows)
    base = [12, 13, 14, 15]  # copies, white space changed, one word changed
    assert len({r.key for r in rows if r.key in base}) == 3
    shared = range(17, 22)
    assert len({r.key for r in rows if r.key in shared and r.stop - r.start >= 65}) == 4
    clean = range(22, 34)
    assert not [r for r in rows if r.key in clean or r.key == 16]
    for r in rows:
        if r.similarity == 1 and r.key in text and r.other in text:
            assert text[r.key][r.start : r.stop] == text[r.other][r.other_start : r.other_stop]
    assert passages.fuzzy_passages(empty).count() == 0


def test_passages_are_removed_once(docs, corpus):
    cleaned = passages.remove_passages(docs)
    assert cleaned.columns == docs.columns
    rows = cleaned.collect()
    passage = corpus[17][1].split()
    holders = [r for r in rows if " ".join(passage[10:60]) in " ".join((r.text or "").split())]
    assert len(holders) == 1
    kept = {r.doc_id: r.text for r in rows}
    assert all(kept[k] == corpus[k][1] for k in [*range(12), 16, *range(22, 34)] if k != 3)


def test_fuzzy_match_survives_edits(spark, words):
    rnd = random.Random(8)
    passage = [rnd.choice(words) for _ in range(200)]
    edited = list(passage)
    for k in range(9, 200, 20):
        edited[k] = "edit"
    del edited[100]
    frame = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(edited))], "doc_id long, text string")
    (row,) = passages.fuzzy_passages(frame).collect()
    assert row.similarity >= 0.9 and row.stop - row.start >= 180


def fresh(rnd: random.Random, n: int) -> list[str]:
    return [f"w{rnd.randrange(10**9)}" for _ in range(n)]


@pytest.mark.parametrize("apart", [False, True])
def test_a_passage_is_found_whose_parts_stand_in_other_texts(spark, apart):
    """A and D hold P and Q, B only P, C only Q; in the order of text hashes A comes first and D last."""
    rnd, rows = random.Random(12), []
    for case in range(12):
        p, q = fresh(rnd, 30), fresh(rnd, 30)
        while True:
            texts = [" ".join(fresh(rnd, 40) + part + fresh(rnd, 40)) for part in (p + q, p, q, p + q)]
            a, b, c, d = (np.int64(np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).view(np.int64)) for x in texts)
            if a < min(b, c) and d > max(b, c):
                break
        rows += [(4 * case + k, x) for k, x in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = frame.repartition(48, "doc_id") if apart else frame.coalesce(1)
    found = passages.fuzzy_passages(frame).collect()
    pairs = {(r.key, r.other): r for r in found}
    assert set(pairs) == {(4 * case + 3, 4 * case) for case in range(12)}
    assert all((r.start, r.stop, r.other_start, r.other_stop, r.similarity) == (40, 100, 40, 100, 1) for r in found)
    kept = {r.doc_id: r.text.split() for r in passages.remove_passages(frame).collect()}
    assert all(len(kept[4 * case]) == 140 and len(kept[4 * case + 3]) == 80 for case in range(12))


def test_runs_link_to_the_first_text_that_has_them_as_brute_force_does(spark):
    """Over few words, so that runs repeat within texts too: every repeated run of a later text lies in its passages."""
    rnd, pool = random.Random(3), [[f"{chr(97 + k)}{n}" for n in range(30)] for k in range(6)]
    texts = [" ".join(w for _ in range(6) for w in rnd.choice(pool)) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    covered = {}
    for r in passages.fuzzy_passages(frame).collect():
        covered.setdefault(r.key, set()).update(range(r.start, r.stop))
    key = {k: np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).view(np.int64) for k, x in enumerate(texts)}
    seen = {}
    for k in sorted(key, key=key.get):
        words = texts[k].split()
        for s in range(len(words) - passages.MIN_WORDS + 1):
            run = tuple(words[s : s + passages.MIN_WORDS])
            if seen.setdefault(run, k) != k:
                assert covered[k] >= set(range(s, s + passages.MIN_WORDS))


def test_no_passage_with_an_edit_every_few_words_is_lost(spark):
    """60 words with one changed word in 6, 7 or 8, among other words, against the equal words counted directly."""
    rnd, rows, similar = random.Random(5), [], set()
    for every in (6, 7, 8):
        for _ in range(40):
            passage = fresh(rnd, 60)
            edited = [w if (k + 1) % every else "edit" + w for k, w in enumerate(passage)]
            equal = [k for k in range(60) if passage[k] == edited[k]]
            size = equal[-1] - equal[0] + 1
            assert size >= passages.MIN_WORDS and len(equal) / size >= passages.SIMILARITY
            similar.add((len(rows), len(rows) + 1))
            rows += [(len(rows) + k, " ".join(fresh(rnd, 50) + x + fresh(rnd, 50))) for k, x in enumerate((passage, edited))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.fuzzy_passages(frame).collect()
    assert {tuple(sorted((r.key, r.other))) for r in found} == similar
    assert all(r.start == 50 and r.stop >= 100 and r.similarity >= passages.SIMILARITY for r in found)


def test_chains_ascend_in_both_texts():
    rnd = np.random.default_rng(4)
    p, q = np.sort(rnd.integers(0, 300, 200)), rnd.integers(0, 300, 200)
    seen = []
    for chain in passages.chains(p, q):
        assert (np.diff(p[chain]) > 0).all() and (np.diff(q[chain]) > 0).all()
        seen += chain
    assert len(seen) == len(set(seen))


def test_chains_on_one_diagonal_equal_the_general_ones():
    rnd = np.random.default_rng(5)
    for _ in range(400):
        count, slope = rnd.integers(1, 6), int(rnd.integers(0, 20))
        p, n = np.sort(rnd.integers(0, 90, count)), rnd.integers(1, 20, count).astype(np.int32)
        at_p, at_q = passages.places(p, p + slope, n)
        want = sorted((at_p[c].tolist(), at_q[c].tolist()) for c in passages.chains(at_p, at_q))
        pairs, first, last, some_p, some_q = passages._single_chains(np.zeros(count, np.int64), p, p + slope, n)
        if len(pairs):  # else places are too far apart, and the general way is taken
            found = (some_p[first[0] : last[0]].tolist(), some_q[first[0] : last[0]].tolist())
            assert want == ([found] if last[0] - first[0] >= passages.MIN_MATCHES else [])


# --- whole queries


def test_text_queries_on_odd_rows(spark, docs, corpus, tmp_path):
    """The columns of the queries that no SQL expresses, against libraries and brute force."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bodies = [(r[0], r[1] or "") for r in corpus]
    hexed = lambda data: hashlib.sha256(data).hexdigest()
    encoding, tokens = library(), Tokenizer.from_file(JSON)

    want = Counter()
    for key, body in bodies:
        ids = encoding.encode_ordinary(body)
        want[key, len(ids), hexed(" ".join(map(str, ids)).encode()), hexed(body.encode())] += 1
    assert Counter(map(tuple, queries.op1_byte_bpe(spark, str(tmp_path)).collect())) == want

    prints = Counter((r.doc_id, r.fingerprint) for r in queries.op3_simhash(spark, str(tmp_path)).collect())
    assert prints == Counter((key, f"{slow_print(body):016x}") for key, body in bodies)

    pieces = queries.op7_packing(spark, str(tmp_path)).collect()
    cut = Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)
    coded = [(key, [*tokens.encode(body, add_special_tokens=False).ids, 0]) for key, body in bodies]
    assert cut == Counter((key, len(ids)) for key, ids in coded)
    once = {key: ids for key, ids in coded if sum(key == other for other, _ in coded) == 1}
    for r in (r for r in pieces if r.doc_id in once):
        assert r.ids_crc32 == zlib.crc32(np.array(once[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert all(r.offset + r.length <= 1024 for r in pieces)

    want = Counter((key, *row[:3], hexed(row[3])) for (key, _), row in zip(bodies, slow_repeats([b.encode() for _, b in bodies], 400)))
    assert Counter(map(tuple, queries.op9_repeats(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    mine = canonical(queries.QUERIES[name](spark, sf_dir).toPandas().convert_dtypes())
    theirs = canonical(connect(sf_dir).execute(queries.ORACLE[name]).df().convert_dtypes())
    assert mine.equals(theirs)


def windows(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def test_pipeline_decisions_equal_brute_force(spark, sf_dir):
    import corpus_pipeline

    stages, frame = dict(corpus_pipeline.STAGES), queries.table(spark, sf_dir, "documents")

    def after(name):
        found = corpus_pipeline.saved(stages[name](spark, frame, sf_dir), f"brute-{name}")
        return found, {r.doc_id: r.text for r in found.collect()}

    model = language_id.train(frame.where("lang is not null"))
    known = {r.key for r in language_id.predict(frame, model).collect() if not r.ambiguous and r.language != language_id.UNKNOWN}
    frame, texts = after("language")
    assert set(texts) == known

    groups = {}
    for key, text in texts.items():
        groups.setdefault(plain(text), []).append((-len(text or ""), key))
    frame, texts = after("exact_dedup")
    assert set(texts) == {min(g)[1] for g in groups.values()}

    prints = {key: slow_print(text) for key, text in texts.items()}
    group = {key: key for key in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if group[a] != group[b] and (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    frame, texts = after("simhash")
    assert set(texts) == {key for key, low in group.items() if key == low}

    seeds = Counter(w for text in texts.values() for w in windows(text, passages.SEED_WORDS))
    apart = {key: text for key, text in texts.items() if all(seeds[w] == 1 for w in windows(text, passages.SEED_WORDS))}
    frame, texts = after("passages")
    assert apart and all(texts[key] == text for key, text in apart.items())
    runs = Counter(w for text in texts.values() for w in windows(text, passages.MIN_WORDS))
    assert not [w for w, n in runs.items() if n > 1]

    tokenizer, pieces = Tokenizer.from_file(JSON), {}
    for r in stages["packing"](spark, frame, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(texts)
    for key, parts in pieces.items():
        ids = np.array([*tokenizer.encode(texts[key] or "", add_special_tokens=False).ids, 0], "<u4")
        assert sum(length for _, length, _ in parts) == len(ids)
        assert all(zlib.crc32(ids[start : start + length].tobytes()) == crc for start, length, crc in parts)


CLASHING = ["key", "t", "u", "h", "h1", "low", "n", "print", "group", "root", "node", "digest", "words", "start", "stop", "cuts", "language"]


def test_pipeline_stages_on_odd_tables(spark, docs, corpus, empty, sf_dir):
    """Nulls, repeated rows, empty tables and extra columns with names that the operators use themselves."""
    import corpus_pipeline

    extra = docs.withColumns({c: F.lit("x") for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf_dir).count() == 0
        found = stage(spark, extra, sf_dir)
        assert found.columns == extra.columns
        rows = found.collect()
        assert 0 < len(rows) <= len(corpus) and all(r["key"] == "x" for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, extra, sf_dir).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in corpus}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = frame.columns, {r.doc_id for r in frame.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.saved(stage(spark, frame, sf_dir), name)
        assert frame.columns == columns
        now = {r.doc_id for r in frame.collect()}
        assert now <= ids and len(now) > 0.6 * len(ids)
        ids = now
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert len({plain(t) for t in texts.values()}) == len(texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).collect()
    assert {r.doc_id for r in pieces} == ids
    totals = Counter()
    for r in pieces:
        totals[r.doc_id] += r.length
    assert all(totals[r.doc_id] == r.doc_tokens for r in pieces)
