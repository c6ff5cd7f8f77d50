"""Exact removal of repeated byte strings, by suffix arrays in two stages.

A string of ``length`` bytes that starts in two places has the same anchor in both: the leftmost smallest hash of its
``GRAM``-byte strings. Consecutive starts with one anchor form a segment. Segments with equal bytes are settled by their
digests alone, in the task where they are found and again after a shuffle of digests; of the others, one for each
content goes, with its bytes, to the task of its anchor. There a suffix array is built in two stages: suffixes smaller
than their successor are sorted directly, the rest follow from one scan over the buckets, and neighbours whose common
prefix has ``length`` bytes are the repeated strings. An anchor whose segments have more than ``WIDE_BYTES`` is divided
first: equal strings start equally far before it, so its segments are cut where that distance passes multiples of a block,
and the parts in a block are grouped by the bytes that all their strings hold. Blocks get shorter until the groups fit; in
blocks of one start the parts of a group are equal, and one is left of them.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; strings repeated within one text count;
repeated rows (equal key and text) are texts of their own; null keys are texts like any other; the bytes that stay need
not be valid UTF-8, as strings are judged by bytes; very long texts are worked on in slices of ``CHUNK`` starts; an empty
table gives no rows; columns beside key and text are not carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import joined_bytes, mapped, saved, slabs, small, tally

LENGTH = 400
GRAM = 48
#: Segments, without bytes, up to which an anchor's are looked at in one task; more are spread by content.
WIDE = 50_000
#: Bytes of an anchor's segments up to which they share one suffix array, and starts in a block of those divided.
WIDE_BYTES, BLOCKS = 1 << 20, (32, 4, 1)
#: Bytes of text worked on at once: for anchors, and for one suffix array.
CHUNK, ARRAY = 1 << 21, 1 << 18

_TABLE = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``size`` bytes at each place, by doubling."""
    part, width, power = _TABLE[data], 1, _BASE
    total, covered = None, 0
    left = size
    while left:
        if left & 1:
            if total is None:
                total = part
            else:
                n = len(data) - covered - width + 1
                total = total[:n] * np.uint64(power) + part[covered : covered + n]
            covered += width
        left >>= 1
        if left:
            n = len(part) - width
            part = part[:n] * np.uint64(power) + part[width : width + n]
            width, power = 2 * width, power * power % (1 << 64)
    total = total[: len(data) - size + 1]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(32))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first start, number of starts) over concatenated texts that stop at ``ends``."""
    place_bits = np.uint64(24)
    for first in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[first : first + CHUNK + length - 1]
        hashes = gram_hashes(part, GRAM)
        keys = (hashes >> place_bits << place_bits) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (sliding_minimum(keys, length - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        start = np.arange(first, first + len(anchor))
        inside = start + length <= ends[np.searchsorted(ends, start, side="right")]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        opens = np.flatnonzero(new & inside)
        closed = np.concatenate([np.flatnonzero((new | ~inside)[1:]) + 1, [len(anchor)]])
        stops = closed[np.searchsorted(closed, opens, side="right")] if len(opens) else opens
        yield hashes[anchor[opens]], first + opens, stops - opens


ENTRY = "kind int, a long, g1 long, g2 long, k1 long, k2 long, s long, n int"
COVERED, OPEN, SETTLED = 0, 1, 2


def _batch(kind, a, g1, g2, k1, k2, s, n) -> pa.RecordBatch:
    columns = [np.full(len(a), kind, np.int32) if np.isscalar(kind) else kind, a, g1, g2, k1, k2, s, np.asarray(n, np.int32)]
    columns = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ENTRY.split(", ")])


def _classes(a: np.ndarray, g1: np.ndarray, g2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal (a, g1, g2) together, the places where a class begins, and class sizes."""
    order = np.lexsort((g2, g1, a))
    x, y, z = a[order], g1[order], g2[order]
    begins = np.ones(len(a), bool)
    begins[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
    begins = np.flatnonzero(begins)
    return order, begins, np.diff(np.append(begins, len(a)))


def entries(docs: DataFrame, length: int) -> DataFrame:
    """Segments of all texts; segments that a task sees twice are covered, and one settled entry stands for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch, sizes in slabs(batches, "text", CHUNK):
            data = joined_bytes(batch.column("text"))
            ends = np.cumsum(sizes)
            keys = [batch.column(c).to_numpy() for c in ("k1", "k2")]
            view = memoryview(data)
            for a, s, n in segments(data, ends, length):
                if not len(a):
                    continue
                digests = [digest(view[x:y]) for x, y in zip(s.tolist(), (s + n + length - 1).tolist())]
                g = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                doc = np.searchsorted(ends, s, side="right")
                row = [a, g[:, 0], g[:, 1], keys[0][doc], keys[1][doc], s - (ends - sizes)[doc], n]
                order, begins, count = _classes(a, g[:, 0], g[:, 1])
                many = np.repeat(count > 1, count)
                if many.any():
                    yield _batch(COVERED, *[c[order[many]] for c in row])
                first = order[begins]
                yield _batch(np.where(count > 1, SETTLED, OPEN).astype(np.int32), *[c[first] for c in row])

    return mapped(docs, run, ENTRY)


def settled(found: DataFrame) -> DataFrame:
    """Covered segments, and one open segment for each content of the anchors that need a comparison.

    In the result kind OPEN is a segment seen once, SETTLED one that is covered already and only serves as a source.
    """

    def emit(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        kind, a, g1, g2, k1, k2, s, n, wide = (np.concatenate(c) for c in zip(*parts))
        order, begins, count = _classes(a, g1, g2)
        single = (count == 1) & (kind[order[begins]] == OPEN)
        covered = np.repeat(~single, count) & (kind[order] == OPEN)
        rows = order[covered]
        yield _batch(COVERED, a[rows], g1[rows], g2[rows], k1[rows], k2[rows], s[rows], n[rows])
        first = order[begins]
        anchors, at, classes = np.unique(a[first], return_inverse=True, return_counts=True)
        needed = ((classes > 1) & (np.bincount(at, single) > 0))[at] | wide[first]
        rows = first[needed]
        yield _batch(np.where(single[needed], OPEN, SETTLED).astype(np.int32), a[rows], g1[rows], g2[rows], k1[rows], k2[rows], s[rows], n[rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names]
            begins = np.flatnonzero(np.diff(columns[1]))  # the last run may go on in the next batch
            if len(begins):
                cut = begins[-1] + 1
                yield from emit([*held, [c[:cut] for c in columns]])
                held, columns = [], [c[cut:] for c in columns]
            held.append(columns)
        if held:
            yield from emit(held)

    passed = found.where(F.col("kind") == COVERED)
    open_ = found.where(F.col("kind") != COVERED)
    wide = saved(open_.groupBy("a").count().where(F.col("count") > WIDE).select("a"), "wide")
    open_ = open_.join(small(wide.withColumn("wide", F.lit(True)), 16), "a", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    spread = F.when(F.col("wide"), F.pmod("g1", F.lit(1024))).otherwise(0)
    dealt = open_.select(*[x.split()[0] for x in ENTRY.split(", ")], "wide").repartition("a", spread).sortWithinPartitions("a")
    return mapped(dealt, run, ENTRY).unionByName(passed)


def suffix_order(text: bytes, starts: np.ndarray, length: int) -> list[int]:
    """The starts, each with ``length`` bytes after it at least, in the order of these bytes.

    First stage: suffixes smaller than their successor are sorted directly. Second stage: scanning the order from the
    left, each suffix places its predecessor, if that is the larger one, at the front of its bucket of first bytes.
    """
    data = np.frombuffer(text, np.uint8)
    places = np.arange(len(data))
    changes = np.append(data[:-1] != data[1:], True)
    rises = np.append(data[:-1] < data[1:], True)  # the last suffix counts as smaller than what follows
    next_change = np.minimum.accumulate(np.where(changes, places, len(data))[::-1])[::-1]
    smaller = rises[next_change]
    next_smaller = np.minimum.accumulate(np.where(smaller, places, len(data))[::-1])[::-1]
    wanted = np.zeros(len(data) + 1, np.int64)  # from each start up to the next one that is sorted directly
    np.add.at(wanted, starts, 1)
    np.add.at(wanted, next_smaller[starts] + 1, -1)
    wanted = np.cumsum(wanted)[:-1] > 0

    direct = sorted(np.flatnonzero(wanted & smaller).tolist(), key=lambda i: text[i : i + length])
    sizes = np.bincount(data[wanted], minlength=256)
    front = list(accumulate(sizes.tolist(), initial=0))
    order = [-1] * int(sizes.sum())
    ends = np.array(front[1:])
    firsts = data[np.array(direct, np.int64)] if direct else np.empty(0, np.uint8)
    counts = np.bincount(firsts, minlength=256)
    base = ends - counts
    rank = np.arange(len(direct)) - (np.cumsum(counts) - counts)[firsts]  # directly sorted ones are in bucket order
    for place, i in zip((base[firsts] + rank).tolist(), direct):
        order[place] = i
    larger = (wanted & ~smaller).tolist()
    for place in range(len(order)):
        before = order[place] - 1
        if before >= 0 and larger[before]:
            bucket = text[before]
            order[front[bucket]] = before
            front[bucket] += 1
    is_start = np.zeros(len(data), bool)
    is_start[starts] = True
    order = np.array(order, np.int64)
    return order[is_start[order]].tolist()


def common_prefixes(text: bytes, order: np.ndarray, length: int, step: int = 50) -> np.ndarray:
    """How many bytes each of the starts, but the first, shares with the one before it in the order; at most ``length``."""
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text + bytes(step), np.uint8), step)
    common = np.zeros(max(0, len(order) - 1), np.int64)
    for first in range(0, len(common), 1 << 16):
        pairs = np.arange(first, min(first + (1 << 16), len(common)))
        for done in range(0, length, step):
            width = min(step, length - done)
            differ = rows[order[pairs] + done, :width] != rows[order[pairs + 1] + done, :width]
            whole = ~differ.any(axis=1)
            common[pairs] = done + np.where(whole, width, differ.argmax(axis=1))
            pairs = pairs[whole]
    return common


def repeated_starts(pieces: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each piece, which of its first ``counts`` starts have a string that also starts elsewhere in the pieces."""
    text = b"".join(pieces)
    offsets = np.cumsum([0, *map(len, pieces)])
    starts = np.concatenate([np.arange(o, o + c) for o, c in zip(offsets, counts)])
    order = np.array(suffix_order(text, starts, length), np.int64)
    common = common_prefixes(text, order, length) == length
    found = np.zeros(len(text), bool)
    found[order[1:][common]] = True
    found[order[:-1][common]] = True
    return [found[o : o + c] for o, c in zip(offsets, counts)]


RANGE = "k1 long, k2 long, s long, n int"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["k1", "k2", "s", "n"])


def compared(pieces: DataFrame, length: int) -> DataFrame:
    """Ranges of starts in open pieces whose strings are found elsewhere, by suffix arrays per group of anchors."""

    def emit(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        flags = repeated_starts([r["data"] for r in rows], [r["n"] for r in rows], length)
        out = []
        for row, flag in zip(rows, flags):
            if row["kind"] == OPEN:
                out += [(row["k1"], row["k2"], row["s"] + x, y) for x, y in zip(*map(np.ndarray.tolist, _runs(flag)))]
        yield _ranges(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                for row in batch.slice(k, 512).to_pylist():
                    if size >= ARRAY and row["a"] != last:  # anchors share an array, but none is divided
                        yield from emit(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row["data"])
                    last = row["a"]
        if held:
            yield from emit(held)

    return mapped(pieces.repartition("a").sortWithinPartitions("a"), run, RANGE)


def divided(pieces: DataFrame, length: int, block: int) -> DataFrame:
    """Segments of the parts of ``pieces`` in blocks of starts; their anchor stands for block and shared bytes.

    Equal strings have equal anchors again: they start equally far before the old one, so in one block, and hold the
    bytes that all strings of the block hold.
    """

    def parts(row: dict) -> Iterator[tuple]:
        data, n = row["data"], row["n"]
        hashes = gram_hashes(np.frombuffer(data[:length], np.uint8), GRAM)
        place = int((hashes >> np.uint64(24)).argmin())
        for number in range((place - n + 1) // block, place // block + 1):
            nearest, farthest = number * block, number * block + block - 1
            first, last = max(0, place - farthest), min(n - 1, place - nearest)
            shared = data[place - nearest : place - farthest + length]
            anchor = xxhash.xxh3_64_digest(shared + number.to_bytes(4, "little") + row["a"].to_bytes(8, "little", signed=True))
            content = xxhash.xxh3_128_digest(data[first : last + length])
            yield row["kind"], anchor + content, row["k1"], row["k2"], row["s"] + first, last - first + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                kind, hashes, k1, k2, s, n = zip(*(part for row in batch.slice(k, 512).to_pylist() for part in parts(row)))
                a, g1, g2 = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 3).T.copy()
                yield _batch(np.array(kind, np.int32), a, g1, g2, *[np.array(c, np.int64) for c in (k1, k2, s)], n)

    return mapped(pieces, run, ENTRY)


def covered_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, ranges) of texts (k1, k2, text): starts of strings of ``length`` bytes that also start elsewhere."""
    found = saved(settled(saved(entries(docs, length), "segments")), "settled")
    data = F.substring(F.col("text"), (F.col("s") + 1).cast("int"), F.col("n") + length - 1)
    blocks, few, every = iter(BLOCKS), None, None
    while True:
        covered = found.where(F.col("kind") == COVERED).select("k1", "k2", "s", "n")
        every = every.unionByName(covered) if every else covered
        needed = saved(found.where(F.col("kind") != COVERED).select("kind", "a", "k1", "k2", "s", "n"), "compared")
        if few is None:
            owners = saved(needed.select("k1", "k2").distinct(), "owners")
            few = docs.join(small(owners, 32), ["k1", "k2"], "left_semi")
        pieces = needed.join(few, ["k1", "k2"]).select("kind", "a", "k1", "k2", "s", "n", data.alias("data"))
        size = needed.groupBy("a").agg(F.count("*").alias("count"), F.sum(F.col("n") + length - 1).alias("bytes"))
        wide = saved(size.where((F.col("count") > 1) & (F.col("bytes") > WIDE_BYTES)).select("a"), "wide-anchors")
        block = None if wide.isEmpty() else next(blocks, None)
        if block is None:
            every = every.unionByName(compared(pieces, length)).distinct()
            return every.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("ranges"))
        every = every.unionByName(compared(pieces.join(small(wide, 16), "a", "left_anti"), length))
        parts = divided(pieces.join(small(wide, 16), "a", "left_semi"), length, block)
        found = saved(settled(saved(parts, "parts")), "settled")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, k1, k2, text as bytes); equal (k1, k2) are repeated rows."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), body).alias("k1"), tally(body).alias("k2"), body.alias("text"))


RESULT = "n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>, kept binary"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, spans (maximal removed runs), kept (the other bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch, sizes in slabs(batches, "text", CHUNK):
            out = []
            for data, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                spans = []
                for r in ranges or []:
                    start, stop = r["s"], r["s"] + r["n"] + length - 1
                    if spans and start <= spans[-1]["stop"]:
                        spans[-1]["stop"] = max(spans[-1]["stop"], stop)
                    else:
                        spans.append({"start": start, "stop": stop})
                edges = [0, *[e for x in spans for e in (x["start"], x["stop"])], len(data)]
                kept = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])])
                out.append((len(data), len(data) - len(kept), len(spans), spans, kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), kind, pa.binary()]
            columns = [batch.column("key"), *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    rows = keyed(docs, key, text)
    ranges = saved(covered_ranges(rows.select("k1", "k2", "text"), length), "ranges")
    joined = rows.join(ranges, ["k1", "k2"], "left").select("key", "text", "ranges")
    return mapped(joined, run, f"key {docs.schema[key].dataType.simpleString()}, {RESULT}")
