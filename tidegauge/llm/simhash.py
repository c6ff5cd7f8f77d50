"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a point half-way: every fingerprint emits the variants within half the
radius, and variants that meet are verified. For an odd radius, pairs at exactly that distance differ in parity, so only
fingerprints of even parity emit the larger half.

Variants are shuffled by their leading bits: one row stands for all variants of a fingerprint that share them, and the
receiving task spells these out, a slice of the remaining bits at a time. Of the fingerprints that meet in a variant the
task keeps a star, which has the same components as all pairs.

Defined cases: null and empty texts, and texts of white space alone, have fingerprint zero and link like any other;
texts of fewer than ``words`` words are one shingle; repeated rows share a fingerprint; null keys join a group but never
name it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import mapped, saved, slabs
from tidegauge.llm.graph import components, forest

WORDS, RADIUS, SEED = 3, 3, 42
SLAB_BYTES = 4_000_000
#: Distinct fingerprints for each combination of leading bits, and variants that a task spells out together.
PER_BUCKET = 256
SLICE = 1 << 21


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number."""
    tokens = data.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not tokens:
        return 0
    text = b" ".join(tokens)
    if len(tokens) <= words:
        return int.from_bytes(xxhash.xxh64_digest(text, SEED), "big", signed=True)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes).tolist(), ends.tolist()
    digest = xxhash.xxh64_digest
    total, bits, step = len(tokens) - words + 1, np.zeros(64, np.int64), 1 << 16
    for first in range(0, total, step):
        last = min(first + step, total)
        hashes = b"".join([digest(text[a:b], SEED) for a, b in zip(starts[first:last], ends[first + words - 1 : last + words - 1])])
        bits += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * bits > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, print) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in slabs(batches, text, SLAB_BYTES):
            found = [fingerprint(t or b"", words) for t in batch.column(text).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.int64())], names=["key", "print"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), run, f"key {kind}, print long")


@lru_cache(maxsize=128)
def flips(bits: int, most: int) -> list[np.ndarray]:
    """Masks with exactly 0, 1, ... ``most`` of the lowest ``bits`` bits."""
    one = [1 << k for k in range(bits)]
    return [np.array([sum(c) for c in combinations(one, n)], np.uint64) for n in range(most + 1)]


def reach(prints: np.ndarray, radius: int) -> np.ndarray:
    """How many bits each fingerprint may flip: half the radius, the larger half for even parity."""
    odd = np.bitwise_count(prints).astype(np.int64) & 1
    return np.where(odd == 1, radius // 2, (radius + 1) // 2)


def deal(prints: DataFrame, radius: int, bits: int) -> DataFrame:
    """(bucket, print, spent): the leading bits of the variants and the flips spent on them."""
    masks = flips(bits, (radius + 1) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            top, most = values >> np.uint64(64 - bits), reach(values, radius)
            for spent, mask in enumerate(masks):
                able = most >= spent
                bucket = (top[able][:, None] ^ mask[None, :]).ravel().astype(np.int32)
                value = np.repeat(values[able], len(mask)).view(np.int64)
                names = ["bucket", "print", "spent"]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(value), pa.array(np.full(len(value), spent, np.int32))], names=names)

    return mapped(prints.select("print"), run, "bucket int, print long, spent int")


def meet(values: np.ndarray, spent: np.ndarray, low_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of fingerprints that meet in a variant of the bucket.

    ``values`` have flips ``spent`` outside the ``low_bits``. Fingerprints that reached a variant by few flips are
    within the radius of everything that did; a star around one of them says so without listing pairs.
    """
    most = reach(values, radius)
    half = radius // 2
    mask = np.uint64((1 << low_bits) - 1)
    masks = flips(low_bits, (radius + 1) // 2)
    variants, owners, used = [], [], []
    for extra, flip in enumerate(masks):
        able = np.flatnonzero(most - spent >= extra)
        variants.append(((values[able] & mask)[:, None] ^ flip[None, :]).ravel())
        owners.append(np.repeat(able, len(flip)))
        used.append(np.repeat((spent[able] + extra).astype(np.int8), len(flip)))
    variants, owners, used = np.concatenate(variants), np.concatenate(owners), np.concatenate(used)
    order = np.argsort(variants, kind="stable")
    variants = variants[order]
    same = variants[1:] == variants[:-1]
    keep = np.zeros(len(variants), bool)
    keep[1:] |= same
    keep[:-1] |= same
    variants, order = variants[keep], order[keep]
    if not len(variants):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owners, used = owners[order], used[order]
    again = np.lexsort((used, variants))
    variants, owners, used = variants[again], owners[again], used[again]
    first = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(variants)]]))
    center = np.repeat(owners[first], sizes)
    few = np.repeat(used[first], sizes) <= half
    a, b = values[owners], values[center]
    near = few & (a != b) & (np.bitwise_count(a ^ b) <= radius)
    a, b = a[near].view(np.int64), b[near].view(np.int64)
    return forest(a, b) if len(a) else (a, b)


def links(prints: DataFrame, radius: int = RADIUS, bits: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are within ``radius`` bits.

    ``bits``: leading bits that deal out the variants; by default as many as there are fingerprints for.
    """
    bits = bits or min(20, max(6, (prints.count() // PER_BUCKET).bit_length()))

    def settle(values: np.ndarray, spent: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slices by the next bits until the variants of a slice fit in memory."""
        left = reach(values, radius) - spent
        sizes = sum(len(m) * (left >= n).sum() for n, m in enumerate(flips(low, (radius + 1) // 2)))
        if sizes <= SLICE or low <= 8:
            if len(values) > 1:
                yield meet(values, spent, low, radius)
            return
        for bit in (0, 1):
            off = ((values >> np.uint64(low - 1)) & np.uint64(1)) != bit
            able = left >= off
            yield from settle(values[able], (spent + off)[able], low - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, values, spent = None, [], []
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(buckets)]):
                if first == last:
                    continue
                if buckets[first] != bucket:
                    yield from emit(values, spent)
                    bucket, values, spent = buckets[first], [], []
                values.append(batch.column(1).to_numpy()[first:last])
                spent.append(batch.column(2).to_numpy()[first:last])
        yield from emit(values, spent)

    def emit(values: list, spent: list) -> Iterator[pa.RecordBatch]:
        if not values:
            return
        for a, b in settle(np.concatenate(values).view(np.uint64), np.concatenate(spent).astype(np.int64), 64 - bits):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = deal(prints, radius, bits).repartition("bucket").sortWithinPartitions("bucket")
    return mapped(dealt, run, "a long, b long")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(key, print, group) per row; group is the smallest key reachable over links."""
    rows = saved(fingerprints(docs, key, text, words), "prints")
    distinct = saved(rows.groupBy("print").agg(F.min("key").alias("low")), "distinct-prints")
    parts = saved(components(links(distinct, radius)), "components")
    names = distinct.join(parts, distinct["print"] == parts["node"]).groupBy("root").agg(F.min("low").alias("least"))
    named = distinct.join(parts, distinct["print"] == parts["node"], "left").join(names, "root", "left")
    named = saved(named.select("print", F.coalesce("least", "low").alias("group")), "named-prints")
    return rows.join(named, "print").select("key", "print", "group")
