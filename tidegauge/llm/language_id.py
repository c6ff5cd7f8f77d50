"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary n-gram classifier (log odds of hashed character n-grams, each
language weighing the same) says on which side of the bit a text lies; the nearest codeword under a loss weighted by how
well a bit separates its two sides is the prediction, and a small lead over the second nearest is flagged as ambiguous.

Training counts n-grams over every labelled row, aggregated in tasks and again before the shuffle; what reaches the
driver is one table of counts per language, ``languages x BUCKETS``, and the broadcast weights are ``bits x BUCKETS``.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with a null language teach nothing;
without any labelled row every text is ``und``; with one language every text with a letter is that language; other
columns, also of clashing names, are left alone by ``predict``, which returns its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import mapped, slabs, texts

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Languages with a full code (every split into two sides); beyond it a random code of this many bits per doubling.
FULL_CODE, BITS_PER_DOUBLING = 5, 10
#: A mean margin per n-gram counts this many times, at most as often as there are n-grams.
STRENGTH = 20
#: Lead of the nearest codeword, as a share of all weight, below which a prediction is ambiguous.
LEAD = 0.05
SLAB_BYTES = 1_000_000


def codewords(languages: int, seed: int = 0) -> np.ndarray:
    """A row of +1 and -1 per language, a column per bit; no column is constant or the complement of another."""
    if languages <= FULL_CODE:
        sides = [s for n in range(0, languages - 1) for s in combinations(range(1, languages), n)]
        code = np.full((languages, len(sides)), -1, np.int8)
        for bit, side in enumerate(sides):
            code[[0, *side], bit] = 1
        return code
    bits = int(np.ceil(BITS_PER_DOUBLING * np.log2(languages)))
    random, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = random.choice(np.array([-1, 1], np.int8), (languages, bits))
        if (np.abs(code.sum(axis=0, dtype=int)) == languages).any():
            continue
        dots = code.astype(int) @ code.T
        np.fill_diagonal(dots, -bits)
        if (distance := (bits - dots.max()) // 2) > apart:
            best, apart = code, distance
    return best


def letters(text: str) -> np.ndarray:
    """Code points in lower case, runs of anything but letters as one blank, a blank at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = (points >= 97) & (points <= 122)
    beyond = np.flatnonzero(points > 127)
    if len(beyond):
        kinds, place = np.unique(points[beyond], return_inverse=True)
        is_letter[beyond] = np.array([chr(k).isalpha() for k in kinds])[place]
    points = np.where(is_letter, points, 32)
    blank = ~is_letter
    if len(points):
        points = points[~(blank & np.concatenate([[True], blank[:-1]]))]
    inner = points[:-1] if len(points) and points[-1] == 32 else points
    return np.concatenate([[32], inner, [32]]).astype(np.uint32)


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """Hashed n-grams, one at each place where one begins."""
    count = len(points) - order + 1
    mixed = np.full(max(count, 0), 2166136261 + order, np.uint32)
    for k in range(order if count > 0 else 0):
        mixed = (mixed ^ points[k : k + count]) * np.uint32(16777619)
        mixed ^= mixed >> np.uint32(15)
    return mixed & np.uint32(BUCKETS - 1)


def has_letter(points: np.ndarray) -> bool:
    return len(points) > 2


def gram_counts(labelled: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """(language, bucket, n) over all labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch, _ in slabs(batches, text, SLAB_BYTES):
            by_language: dict[str, list[np.ndarray]] = {}
            for name, body in zip(batch.column(language).to_pylist(), texts(batch.column(text))):
                points = letters(body)
                if name is not None and has_letter(points):
                    by_language.setdefault(name, []).append(points)
            for name, parts in by_language.items():
                points = np.concatenate(parts)
                total = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                for order in ORDERS:
                    total += np.bincount(grams(points, order), minlength=BUCKETS)
        for name, total in totals.items():
            used = np.flatnonzero(total)
            columns = [pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])]
            yield pa.RecordBatch.from_arrays(columns, names=["language", "bucket", "n"])

    rows = mapped(labelled.select(text, F.col(language).cast("string").alias(language)), run, "language string, bucket int, n long")
    return rows.groupBy("language", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def judge(self, margins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of mean margins per bit: index of the nearest codeword, score, ambiguous."""
        signal = margins * np.minimum(STRENGTH, sizes)[:, None]
        loss = np.logaddexp(0, -signal[:, None, :] * self.code[None, :, :]) @ self.trust
        order = np.sort(loss, axis=1)
        likely = np.exp(order[:, :1] - loss)
        lead = order[:, 1] - order[:, 0] if len(self.languages) > 1 else np.full(len(loss), np.inf)
        return loss.argmin(axis=1), 1 / likely.sum(axis=1), lead < LEAD * self.trust.sum()


def train(labelled: DataFrame, text: str = "text", language: str = "lang") -> LanguageModel:
    """Classifiers of all bits from the n-gram counts of every language."""
    counts = gram_counts(labelled, text, language).toArrow()
    names = sorted(set(counts.column("language").to_pylist()))
    table = np.zeros((len(names), BUCKETS))
    place = {name: k for k, name in enumerate(names)}
    rows = np.array([place[x] for x in counts.column("language").to_pylist()], np.int64)
    if not names:
        return LanguageModel([], np.zeros((0, 0), np.int8), np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    table[rows, counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    rates = (table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    code = codewords(len(names))
    weights, trust = [], []
    for bit in range(code.shape[1]):
        if len(names) == 1:
            plus = minus = rates[0]
        else:
            plus, minus = rates[code[:, bit] > 0].mean(axis=0), rates[code[:, bit] < 0].mean(axis=0)
        odds = np.log(plus) - np.log(minus)
        weights.append(odds)
        trust.append(((plus - minus) * odds).sum())  # how far apart the mean margins of the two sides are
    trust = np.array(trust)
    return LanguageModel(names, code, np.array(weights, np.float32), trust / trust.mean() if trust.any() else np.ones(len(trust)))


RESULT = "language string, score double, ambiguous boolean"


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, score, ambiguous) per row, from the text alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bits x BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, _ in slabs(batches, text, SLAB_BYTES):
            points = [letters(t) for t in texts(batch.column(text))]
            sizes = np.array([len(p) for p in points])
            known = (sizes > 2) & bool(model.languages)
            margins = np.zeros((len(points), len(model.weights)))
            flat = np.concatenate(points)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            total = np.zeros(len(points))
            for order in ORDERS:
                # a gram that begins in a text's last places would reach into the next text: its weight is taken as 0
                found = np.concatenate([grams(flat, order), np.zeros(order - 1, np.uint32)])
                valid = np.ones(len(flat), bool)
                for back in range(1, order):
                    valid[starts + sizes - back] = False
                total += np.add.reduceat(valid, starts, dtype=np.int64)
                for bit, weights in enumerate(model.weights):
                    margins[:, bit] += np.add.reduceat(np.where(valid, weights[found], 0), starts, dtype=np.float64)
            margins /= np.maximum(total, 1)[:, None]
            if model.languages:
                best, score, close = model.judge(margins, total)
                names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist())]
            else:
                names, score, close = [UNKNOWN] * len(points), np.zeros(len(points)), np.zeros(len(points), bool)
            columns = [batch.column(key), pa.array(names), pa.array(np.where(known, score, 0.0)), pa.array(close & known)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "language", "score", "ambiguous"])

    return mapped(docs.select(key, text), run, f"key {docs.schema[key].dataType.simpleString()}, {RESULT}")
