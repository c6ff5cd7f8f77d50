"""Cost-balanced packing of token ids into sequences of bounded length.

A document is its ids and an end id. Whole stretches of ``capacity`` ids are sequences of their own; the remainders of a
block of documents are spread over as few sequences as can hold them. Each sequence has an estimated cost, linear in its
tokens plus quadratic in the length of each piece (attention does not cross documents); remainders in descending order
go to the sequence of lowest cost with room for them. A remainder for which no sequence has room is cut at the largest
room left, so a block wastes less than one sequence.

Blocks form inside a scan partition: nothing is shuffled, and a task that runs again gives the same pieces and ids.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; null keys are carried.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidegauge.llm.bpe import LONG_PIECE
from tidegauge.llm.common import give_back, kept, mapped, slabs

CAPACITY = 1024
END_ID = 0
BLOCK_DOCS = 8192
SLAB_BYTES = 1_000_000
#: Bytes of ids in an Arrow batch of pieces; the JVM holds it as well.
OUT_BYTES = 2_000_000
PIECES_KEPT = 150_000  # per Python worker
#: Texts of 200 new pieces that are encoded in one call.
TOGETHER = 16
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

PIECES = "key long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: White space that UTF-8 writes in one byte, and the first three bytes of the rest, a third one that varies being zero.
_BLANK = np.array([chr(k).isspace() for k in range(128)] + [False] * 128)
_WIDE_BLANKS = np.array(
    [int.from_bytes(chr(k).encode().ljust(3, b"\0"), "big") for k in range(128, sys.maxunicode + 1) if chr(k).isspace()], np.int64
)


def piece_starts(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the pieces of joined UTF-8 texts of ``sizes`` bytes begin: the places of ``bpe.cut``."""
    ends = np.cumsum(sizes)
    bounds = np.zeros(len(data) + 1, bool)
    bounds[ends] = bounds[0] = True
    at = np.flatnonzero(data == 32)
    at = at[~bounds[at + 1]]  # a space that ends its text begins nothing
    after = np.append(data, np.zeros(3, np.uint8))
    keep = ~_BLANK[after[at + 1]]
    wide = np.flatnonzero(after[at + 1] >= 128)
    if len(wide):
        one, two, three = (after[at[wide] + k].astype(np.int64) for k in (1, 2, 3))
        keep[wide] = ~np.isin(one << 16 | two << 8 | np.where(one < 0xE0, 0, three), _WIDE_BLANKS)
    bounds[at[keep]] = True
    return np.flatnonzero(bounds[:-1])


class PieceMemo:
    """Ids by a ``tokenizers`` file, remembered per piece between spaces (see ``bpe.cut``).

    Each distinct piece of a batch is looked up once. Pieces not yet known are encoded together, as one text, since they
    may follow each other anywhere; the bytes of the ids tell where each of them ends. Texts that hold a special token's
    string go to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, rank in vocabulary.items():
            self.sizes[rank] = len(token)  # one character stands for one byte
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # all but recently used ones are forgotten when known is full

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        ends = np.cumsum([len(p) for p in pieces])
        step = 200
        joined = [b"".join(pieces[k : k + step]).decode() for k in range(0, len(pieces), step)]
        ids = []
        for k in range(0, len(joined), TOGETHER):  # what the tokenizer returns is far larger than the ids
            coded = self.tokenizer.encode_batch_fast(joined[k : k + TOGETHER], add_special_tokens=False)
            ids += [np.array(e.ids, np.uint32) for e in coded]
        ids = np.concatenate(ids)
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *stops.tolist()], stops.tolist())]

    def _alone(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32).tobytes()

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.known) > PIECES_KEPT:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, pieces))
        places = [k for k, ids in enumerate(found) if ids is None]
        missing = [pieces[k] for k in places]
        coded = list(map(self.older.get, missing))
        new = []
        for k, piece in enumerate(missing):
            if coded[k] is None:
                if piece[:1] == b" " and (32 < ord(piece[1:2] or b" ") < 127 or not piece[1:5].decode(errors="ignore")[:1].isspace()):
                    new.append(k)
                else:
                    coded[k] = self._alone(piece)
        for k, ids in zip(new, self._together([missing[k] for k in new]) if new else []):
            coded[k] = ids
        for k, ids in zip(places, coded):
            found[k] = ids
        self.known.update(zip(missing, coded))
        for piece in missing:
            if len(piece) > LONG_PIECE:
                del self.known[piece]
        return found

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8), little-endian unsigned 32-bit."""
        whole = {k: self._alone(t) for k, t in enumerate(batch) if any(s in t for s in self.special)}
        parts = [b"" if k in whole else t for k, t in enumerate(batch)]
        sizes = np.array([len(t) for t in parts], np.int64)
        data = b"".join(parts)
        if not data:
            return [whole.get(k, b"") for k in range(len(batch))]
        starts = piece_starts(np.frombuffer(data, np.uint8), sizes)
        offsets = np.append(starts, len(data)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        _, stops, values = column.dictionary.buffers()
        stops, values = np.frombuffer(stops, np.int32)[: len(column.dictionary) + 1].tolist(), values.to_pybytes()
        pieces = [values[a:b] for a, b in zip(stops, stops[1:])]  # to_pylist takes ten times as long
        ids = pa.array(self._ids(pieces), pa.binary()).take(column.indices)
        _, stops, out = ids.buffers()
        at = np.searchsorted(starts, np.append(0, np.cumsum(sizes)))
        cuts, out = np.frombuffer(stops, np.int32)[at].tolist(), out.to_pybytes()
        return [whole[k] if k in whole else out[a:b] for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


@kept
def memo(path: str) -> PieceMemo:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
    return PieceMemo(path)


def balance(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start in its remainder, length, sequence, offset) of remainders of fewer than ``capacity`` ids."""
    count = -(-int(lengths.sum()) // capacity)
    room = np.full(count, capacity, np.int64)
    cost = np.zeros(count)
    out = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[k])
        while left:
            open_cost = np.where(room >= left, cost, np.inf)
            best = int(open_cost.argmin())
            if open_cost[best] == np.inf:
                best = int(room.argmax())
            size = min(left, int(room[best]))
            out.append((k, start, size, best, capacity - int(room[best])))
            room[best] -= size
            cost[best] += LINEAR * size + QUADRATIC * size * size
            start, left = start + size, left - size
    return out


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = memo(tokenizer_path), np.array([end_id], np.uint32).tobytes()
        sequence, held = TaskContext.get().partitionId() << 40, []
        rows = []

        def settled() -> None:
            nonlocal sequence, held
            pieces = balance(np.array([len(ids) // 4 for _, _, ids, _ in held], np.int64), capacity)
            for k, start, size, place, offset in pieces:
                name, before, ids, total = held[k]
                rows.append((name, before + start, size, ids[4 * start : 4 * (start + size)], total, sequence + place, offset))
            sequence += 1 + max((p[3] for p in pieces), default=-1)
            held = []

        def done() -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            step = max(1, OUT_BYTES // (4 * capacity))
            for k in range(0, len(rows), step):
                columns = zip(*rows[k : k + step])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])
            rows.clear()

        for batch, _ in slabs(batches, text, SLAB_BYTES):
            names = batch.column(key).to_pylist()
            for name, ids in zip(names, coder.encode([x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()])):
                ids += end
                total = len(ids) // 4
                full = total - total % capacity
                for start in range(0, full, capacity):
                    rows.append((name, start, capacity, ids[4 * start : 4 * (start + capacity)], total, sequence, 0))
                    sequence += 1
                if full < total:
                    held.append((name, full, ids[4 * full :], total))
                    if len(held) >= BLOCK_DOCS:
                        settled()
            yield from done()
            give_back()
        settled()
        yield from done()
        coder.older = {}  # tasks take turns on more workers than run at once

    return mapped(docs.select(key, text), run, PIECES)
