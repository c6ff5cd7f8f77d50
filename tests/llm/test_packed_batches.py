"""Packing holds little at once: pieces leave in batches of bounded bytes, new pieces are encoded in bounded calls."""

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tidegauge.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts(count: int, words: int) -> list[str]:
    rnd = np.random.default_rng(11)
    return [" ".join(f"{a:x}" for a in rnd.integers(0, 1 << 40, words)) for _ in range(count)]


def packed(monkeypatch, rows: list[str]) -> list[pa.RecordBatch]:
    """The batches of one task."""

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId() -> int:
            return 3

    class Rows:
        def select(self, *names):
            return self

    monkeypatch.setattr(packing, "TaskContext", Task)
    monkeypatch.setattr(packing, "mapped", lambda docs, run, schema: run)
    table = pa.table({"doc_id": pa.array(range(len(rows)), pa.int64()), "text": pa.array(rows)})
    return list(packing.pack(Rows(), PATH)(iter(table.to_batches(max_chunksize=100))))


@pytest.mark.parametrize("least", [0, 1 << 40])
def test_pieces_leave_in_bounded_batches(monkeypatch, least):
    """A block's settled remainders are not one batch; whatever the bound, the pieces are the same."""
    rows = texts(900, 60) + [" ".join(texts(40, 60))]
    if least:
        monkeypatch.setattr(packing, "OUT_BYTES", least)
        assert max(b.nbytes for b in packed(monkeypatch, rows)) > 600_000
        return
    whole = pa.Table.from_batches(packed(monkeypatch, rows))
    monkeypatch.setattr(packing, "OUT_BYTES", 100_000)
    out = packed(monkeypatch, rows)
    assert all(b.num_rows for b in out) and max(b.column("ids").nbytes for b in out) < 110_000
    assert pa.Table.from_batches(out).equals(whole)
    by_text = {}
    for row in sorted(whole.to_pylist(), key=lambda r: (r["key"], r["start"])):
        by_text[row["key"]] = by_text.get(row["key"], b"") + row["ids"]
    coder = packing.memo(PATH).tokenizer
    assert [np.frombuffer(by_text[k], np.uint32).tolist() for k in range(len(rows))] == [coder.encode(x, add_special_tokens=False).ids + [0] for x in rows]


def test_new_pieces_are_encoded_in_bounded_calls(monkeypatch):
    memo, calls = packing.PieceMemo(PATH), []
    tokenizer = memo.tokenizer

    class Counted:
        def encode_batch_fast(self, rows, **more):
            calls.append(sum(map(len, rows)))
            return tokenizer.encode_batch_fast(rows, **more)

        def encode(self, row, **more):
            return tokenizer.encode(row, **more)

    memo.tokenizer = Counted()
    rows = texts(200, 100)
    found = memo.encode([x.encode() for x in rows])
    assert sum(calls) > 180_000 and max(calls) < 50_000
    assert found == [np.array(tokenizer.encode(x, add_special_tokens=False).ids, np.uint32).tobytes() for x in rows]


def test_a_worker_without_a_task_keeps_recent_pieces_only(monkeypatch):
    monkeypatch.setattr(packing, "PIECES_KEPT", 50)
    monkeypatch.setattr(packing, "SLAB_BYTES", 2000)
    packed(monkeypatch, texts(200, 60))
    assert packing.memo(PATH).known and not packing.memo(PATH).older
