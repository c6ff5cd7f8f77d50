"""Pieces of texts for packing: where they are cut, and that each distinct one of a batch is looked up once."""

import random
import sys

import numpy as np
import public_tokenizers
from tidegauge.llm import bpe, packing
from tokenizers import Tokenizer

JSON = public_tokenizers.path("byte_bpe_50k.json")
BLANKS = [chr(k) for k in range(sys.maxunicode + 1) if chr(k).isspace()]


def odd_texts():
    rnd = random.Random(4)
    signs = [*BLANKS, *" " * 30, *"ab1.é日🎉–“、¡⁞ᙿ"]
    return ["", " ", "  ", " a", "a ", "x<|endoftext|> y", *("".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 40))) for _ in range(600))]


def test_pieces_begin_where_texts_are_cut():
    texts = odd_texts()
    want, at = [], 0
    for text in texts:
        for piece in filter(None, bpe.cut(text)):
            want.append(at)
            at += len(piece.encode())
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    assert packing.piece_starts(data, np.array([len(t.encode()) for t in texts])).tolist() == want


def test_each_piece_of_a_batch_is_looked_up_once(monkeypatch):
    monkeypatch.setattr(packing, "PIECES_KEPT", 50)
    coder, tokenizer, asked = packing.PieceMemo(JSON), Tokenizer.from_file(JSON), []
    ids = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda pieces: asked.append(pieces) or ids(pieces))
    texts = [t for t in odd_texts() for _ in range(2)] + ["la la la " * 50]
    for batch in (texts[:500], texts[500:], texts[:300], []):
        for text, found in zip(batch, coder.encode([t.encode() for t in batch]), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(asked) == 3 and all(len(pieces) == len(set(pieces)) for pieces in asked)
