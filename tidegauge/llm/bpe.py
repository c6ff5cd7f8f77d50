"""Byte-level BPE in linear time: longest matches, backtracking, and a memo of which tokens may stand side by side.

Bytes are mapped to Latin-1 so that pyahocorasick finds every vocabulary entry in a word. Encoding takes the longest
match at each place, and falls back to a shorter one if the pair with the previous token could not have come out of the
merges: two tokens are compatible if no merge across their border would have come before the merges that made them.
Places found to be dead ends are never tried twice, so each word takes linear time and gives the exact merges.

Defined cases: a null text is empty and has no ids; ids are returned in text order; repeated rows are encoded each; texts of
any length are encoded whole, long pieces without being remembered; an empty table gives no rows; other columns stay
untouched, and one that is named like a new column is an error.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidegauge.llm.common import Memo, kept, lists, mapped, slabs, texts

#: Pieces of text, matches in them, and token pairs remembered per Python worker.
PIECES_KEPT, WORDS_KEPT, PAIRS_KEPT = 400_000, 50_000, 200_000
#: Longer pieces are not remembered.
LONG_PIECE = 64
SLAB_BYTES = 2_000_000
BLANK_LEFT = re.compile(r" \s").search


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class ByteBPE:
    """Encoder and decoder for a rank file; the rank of a token is its id and the order of its merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = [len(token) for token in self.tokens]
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = self._shorter()
        self.halves, self.merged = self._halves()
        #: Ids of the words that are a token as a whole, by their bytes in Latin-1.
        self.whole = {token.decode("latin-1"): rank for token, rank in ranks.items() if self._reachable(rank)}
        self.fits = Memo(self._compatible, PAIRS_KEPT)
        self.words = Memo(self._word, WORDS_KEPT)
        self.pieces = Memo(self._piece, PIECES_KEPT)

    def _shorter(self) -> list[int]:
        """For each token the longest token that is a proper prefix of it, or -1."""
        shorter = [-1] * len(self.tokens)
        for rank, token in enumerate(self.tokens):
            for size in range(len(token) - 1, 0, -1):
                if (prefix := self.ranks.get(token[:size])) is not None:
                    shorter[rank] = prefix
                    break
        return shorter

    def _halves(self) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
        """The two tokens whose merge makes a token (itself twice if none does), and the other way round."""
        halves = [(rank, rank) for rank in range(len(self.tokens))]
        merged = {}
        for token, rank in self.ranks.items():
            if len(token) == 1:
                continue
            parts = [token[k : k + 1] for k in range(len(token))]
            while len(parts) > 2:
                found = [(r, k) for k in range(len(parts) - 1) if (r := self.ranks.get(parts[k] + parts[k + 1])) is not None and r < rank]
                if not found:
                    break
                _, k = min(found)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2:
                halves[rank] = pair = (self.ranks[parts[0]], self.ranks[parts[1]])
                merged[pair] = rank
        return halves, merged

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Would the merges keep these two tokens apart?

        Undo the later of both merges step by step: at each stage the two parts at the border must not have a merge
        that comes before the one just undone.
        """
        a, b = pair
        before = len(self.tokens)
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            first, second = self.halves[a], self.halves[b]
            whole_a, whole_b = first[0] == a, second[0] == b
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                before, a = a, first[1]
            else:
                before, b = b + 1, second[0]

    def encode_word(self, data: str) -> list[int]:
        """Exact ids of one match of the pattern, given as its bytes in Latin-1."""
        whole = self.whole.get(data)
        if whole is not None:
            return [whole]
        fits, shorter, sizes = self.fits, self.shorter, self.sizes
        total = len(data)
        longest = [-1] * (total + 1)
        for end, rank in self.automaton.iter(data):
            longest[end - sizes[rank] + 1] = rank  # later matches with the same start are longer
        out, place, dead, last = [], 0, set(), -1
        candidate = longest[0]
        while place < total:
            while candidate >= 0:
                end = place + sizes[candidate]
                if (last < 0 or fits[last, candidate]) and end not in dead:
                    break
                candidate = shorter[candidate]
            if candidate >= 0:
                out.append(candidate)
                place, last = end, candidate
                candidate = longest[end]
            else:
                dead.add(place)
                candidate = out.pop()
                place -= sizes[candidate]
                last = out[-1] if out else -1
        return out

    def _reachable(self, rank: int) -> bool:
        return len(self.tokens[rank]) == 1 or self.halves[rank] != (rank, rank)

    def _word(self, word: str) -> bytes:
        return array("i", self.encode_word(word if word.isascii() else word.encode().decode("latin-1"))).tobytes()

    def _piece(self, piece: str) -> bytes:
        words = self.pattern.findall(piece)
        if len(words) == 1:
            return self._word(words[0])
        return b"".join([self.words[w] if len(w) <= LONG_PIECE else self._word(w) for w in words])

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers.

        A space before a character that is no white space always begins a match, so a text may be cut there, and the
        pieces, which repeat, remembered. Other spaces stay inside their piece.
        """
        pieces = cut(text)
        if max(map(len, pieces), default=0) > LONG_PIECE:
            return b"".join([self.pieces[p] if len(p) <= LONG_PIECE else self._piece(p) for p in pieces])
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def cut(text: str) -> list[str]:
    """The text in pieces, each but the first beginning with a space that no white space follows."""
    first, *rest = text.split(" ")
    if "" not in rest and not BLANK_LEFT(text):
        return [first, *[" " + part for part in rest]]
    out = [first] if first else []
    for part in rest:
        if part and not part[0].isspace():
            out.append(" " + part)
        elif out:
            out[-1] += " " + part
        else:
            out.append(" " + part)
    return out


@kept
def coder(path: str, pattern: str) -> ByteBPE:
    """One coder per vocabulary and Python worker."""
    return ByteBPE(read_ranks(path), pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns, and the ids of each whole text (array<int>) and the bytes decoded from them (binary).

    ``path``: a rank file that every executor can read, as part of an installed package or of a shared folder.
    """
    if clash := {ids, decoded} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist; choose other names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch, _ in slabs(batches, text, SLAB_BYTES):
            encoded = [np.frombuffer(bpe.encode(t), np.int32) for t in texts(batch.column(text))]
            back = pa.array([bpe.decode(x) for x in encoded], pa.binary())
            column = lists(np.concatenate(encoded), np.array([len(x) for x in encoded]))
            yield pa.RecordBatch.from_arrays([*batch.columns, column, back], names=[*batch.schema.names, ids, decoded])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return mapped(docs, run, ", ".join([*fields, f"{ids} array<int>", f"{decoded} binary"]))
