"""Byte-level BPE: encoding by longest matches with backtracking, and decoding, over whole documents.

The merges of a rank file are reproduced without merging: a split of a piece into tokens is the one the merges give
exactly if every adjacent pair of tokens, joined and merged alone, falls into the same two tokens again. So tokens are
laid from left to right, the longest first; a token that does not go with the one before it gives way to its next
shorter prefix, and where none is left the one before is taken back. Each position is given up at most once, so the
work is linear in the piece. Matches come from an Aho-Corasick automaton over the bytes read as Latin-1.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T

#: Entries of a task's caches of pieces and of token pairs. A full cache becomes the old one, from which what is asked
#: for again moves to the new one, so frequent pieces stay. Longer pieces are not kept.
CACHE, CACHED_PIECE = 80_000, 48
#: White space as the rank files' libraries understand it; Python's own \s also takes four control characters.
_SPACE, _NOT_SPACE = r"\p{White_Space}", r"\P{White_Space}"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\S", _NOT_SPACE).replace(r"\s", _SPACE))


class ByteBPE:
    """Encoder and decoder of one rank file. Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, splitter(pattern)
        self.token = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.old_pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        last: dict[int, tuple[int, int]] = {}
        for t, r in ranks.items():
            parts = self.merges(t)
            if len(parts) <= 2:  # other tokens only occur as whole pieces
                self.automaton.add_word(t.decode("latin-1"), r)
                last[r] = tuple(ranks[p] for p in parts)
        self.automaton.make_automaton()
        # the longest token that starts a token, shorter than it
        self.shorter = {r: next((s for k in range(self.size[r] - 1, 0, -1) if (s := ranks.get(self.token[r][:k])) in last), -1) for r in last}
        self.last = {r: pair for r, pair in last.items() if len(pair) == 2}
        self.joined = {a << 32 | b: r for r, (a, b) in self.last.items()}

    def _edge(self, r: int, side: int) -> Iterator[tuple[int, int]]:
        """The tokens that stand at one edge while ``r`` is being made, each with the rank of the merge that ends it."""
        ends = 1 << 60
        while True:
            yield r, ends
            pair = self.last.get(r)
            if pair is None:
                return
            r, ends = pair[side], r

    def merges(self, piece: bytes) -> list[bytes]:
        """The merges of a token, carried out until two parts are left (one for a single byte)."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses from ``a`` to ``b``: two tokens that meet at their edges merge if that comes before
        what ends the left one, and before or along with what ends the right one (the leftmost of equals goes first)."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            got = self.old_pairs.get(key)
            if got is None:
                joined, none = self.joined, 1 << 61
                left = list(self._edge(b, 0))
                got = not any((m := joined.get(x << 32 | y, none)) < ends_x and m <= ends_y for x, ends_x in self._edge(a, 1) for y, ends_y in left)
            if len(self.pairs) >= CACHE:
                self.old_pairs, self.pairs = self.pairs, {}
            self.pairs[key] = got
        return got

    def backtrack(self, piece: bytes) -> list[int]:
        size, shorter, letters = self.size, self.shorter, piece.decode("latin-1")
        # every byte is a token, so the first match from a place on starts there; most pieces go the way of one scan
        matches, pairs, joined_up = self.automaton.iter_long, self.pairs.get, self.compatible
        longest = {end + 1 - size[r]: r for end, r in matches(letters)}
        open_ = bytearray(b"\1") * (len(piece) + 1)
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        while at < len(piece):
            while token >= 0 and not (open_[at + size[token]] and (before < 0 or pairs(before << 32 | token) or joined_up(before, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                before, token = token, -1
                if at < len(piece):
                    token = longest.get(at, -1)
                    if token < 0:
                        token = longest[at] = next(matches(letters, at))[1]
            else:  # nothing fits here: this position is closed, the token before gives way
                open_[at] = 0
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else -1
        return out

    def encode_piece(self, piece: str) -> bytes:
        b = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(b)
        return array("i", [whole] if whole is not None else self.backtrack(b)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        new, old, out = self.pieces, self.old_pieces, []
        for p in self.split.findall(text):
            ids = new.get(p)
            if ids is None:
                ids = old.get(p) or self.encode_piece(p)
                if len(p) <= CACHED_PIECE:
                    if len(new) >= CACHE:
                        self.old_pieces = old = new
                        self.pieces = new = {}
                    new[p] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(2)
def coder(path: str, pattern: str) -> ByteBPE:
    """One per Python worker and vocabulary."""
    return ByteBPE(read_ranks(path), pattern)


@lru_cache(2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per id where its bytes begin and how many they are, and the bytes of all tokens."""
    token = {r: t for t, r in read_ranks(path).items()}
    parts = [token.get(r, b"") for r in range(max(token) + 1)]
    size = np.array([len(p) for p in parts], np.int64)
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(parts), np.uint8)


def _schema(df: DataFrame, drop: str | None, *more: tuple[str, T.DataType]) -> tuple[T.StructType, list[str]]:
    fields = [f for f in df.schema.fields if f.name not in {drop, *(n for n, _ in more)}]
    return T.StructType([*fields, *(T.StructField(n, t) for n, t in more)]), [f.name for f in fields]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) in place of ``text``: each match of ``pattern`` encoded by the
    ranks in ``path``, no special tokens. Null and empty texts have no ids. Other columns stay; one named as ``ids`` is
    replaced. Row by row, without a shuffle: repeated rows stay repeated, an empty table stays empty."""
    schema, kept = _schema(docs, text, (ids, T.ArrayType(T.IntegerType(), False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            for lo in range(0, max(1, b.num_rows), 128):  # a few documents at a time
                part = b.slice(lo, 128)
                coded = [c.encode(x) if x else b"" for x in part.column(text).to_pylist()]
                ends = np.cumsum([0, *(len(p) // 4 for p in coded)], dtype=np.int64).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))])
                # the field must not be nullable, as the schema says
                lists = pa.ListArray.from_arrays(pa.array(ends), values).cast(pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), lists], names=[*kept, ids])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded", keep: bool = False) -> DataFrame:
    """``encoded`` with the bytes of ``ids`` (null: none) in the binary column ``into``, in place of ``ids`` or, with
    ``keep``, beside it."""
    schema, kept = _schema(encoded, None if keep else ids, (into, T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, size, every = byte_table(path)
        for b in batches:
            for lo in range(0, max(1, b.num_rows), 16):  # a few documents at a time
                part = b.slice(lo, 16)
                col = part.column(ids)
                flat = col.flatten().to_numpy(zero_copy_only=False)
                width = size[flat]
                ends = np.concatenate([[0], np.cumsum(width)])
                place = np.arange(ends[-1]) + np.repeat(first[flat] - ends[:-1], width)
                docs = ends[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))])]
                if docs[-1] >= 1 << 31:
                    raise ValueError("documents of over 2 GB together")
                text = pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(docs.astype("<i4").tobytes()), pa.py_buffer(every[place].tobytes())])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), text], names=[*kept, into])

    return encoded.mapInArrow(run, schema)
