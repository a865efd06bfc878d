"""Token counts at every prefix of a text, by dynamic programming over the merges of a word-level BPE.

A split of a word into tokens is the one the merges give exactly if every adjacent pair of tokens, joined and merged
alone, falls into the same two tokens again. So the encoding of a prefix ends in the one token that goes with the last
token of the shorter prefix before it: ``last[e] = t`` where t spans s..e and goes with ``last[s]``, and
``count[e] = count[s] + 1``. One pass over a word gives the count of each of its prefixes, inside the word (tokens
without the word-end mark) and as the end of a text (with it). Texts are sums over their words, so the array of counts
answers at once how many tokens any prefix has and how long a prefix fits a budget; nothing is encoded again.

Positions are code points of the text as it stands. The tokenizer composes combining characters (NFC): a prefix that
ends inside such a sequence has the count of the prefix before the sequence, as a cut there would break a character.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T
from tokenizers import Tokenizer

#: Entries of a worker's caches of pieces and of token pairs; a full cache of pieces becomes the old one, from which what
#: is asked for again moves to the new one. Longer pieces are not kept.
PIECES, PAIRS, LONGEST = 200_000, 400_000, 48
END, START = "</w>", 1 << 24
#: White space as the tokenizer's normalizer knows it.
_SPACE = r"\x20\x09-\x0D\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_UNIT, _TAIL = re.compile(rf"[^{_SPACE}]+[{_SPACE}]*|[{_SPACE}]+"), re.compile(rf"[{_SPACE}]+\Z")
#: Letters that NFC leaves alone and whose lower case is one letter: ASCII and Latin up to U+024F without U+0130.
_LATIN = "À-ÖØ-öø-įı-ɏ"
_SIMPLE = re.compile(rf"[\x00-\x7F{_LATIN}]*\Z")
#: The splitter's pieces of such text, each with the white space behind it; white space that begins a text.
_PIECE = re.compile(rf"(?:'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^{_SPACE}a-z0-9{_LATIN}]+)[{_SPACE}]*|[{_SPACE}]+")
#: Sequences that NFC may compose: a character with the marks or Hangul vowels and finals behind it.
_COMPOSED = regex.compile(r"(?s).[\p{M}ᅠ-ᇿힰ-퟿]*")


def byte_letters() -> dict[str, int]:
    """The letter byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Memo(dict):
    """Results by piece, found at a dictionary's speed; ``most`` of them, then as many older ones."""

    def __init__(self, compute: Callable[[str], bytes], most: int | None = None):
        super().__init__()
        self.compute, self.old, self.most = compute, {}, most

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece) or self.compute(piece)
        if len(piece) <= LONGEST:
            if len(self) >= (self.most or PIECES):
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class PrefixCounter:
    """Counts of one tokenizers file: BPE over byte letters with word-end marks, pieces by its own normalizer and splitter."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.letters = letters
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merge: dict[int, int] = {}  # a pair of tokens -> rank of their merge
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merge[left << 32 | right] = rank
            self.parts[made], self.rank[made] = (left, right), rank
        self.pairs: dict[int, bool] = {}
        # bytes of tokens, read as Latin-1, with the token they are inside a word and at its end
        self.found = ahocorasick.Automaton()
        bodies: dict[str, list[int]] = {}
        for token, i in vocab.items():
            pair = self.parts.get(i)
            if pair and not (self.compatible_parts(*pair) and self.made_whole(*pair)):
                continue  # the merges never come to it
            ends = token.endswith(END) and len(token) > len(END)
            body = bytes(letters[c] for c in (token[:-len(END)] if ends else token)).decode("latin-1")
            bodies.setdefault(body, [-1, -1])[ends] = i
        for body, (inside, at_end) in bodies.items():
            self.found.add_word(body, (len(body), inside, at_end))
        self.found.make_automaton()
        self.memo = Memo(self.steps)

    def _edge(self, t: int, side: int) -> Iterator[tuple[int, int]]:
        """The tokens at one edge while ``t`` is made, each with the rank of the merge that ends it."""
        ends = 1 << 60
        while True:
            yield t, ends
            pair = self.parts.get(t)
            if pair is None:
                return
            t, ends = pair[side], self.rank[t]

    def crosses(self, a: int, b: int, below: int) -> bool:
        """Whether a merge of rank under ``below`` crosses from ``a`` to ``b``; the leftmost of equal merges goes first."""
        merge, none, left = self.merge, 1 << 61, list(self._edge(b, 0))
        return any((m := merge.get(x << 32 | y, none)) < min(ends_x, below) and m <= ends_y for x, ends_x in self._edge(a, 1) for y, ends_y in left)

    def compatible_parts(self, a: int, b: int) -> bool:
        """Whether the two parts of a token stay apart until the merge that joins them."""
        return not self.crosses(a, b, self.merge[a << 32 | b])

    def made_whole(self, a: int, b: int) -> bool:
        return all(p not in self.parts or self.rank[p] < self.merge[a << 32 | b] for p in (a, b))

    def fits(self, pair: int) -> bool:
        """Whether the second token of a pair may follow the first; every token may follow START."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = pair >> 32, pair & 0xFFFFFFFF
        got = self.pairs[pair] = a == START or not self.crosses(a, b, 1 << 60)
        return got

    def piece(self, letters: str) -> list[int]:
        """Tokens of each prefix of a piece that ends there, by its bytes read as Latin-1, from the first byte on."""
        n = len(letters)
        last, count, whole = [START << 32] + [0] * n, [0] * (n + 1), [0] * n
        known, fits = self.pairs.get, self.fits
        for e, (size, inside, at_end) in self.found.iter(letters):  # ends ascend; of one end the longest comes first
            s = e + 1 - size
            if at_end >= 0 and not whole[e]:
                pair = last[s] | at_end
                ok = known(pair)
                if ok or ok is None and fits(pair):
                    whole[e] = count[s] + 1
            if inside >= 0 and not count[e + 1]:
                pair = last[s] | inside
                ok = known(pair)
                if ok or ok is None and fits(pair):
                    last[e + 1] = inside << 32
                    count[e + 1] = count[s] + 1
        return whole

    def text_piece(self, piece: str, raw: bytes) -> list[int]:
        """Tokens of each prefix of a piece, by code points, from the first on."""
        whole = self.piece(raw.decode("latin-1"))
        if len(raw) != len(piece):  # where characters end
            whole = [w for w, following in zip(whole, raw[1:] + b" ") if following & 0xC0 != 0x80]
        if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):  # two letters of them are a sign and a letter
            whole[1] = whole[0] + self.piece(piece[1])[0]
        return whole

    def steps(self, piece: str) -> bytes:
        """Steps of the count over a piece of simple letters and the white space behind it, as 32-bit integers."""
        body = _TAIL.sub("", piece)
        counts = self.text_piece(body, body.encode()) if body else []
        return array("i", [*map(sub, counts, [0, *counts]), *[0] * (len(piece) - len(body))]).tobytes()

    def word(self, word: str) -> list[int]:
        """Tokens of each prefix of a word of any characters, by its code points."""
        normal = self.tokenizer.normalizer.normalize_str(word)
        at, total, counts = 0, 0, [0]
        for p, (lo, hi) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
            counts += [total] * (lo - at)
            counts += [total + k for k in self.text_piece(normal[lo:hi], bytes(self.letters[c] for c in p))]
            at, total = hi, counts[-1]
        counts += [total] * (len(normal) - at)
        if len(normal) == len(word) and not regex.search(r"[\p{M}ᅠ-ᇿힰ-퟿]", word):
            return counts[1:]
        out, at = [], 0
        for seq in _COMPOSED.findall(word):
            before = counts[at]
            at += len(self.tokenizer.normalizer.normalize_str(seq))
            out += [before] * (len(seq) - 1) + [counts[at]]
        return out

    def ordinary(self, text: str, out: list[bytes]) -> None:
        """Appends the steps of a text without special strings."""
        if _SIMPLE.match(text):
            out.extend(map(self.memo.__getitem__, _PIECE.findall(text.lower())))
            return
        for u in _UNIT.findall(text):
            if _SIMPLE.match(u):
                self.ordinary(u, out)
            else:
                word = _TAIL.sub("", u)
                counts = self.word(word) if word else []
                out.append(array("i", [*map(sub, counts, [0, *counts]), *[0] * (len(u) - len(word))]).tobytes())

    def counts(self, text: str) -> np.ndarray:
        """Tokens of each prefix of a text; a special string counts as one token once it is complete."""
        steps: list[bytes] = []
        at = 0
        if self.special and "<|" in text:
            for m in self.special.finditer(text):
                # up to its last character the string is ordinary text behind what stands before it
                part: list[bytes] = []
                self.ordinary(text[at:m.end() - 1], part)
                counts = np.cumsum(np.frombuffer(b"".join(part), np.int32))
                before = int(counts[m.start() - at - 1]) if m.start() > at else 0
                steps.append(np.diff(counts, prepend=0, append=before + 1).astype(np.int32).tobytes())
                at = m.end()
        self.ordinary(text[at:], steps)
        return np.cumsum(np.frombuffer(b"".join(steps), np.int32), dtype=np.int32)


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    """One per Python worker and tokenizer."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str, text: str = "text", into: str = "counts") -> DataFrame:
    """``docs`` with the array ``into`` in place of ``text``: entry i is the number of tokens of the first i + 1 code points.

    Without begin or end tokens; special strings in texts are special tokens, the library's default. Null and empty texts
    have empty arrays. Other columns stay, one named as ``into`` is replaced. Row by row, without a shuffle: repeated rows
    stay repeated, an empty table stays empty.
    """
    fields = [f for f in docs.schema.fields if f.name not in (text, into)]
    kept = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField(into, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for lo in range(0, max(1, b.num_rows), 64):  # a few documents at a time
                part = b.slice(lo, 64)
                found = [c.counts(x) if x else np.zeros(0, np.int32) for x in part.column(text).to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
                lists = lists.cast(pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), lists], names=[*kept, into])

    return docs.mapInArrow(run, schema)


def tokens_of(counts: Column, n_chars: Column | int | None = None) -> Column:
    """Tokens of the first ``n_chars`` code points (of the whole text without it, or where it is longer), as a long."""
    n = F.size(counts) if n_chars is None else F.least(F.size(counts), F.lit(n_chars) if isinstance(n_chars, int) else n_chars)
    return F.coalesce(F.when(n > 0, F.get(counts, n - 1)), F.lit(0)).cast("long")


def longest_within(counts: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, as a long.

    A longer prefix may have fewer tokens, so the last fitting one is taken."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    n = F.size(counts)
    from_end = F.array_position(F.reverse(F.transform(counts, lambda c: c <= b)), True)
    return F.when(tokens_of(counts) <= b, n).otherwise(F.when(from_end > 0, n - from_end + 1).otherwise(0)).cast("long")
