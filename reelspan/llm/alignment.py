"""Alignment of two tokenizers over whole texts: groups of tokens that cover the same bytes, and counts of linked pairs.

Texts become lists of token ids, one column per tokenizer; from there on everything is Arrow columns: lists are
flattened, parent indices name each token's document, cumulative sums of token lengths less those before the document
give byte ends, an Acero hash join on (document, end) finds the tokens that end together, and ``Table.group_by`` counts
the id pairs of a task. Spark adds the tasks' counts up.

Two tokens that end together are suffixes of the same bytes, so one's bytes are a suffix of the other's: a token has at
most as many partners as it has bytes, and as many times that for those that two ids share. The table of all pairs is
therefore bounded by the two vocabularies' lengths (some 600,000 entries here), whatever the corpus; only such a
bounded table is sent to all executors.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from reelspan.llm.common import stage
from reelspan.llm.prefix_counts import byte_letters

#: Bytes of text handled at a time, distinct pairs a task holds before it adds its partial counts up, pairs in a row of counts.
AT_ONCE, HELD, ROW = 1 << 20, 1 << 20, 1 << 16
_LONG = ("n_a", "n_b", "n_groups", "n_links")


class Side:
    """One vocabulary: lengths and bytes of its tokens, and their ids as text with each sign that may follow."""

    def __init__(self, tokens: list[bytes], last: str):
        self.bytes = pa.array(tokens, pa.large_binary())
        self.size = pa.array([len(t) for t in tokens], pa.int64())
        self.text = pa.array([f"{i}{sign}" for i in range(len(tokens)) for sign in (",", last)], pa.large_string())


class Pair:
    """The two tokenizers and a dense number for every pair of tokens that can end together."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        letters = byte_letters()
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        # ids ascend with the merges, so they serve as ranks; no special tokens: their strings are plain text
        self.coder = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        p = self.pieces
        tokens_a = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens_a[i] = t
        single = np.array([p.is_byte(i) for i in range(p.vocab_size())])
        tokens_b = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if single[i] else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.vocab_size())]
        self.a, self.b = Side(tokens_a, "|"), Side(tokens_b, ";")
        # a pair's number: the longer token's first place and the shorter one's length (0: a single byte's own id)
        self.size_a, self.size_b = self.a.size.to_numpy(), self.b.size.to_numpy()
        self.short = np.where(single, 0, self.size_b)
        self.first_a = np.concatenate([[0], np.cumsum(self.size_a + 1)])
        self.first_b = self.first_a[-1] + np.concatenate([[0], np.cumsum(self.size_b + 1)])
        self.n_pairs = int(self.first_b[-1])

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self.size_b[b] <= self.size_a[a], self.first_a[a] + self.short[b], self.first_b[b] + self.size_a[a]).astype(np.int32)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of space + text by each tokenizer (the second one adds the space itself); no ids for an empty text."""
        none = np.zeros(0, np.int32)
        a = [self.coder.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int32) if t else none for t in texts]
        b = [np.array(ids, np.int32) if t else none for t, ids in zip(texts, self.pieces.encode(texts, num_threads=1))]
        return a, b


@lru_cache(2)
def pair(path_a: str, path_b: str, pattern: str) -> Pair:
    """One per Python worker and pair of tokenizers."""
    return Pair(path_a, path_b, pattern)


def _lists(ids: list[np.ndarray]) -> pa.LargeListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def _whole(ids: list[np.ndarray], side: Side, want: list[bytes]) -> list[bool]:
    """Whether each document's tokens, joined, are its bytes."""
    joined = side.bytes.take(pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
    at = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1) if len(joined) else np.zeros(1, np.int64)
    ends = at[np.cumsum([0, *map(len, ids)])]
    data = memoryview(joined.buffers()[2] or b"").cast("B")
    return [len(i) > 0 and data[s:e] == w for i, s, e, w in zip(ids, ends, ends[1:], want)]


def _byte_ends(lists: pa.LargeListArray, side: Side) -> tuple[pa.Array, np.ndarray]:
    """Ids in one column, and for each the key of its document and byte end."""
    ids = lists.flatten()
    parent = pc.list_parent_indices(lists).to_numpy()
    ends = pc.cumulative_sum(side.size.take(ids)).to_numpy()
    before = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
    return ids, parent << 32 | (ends - before[parent])


class Aligned:
    """Links, groups and sizes of a few documents."""

    def __init__(self, p: Pair, texts: list[str]):
        a, b = p.encode(texts)
        want = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
        ok = [x and y for x, y in zip(_whole(a, p.a, want), _whole(b, p.b, want))]
        none = np.zeros(0, np.int32)
        la, lb = (_lists([i if k else none for i, k in zip(ids, ok)]) for ids in (a, b))
        (self.a, key_a), (self.b, key_b) = _byte_ends(la, p.a), _byte_ends(lb, p.b)
        left = pa.table({"key": key_a, "at_a": np.arange(len(key_a))})
        right = pa.table({"key": key_b, "at_b": np.arange(len(key_b))})
        met = left.join(right, "key", join_type="inner", use_threads=False)
        at_a, at_b = met["at_a"].to_numpy(), met["at_b"].to_numpy()
        order = np.argsort(at_a)  # the join's order is free
        self.at_a, self.at_b = at_a[order], at_b[order]
        self.start_a, self.start_b = la.offsets.to_numpy(), lb.offsets.to_numpy()
        self.start_link = np.searchsorted(self.at_a, self.start_a)
        ids_a, ids_b = self.a.to_numpy(), self.b.to_numpy()
        self.linked_a, self.linked_b = ids_a[self.at_a], ids_b[self.at_b]
        self.p = p

    def counts(self) -> pa.Table:
        t = pa.table({"a": self.linked_a, "b": self.linked_b, "n": np.ones(len(self.linked_a), np.int64)})
        return t.group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])

    def groups(self) -> list[bytes]:
        """Per document its groups, ``a1,a2|b1;a3|b2,b3``: ids of both sides between ends that both have."""
        n_a, n_b = len(self.a), len(self.b)
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        last_a[self.at_a], last_b[self.at_b] = 1, 1
        # a token stands behind its own side's tokens before it and those of the other side in groups before it (a) or up to its own (b)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        place_a = np.arange(n_a) + np.concatenate([[0], self.at_b + 1])[group_a]
        place_b = np.arange(n_b) + (self.at_a + 1)[group_b]
        shown = np.empty(n_a + n_b, np.int64)
        shown[place_a] = self.a.to_numpy().astype(np.int64) * 2 + last_a
        shown[place_b] = self.b.to_numpy().astype(np.int64) * 2 + last_b + len(self.p.a.text)
        text = _texts(self.p).take(pa.array(shown))
        if not len(text):
            return [b""] * (len(self.start_a) - 1)
        at, data = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1), memoryview(text.buffers()[2])
        cuts = at[self.start_a + self.start_b]
        return [bytes(data[s:e - 1]) if e > s else b"" for s, e in zip(cuts, cuts[1:])]


@lru_cache(2)
def _texts(p: Pair) -> pa.Array:
    return pa.concat_arrays([p.a.text, p.b.text])


def _slices(b: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most AT_ONCE bytes of text, or a single row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, side="right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def links(docs: DataFrame, path_a: str, path_b: str, pattern: str, text: str = "text", digest: bool = False) -> DataFrame:
    """One row per document and, last in each task, rows of the task's partial counts, told apart by ``doc`` being null.

    ``doc`` holds the columns of ``docs`` but ``text`` as one value; n_a, n_b, n_groups, n_links longs; ``groups`` the text
    of the groups or, with ``digest``, its SHA-256 as lowercase hex; ``pairs`` the number of each link's id pair.
    ``a``, ``b``, ``n`` are the partial counts of id pairs.
    """
    kept = [f for f in docs.schema.fields if f.name != text]
    inner = T.StructType(kept) if kept else T.StructType([T.StructField("_", T.IntegerType())])
    d = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in kept] or [F.lit(0).alias("_")]).alias("doc"), F.col(f"`{text}`").alias("text"))
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("doc", inner), *(T.StructField(n, T.LongType()) for n in _LONG), T.StructField("groups", T.StringType()),
                           T.StructField("pairs", ints), T.StructField("a", ints), T.StructField("b", ints), T.StructField("n", longs)])
    names = schema.names
    kinds = {"groups": pa.string(), "pairs": pa.list_(pa.int32()), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "n": pa.list_(pa.int64()), **{n: pa.int64() for n in _LONG}}

    def row_batch(n: int, cols: dict[str, pa.Array], doc: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc, *(cols[c] if c in cols else pa.nulls(n, kinds[c]) for c in names[1:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(path_a, path_b, pattern)
        partial: list[pa.Table] = []
        held, doc_type = 0, None
        for b in batches:
            doc_type = b.schema.field("doc").type
            for part in _slices(b, "text"):
                x = Aligned(p, [t or "" for t in part.column("text").to_pylist()])
                shown = x.groups()
                shown = [hashlib.sha256(g).hexdigest() if g else "" for g in shown] if digest else [g.decode() for g in shown]
                sizes = dict(zip(_LONG, (np.diff(s) for s in (x.start_a, x.start_b, x.start_link, x.start_link))))
                pairs = pa.ListArray.from_arrays(pa.array(x.start_link, pa.int32()), pa.array(p.number(x.linked_a, x.linked_b)))
                yield row_batch(part.num_rows, {**{n: pa.array(s, pa.int64()) for n, s in sizes.items()}, "groups": pa.array(shown, pa.string()), "pairs": pairs}, part.column("doc"))
                partial.append(x.counts())
                held += len(partial[-1])
                if held > HELD:
                    partial = [_added(partial)]
                    held = len(partial[0])
        if held:
            t = _added(partial)
            cuts = np.append(np.arange(0, len(t), ROW), len(t)).astype(np.int32)
            cols = {c: pa.ListArray.from_arrays(pa.array(cuts), t[c].combine_chunks()) for c in ("a", "b", "n")}
            yield row_batch(len(cuts) - 1, cols, pa.nulls(len(cuts) - 1, doc_type))

    return d.mapInArrow(run, schema)


def _added(partial: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(partial).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
    return t.rename_columns(["a", "b", "n"])


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, n (links that hold the pair), best (whether n is the highest among the pairs of b) of all linked id pairs. found: ``links``."""
    c = found.where("doc IS NULL").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
    c = c.groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = c.groupBy("b").agg(F.max("n").alias("most"))
    return c.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str, text: str = "text", digest: bool = False) -> DataFrame:
    """Every document with the alignment of its tokens by two tokenizers, in place of ``text``.

    path_a: a byte-level BPE of the tokenizers library over space + text, ``pattern`` its splitter; path_b: a sentencepiece
    model with byte fallback, which adds the space. n_a, n_b: tokens; n_groups: pieces between byte offsets where tokens
    of both end; n_links: pairs of tokens that end together; n_best: links whose id pair is its b id's most frequent one
    over all documents, ties included; count_sum: sum over links of the pairs' counts; groups: see ``links``.

    Null and empty texts, and texts whose tokens of either side do not join to space + text, have zeros and an empty
    string. Other columns stay; those named as a result are replaced. Row by row: repeated rows count each and stay
    repeated; an empty table stays empty. One text is held by one worker.
    """
    spark = docs.sparkSession
    results = (*_LONG, "n_best", "count_sum", "groups")
    found = stage(links(docs.drop(*results), path_a, path_b, pattern, text, digest))
    p = pair(path_a, path_b, pattern)
    counts = pair_counts(found).toArrow()  # at most n_pairs rows, a bound of the vocabularies
    n, best = np.zeros(p.n_pairs, np.int64), np.zeros(p.n_pairs, np.int8)
    number = p.number(counts["a"].to_numpy(), counts["b"].to_numpy()) if len(counts) else np.zeros(0, np.int32)
    if len(number):
        n[number], best[number] = counts["n"].to_numpy(), counts["best"].to_numpy()
    table = spark.sparkContext.broadcast((n, best))
    d = found.where("doc IS NOT NULL").drop("a", "b", "n")
    rest = [f for f in d.schema.fields if f.name != "pairs"]
    schema = T.StructType([*rest, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = table.value
        for b in batches:
            pairs = b.column("pairs")
            flat = pairs.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(pairs).to_numpy(zero_copy_only=False))]).astype(np.int64)
            sums = [np.diff(np.concatenate([[0], np.cumsum(v[flat], dtype=np.int64)])[ends]) for v in (best, n)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), *(pa.array(s, pa.int64()) for s in sums)], names=schema.names)

    out = d.mapInArrow(run, schema)
    kept = [c for c in docs.columns if c not in (text, *results)]
    return out.select(*[F.col(f"doc.`{c}`") for c in kept], *results)
