"""Token ids in bit-plane files: chunks of whole documents, compressed plane by plane, with an index.

A dataset is two Parquet tables in one folder, so that any store Spark can write holds it and its commit protocol
guards against lost executors. ``chunks`` has a row per chunk: its ids, split into blocks of ``BLOCK`` ids, each block
transposed into the planes of its bits (all first bits, all second bits, ...), and each plane of the chunk compressed
with zstandard; planes of bits that no id of the chunk sets are not stored. ``index`` has a row per chunk too: part and chunk
number, number of ids and the lengths of its documents. Parts ascend with doc_id, chunks within a part too, so the
place of a document in the whole is the sum of what the index says before it.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T, Window as W
from tokenizers import Tokenizer

from reelspan.llm.common import id_order
from reelspan.llm.prefix_counts import LONGEST, Memo, byte_letters
from reelspan.session import ensure_checkpoint_dir

#: Steps before the merges that ``WordEncoder`` can take itself for words of simple letters.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_LETTERS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Simple words are visible ASCII and Latin letters that NFC leaves alone and whose lower case is one letter (for Arrow's RE2);
#: their pieces, and the line ends between words.
_LATIN = "À-ÖØ-öø-įı-ſ"
_SIMPLE = rf"\A[\x21-\x7E{_LATIN}]*\z"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|\n|[^a-z0-9{_LATIN}\n]+")
#: Stands for a line end among ids; no id is as large.
_MARK = 0xFFFFFFFF
#: Ids of a block, ids after which a chunk is closed, level of zstandard.
BLOCK, CHUNK, LEVEL = 8192, 1 << 18, 3
#: Words that go through the whole tokenizer at once; entries of a worker's cache of such words, and of its cache of pieces.
RUN, CACHE, PIECES = 64, 250_000, 400_000
#: Bytes of text whose distinct words are encoded at once; a longer text is taken alone.
SLICE = 1 << 22


# --- encoding -------------------------------------------------------------------------------------------------------

class WordEncoder:
    """A tokenizer that drops white space, applied to distinct words. Words are what ASCII white space separates; the
    tokenizer's own steps (NFC, lower case, splitting, merges) never look across it. Its normalizer and splitter take
    most of its time; where they are the known ones, simple words are lowered and split here, all at once, and each new
    piece goes to the tokenizer's merges. All other words go through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's work
        self.tokenizer = Tokenizer.from_file(path)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = not any(t[k] for t in spec["added_tokens"] for k in ("normalized", "single_word", "lstrip", "rstrip"))
        self.known = plain and not (spec["truncation"] or spec["padding"]) and spec["normalizer"] == {
            "type": "Sequence", "normalizers": _NORMAL} and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _LETTERS]}
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.pieces = Memo(self._merged, PIECES)

    def _merged(self, piece: str) -> bytes:
        if piece == "\n":
            return array("I", [_MARK]).tobytes()
        if not piece.isascii():  # visible ASCII is its own letter
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _simple(self, words: pa.Array) -> np.ndarray:
        ok = pc.match_substring_regex(words, pattern=_SIMPLE)
        for a in self.added:
            ok = pc.and_not(ok, pc.match_substring(words, pattern=a))
        return ok.to_numpy(zero_copy_only=False) & self.known

    def _split_here(self, words: pa.Array) -> pa.Array:
        """Ids of simple words: one pass over all of them, a line each."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py() + "\n"
        piece = self.pieces
        ids = np.frombuffer(b"".join([piece[p] for p in _PIECE.findall(text.lower())]), "<u4")
        marks = np.flatnonzero(ids == _MARK)
        ends = np.zeros(len(words) + 1, np.int32)
        ends[1:] = 4 * (marks - np.arange(len(marks)))
        return pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(ids[ids != _MARK].tobytes())])

    def _whole(self, words: list[str]) -> list[bytes]:
        """Ids of any words, by the whole tokenizer; those of short words are kept."""
        got = {w: b if (b := self.new.get(w)) is not None else self.old.get(w) for w in words}
        unknown = [w for w, b in got.items() if b is None]
        for lo in range(0, len(unknown), RUN):  # a word may be a whole text without spaces, and its encoding many times its size
            some = unknown[lo:lo + RUN]
            got.update((w, array("I", e.ids).tobytes()) for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)))
        if len(self.new) + len(got) > CACHE:
            self.old, self.new = self.new, {}
        self.new.update((w, b) for w, b in got.items() if len(w) <= LONGEST)
        return [got[w] for w in words]

    def coded(self, words: pa.Array) -> pa.Array:
        """The ids of each word of a string array, as bytes."""
        simple = self._simple(words)
        here, rest = words.filter(pa.array(simple)), words.filter(pa.array(~simple))
        out = pa.concat_arrays([self._split_here(here), pa.array(self._whole(rest.to_pylist()), pa.binary())])
        return out.take(pa.array(np.argsort(np.argsort(~simple, kind="stable")))) if len(rest) else out

    def ids(self, words: list[bytes]) -> list[bytes]:
        return self.coded(pa.array(words, pa.string())).to_pylist()

    def texts(self, texts: pa.Array, end: bytes) -> pa.Array:
        """The ids of each text, ``end`` behind them. Each distinct word is encoded once; Arrow finds and lays out the words."""
        split = pc.ascii_split_whitespace(texts)  # at the six ASCII white-space characters; empty words have no ids
        words = split.flatten().dictionary_encode()
        flat = self.coded(words.dictionary.cast(pa.string())).take(words.indices)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        at = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:][ends]
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(at)), flat.buffers()[2] or pa.py_buffer(b"")])
        return pc.binary_join_element_wise(ids, pa.scalar(end, pa.binary()), pa.scalar(b"", pa.binary()))


def _slices(b: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text, at least one row each."""
    ends, lo = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield b.slice(lo, hi - lo)
        lo = hi


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_ids(docs: DataFrame, path: str, end_id: int, cuts: np.ndarray | None = None, at_once: int = SLICE) -> DataFrame:
    """(part, place, doc_id, ids): ids as little-endian 32-bit integers, the end id last, null texts with the end id only;
    place is doc_id for ordering (``id_order``), part the range between ``cuts`` it lies in. About ``at_once`` bytes of
    text are encoded together."""
    cuts = np.zeros(0, np.int64) if cuts is None else cuts
    d = docs.select(id_order().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            for part in _slices(b, at_once):
                ranges = np.searchsorted(cuts, part.column("place").to_numpy(zero_copy_only=False), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranges), part.column("place"), part.column("doc_id"), enc.texts(part.column("text"), end)], names=["part", "place", "doc_id", "ids"])

    return d.mapInArrow(run, "part int, place long, doc_id long, ids binary")


# --- the file format ------------------------------------------------------------------------------------------------

def to_planes(ids: np.ndarray) -> list[bytes]:
    """The chunk's planes, lowest bit first, compressed; planes above its highest bit are left out."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    planes: list[list[np.ndarray]] = [[] for _ in range(width)]
    for lo in range(0, len(ids), BLOCK):
        block = ids[lo:lo + BLOCK]
        bits = np.unpackbits(np.ascontiguousarray(block, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        for k, plane in enumerate(np.packbits(np.ascontiguousarray(bits.T), axis=1)):
            planes[k].append(plane)
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return [pack(np.concatenate(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros(n, "<u4")
    size = BLOCK // 8
    unpack = zstandard.ZstdDecompressor().decompress
    for k, p in enumerate(planes):
        raw = np.frombuffer(unpack(p), np.uint8)
        whole = n // BLOCK
        bits = np.unpackbits(raw[:whole * size])
        rest = np.unpackbits(raw[whole * size:])[:n - whole * BLOCK]
        out |= np.concatenate([bits, rest]).astype("<u4") << np.uint32(k)
    return out


_CHUNK = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("planes", T.ArrayType(T.BinaryType()))])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, ids), sorted, into chunk rows. Only the chunk being filled is held."""
    part, number, docs, held, n = None, 0, [], [], 0

    def row():
        ids = np.frombuffer(b"".join(held), "<u4")
        sizes = [len(h) // 4 for h in held]
        cols = [[part], [number], [len(ids)], [list(docs)], [sizes], [to_planes(ids)]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_CHUNK.names)

    for b in batches:
        for p, d, ids in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids")):
            if docs and (p != part or n >= CHUNK):
                yield row()
                number = number + 1 if p == part else 0
                docs, held, n = [], [], 0
            elif p != part:
                number = 0
            part = p
            docs.append(d)
            held.append(ids.as_py())
            n += len(held[-1]) // 4
    if docs:
        yield row()


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, rows_a_part: int = 4096, most_parts: int = 50_000) -> str:
    """Encode ``docs`` and write a dataset in ascending doc_id order; returns its folder.

    Parts are ranges of doc_id between quantiles, at most ``most_parts`` numbers on the driver; ids are encoded before
    the shuffle, which carries ids instead of text, and a part is written as a stream. Without ``folder`` a new one
    below the shared checkpoint folder is taken. Null ids come last; rows that share an id go by their ids' bytes.
    """
    spark = docs.sparkSession
    order = id_order()
    n = docs.count()
    parts = max(1, min(most_parts, -(-n // rows_a_part)))
    cuts = docs.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], min(1_000_000, 20 * parts))).first()[0] if parts > 1 else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/token-ids-{uuid.uuid4().hex}"
    d = encode_ids(docs, tokenizer, end_id, cuts)
    d = d.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "place", "ids").drop("place")
    d.mapInArrow(_chunks, _CHUNK).write.option("compression", "none").parquet(f"{folder}/chunks")
    spark.read.schema(_CHUNK).parquet(f"{folder}/chunks").select("part", "chunk", "n_ids").write.parquet(f"{folder}/index")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_ids and ids (little-endian 32-bit) of every document of a dataset."""
    index = spark.read.parquet(f"{folder}/index")
    # two running sums: one over the parts, whose number is bounded, one within each part
    before = index.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    within = F.sum("n_ids").over(W.partitionBy("part").orderBy("chunk")) - F.col("n_ids")
    starts = index.select("part", "chunk", within.alias("_within")).join(before, "part")
    starts = starts.select("part", "chunk", (F.col("part_start") + F.col("_within")).alias("start"))
    d = spark.read.schema(_CHUNK).parquet(f"{folder}/chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part, chunk, n, docs, sizes, planes = (b.column(c)[i].as_py() for c in _CHUNK.names)
                raw = from_planes(planes, n).tobytes()
                ends = np.cumsum(sizes)
                at = ends - sizes
                rows = [pa.array([part] * len(docs), pa.int32()), pa.array([chunk] * len(docs), pa.int32()), pa.array(docs, pa.int64()),
                        pa.array(at, pa.int64()), pa.array(sizes, pa.int64()), pa.array([raw[4 * s:4 * e] for s, e in zip(at, ends)], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names=["part", "chunk", "doc_id", "offset", "n_ids", "ids"])

    d = d.mapInArrow(run, "part int, chunk int, doc_id long, offset long, n_ids long, ids binary")
    return d.join(starts, ["part", "chunk"]).select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_ids", "ids")

