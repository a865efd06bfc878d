"""SimHash fingerprints, their links at few differing bits by a Gray-order hierarchical index, and the groups.

The index. A pair that differs in at most two of 64 bits agrees on one of three blocks of bits. Each fingerprint is
rotated so that one block stands on top, for each of the three blocks; the block's bits are the root pattern of a
group, and only members of one group are compared. A group above ``GROUP`` members gets a further level: its free
bits are cut into three blocks again, of which one must agree. After three levels at most 20 bits are free, so that a
group has a bound that does not depend on the table. Within a group fingerprints are sorted by Gray rank, where
neighbours share most bits; runs of neighbours form nodes, runs of nodes upper nodes, and each node keeps the bits all
its members share. A search goes down from the upper nodes, adds up the differences on the shared bits, counts bits
already counted above no second time, and leaves out every node whose sum exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reelspan.llm.common import first_of_groups, id_order, row_keys, stage
from reelspan.llm.components import components

BITS, RADIUS = 64, 2
#: Members above which a group is divided by its free bits; fan-out of the index; fingerprints searched at once.
GROUP, FAN, AT_ONCE = 8192, 16, 256
_U = np.uint64


def fingerprint(text: str | None, words: int = 3, chunk: int = 1 << 16) -> int:
    """Signed 64-bit value. Bit i is set if it is set in over half of the shingles' hashes."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones, h = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, chunk):
        part = w[lo:min(lo + chunk, n) + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
        v = np.fromiter((h(s, 42) for s in shingles), "<u8")
        ones += np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """_k1, _k2 (``row_keys``), doc_id and ``fp`` of every row. Null texts count as empty, whose fingerprint is zero."""
    k1, k2 = row_keys()
    cols = docs.select(k1.alias("_k1"), k2.alias("_k2"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([*(f for f in cols.schema.fields if f.name != "text"), T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array((fingerprint(x.as_py(), words) for x in b.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_k1"), b.column("_k2"), b.column("doc_id"), fp], names=["_k1", "_k2", "doc_id", "fp"])

    return cols.mapInArrow(run, schema)


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> _U(s)
    return v


class GrayIndex:
    """Hierarchical index of one group of distinct fingerprints, sorted by Gray rank."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(np.full(len(codes), ~_U(0)), codes)]
        while len(self.levels[-1][0]) > FAN:
            mask, bits = self.levels[-1]
            at = np.arange(0, len(mask), FAN)
            both, none = np.bitwise_and.reduceat(bits & mask, at), np.bitwise_and.reduceat(~bits & mask, at)
            self.levels.append((both | none, both))

    def search(self, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """All (query, member) positions at ``radius`` or fewer differing bits."""
        mask, bits = self.levels[-1]
        q, node = (x.ravel() for x in np.indices((len(queries), len(mask))))
        sums = np.zeros(len(q), np.uint8)
        counted = np.zeros(len(q), _U)
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, bits = self.levels[depth]
            sums = sums + np.bitwise_count((queries[q] ^ bits[node]) & mask[node] & ~counted)
            near = sums <= radius
            q, node, sums = q[near], node[near], sums[near]
            if depth:
                counted = np.repeat(mask[node], FAN)
                below = len(self.levels[depth - 1][0])
                q, sums = np.repeat(q, FAN), np.repeat(sums, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < below
                q, node, sums, counted = q[there], node[there], sums[there], counted[there]
        return q, node


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable by the pairs, given what earlier pairs have joined."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return labels
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(labels, high, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def linked(codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a group's links: (code, the code its tree hangs on), without the latter themselves."""
    codes = np.unique(codes)
    codes = codes[np.argsort(gray_rank(codes))]
    labels = np.arange(len(codes))
    index = GrayIndex(codes)
    for lo in range(0, len(codes), AT_ONCE):
        q, m = index.search(codes[lo:lo + AT_ONCE], radius)
        labels = join_labels(labels, q + lo, m)
    moved = labels != np.arange(len(codes))
    return codes[moved], codes[labels[moved]]


def _links_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group may go on in the next batch."""
    rest_key, rest = None, []

    def out(groups):
        pairs = [linked(g) for g in groups if len(g) > 1]
        a, b = (np.concatenate([p[k] for p in pairs]).view("<i8") if pairs else np.zeros(0, "<i8") for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("g1", "g2")])
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(_U)
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        parts = np.split(fp, cuts)
        done = []
        if rest_key is not None and (key[:, 0] != rest_key).any():
            done.append(np.concatenate(rest))
            rest = []
        if len(parts) > 1:
            done += [np.concatenate([*rest, parts[0]]), *parts[1:-1]]
            rest = []
        rest.append(parts[-1])
        rest_key = key[:, -1]
        yield out(done)
    if rest:
        yield out([np.concatenate(rest)])


#: Blocks of the three levels as (first bit, number of bits): of all 64, of the 43 that are then free, of the 29 or so after that.
def _blocks(free: list[int]) -> list[list[int]]:
    k = -(-len(free) // 3)
    return [free[:k], free[k:2 * k], free[2 * k:]]


def _mask(bits: list[int]) -> int:
    v = sum(1 << i for i in bits)
    return v - (1 << 64) if v >> 63 else v


def _paths(level: int) -> list[tuple[int, ...]]:
    """Masks that a group of this level has fixed, one row for each way to choose the blocks."""
    out: list[tuple[list[int], list[int]]] = [([], list(range(BITS)))]
    for _ in range(level):
        out = [(fixed + blk, [b for b in free if b not in blk]) for fixed, free in out for blk in _blocks(free)]
    return [_mask(fixed) for fixed, _ in out]


def links(fps: DataFrame, group: int = GROUP, levels: int = 3) -> DataFrame:
    """a, b: links of the distinct fingerprints in ``fps`` (fp long) that span every group linked at RADIUS or fewer bits.

    Each level groups by the bits that its masks fix. Groups of at most ``group`` members are searched, larger ones go
    on to the next level, where each member takes part three times; the last level takes what comes.
    """
    found = None
    rows = fps.select("fp", F.lit(0).alias("path"))
    for level in range(1, levels + 1):
        masks = F.array(*[F.lit(m).cast("long") for m in _paths(level)])
        path = F.explode(F.array(*[(F.col("path") * 3 + i).cast("int") for i in range(3)]))
        rows = rows.select("fp", path.alias("path"))
        rows = rows.select("fp", "path", F.col("path").cast("long").alias("g1"), F.col("fp").bitwiseAND(F.element_at(masks, F.col("path") + 1)).alias("g2"))
        sizes = rows.groupBy("g1", "g2").agg(F.count("*").alias("size")).where("size > 1")
        rows = stage(rows.join(sizes, ["g1", "g2"]))
        here = rows if level == levels else rows.where(F.col("size") <= group)
        here = here.select("g1", "g2", "fp").repartition("g1", "g2").sortWithinPartitions("g1", "g2")
        got = here.mapInArrow(_links_of_partition, "a long, b long")
        found = got if found is None else found.union(got)
        rows = rows.where(F.col("size") > group).select("fp", "path")
        if level < levels and rows.isEmpty():
            break
    return found


def near_groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """_k1, _k2, doc_id, fp, component (a fingerprint that names it) and component_id of every row: the smallest doc_id
    that links of at most RADIUS bits reach.

    Null ids count as the largest and are never a component_id, unless a component has no other (null then). Equal
    fingerprints are one node, however many rows have them; texts without words (also null) have fingerprint zero and
    are linked like any other. An empty table gives none.
    """
    rows = stage(with_fingerprints(docs, words))
    fps = stage(rows.groupBy("fp").agg(F.min(id_order()).alias("low")))
    comp = components(links(fps)).withColumnRenamed("node", "fp")
    fps = stage(fps.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    lows = fps.groupBy("component").agg(F.min("low").alias("component_id"))
    named = fps.join(lows, "component").select("fp", "component", F.when(F.col("component_id") < (1 << 63) - 1, F.col("component_id")).alias("component_id"))
    return rows.join(named, "fp").select("_k1", "_k2", "doc_id", "fp", "component", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id (and text hash, should ids repeat). Same columns."""
    return first_of_groups(docs, near_groups(docs, words))
