"""MinHash fingerprints of word shingles, and near-duplicate groups from bands of them.

Shingles are ``words`` consecutive words, hashed from the text's bytes in numpy, a batch of texts at a time; the
signature is the minimum under each of ``PERMUTATIONS`` random functions a*x + b modulo 2^64, of which the upper 32
bits count (multiply-shift, pairwise independent for 32-bit x).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from reelspan.llm.common import first_of_groups, id_order, row_keys, stage
from reelspan.llm.components import components

PERMUTATIONS, WORDS, SIMILARITY, SEED = 128, 5, 0.8, 20240501
#: Bands of a signature. A pair at similarity 0.8 misses all of them with probability (1 - 0.8^4)^32 = 5e-8.
BANDS = 32
#: Shingles of a text permuted at once.
_AT_ONCE = 2048
_U = np.uint64


def _functions(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 64, n, dtype=_U, endpoint=False) | _U(1), r.integers(0, 1 << 64, n, dtype=_U)


A, B = _functions()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _powers(n: int, base: np.uint64, _kept: dict = {}) -> np.ndarray:  # noqa: B006  grows to the longest text of the worker
    if base not in _kept or len(_kept[base]) < n:
        with np.errstate(over="ignore"):
            _kept[base] = np.cumprod(np.concatenate([[_U(1)], np.full(max(n, 4096) * 2, base, _U)]))
    return _kept[base][:n]


def words_at(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a text, in order, and the byte it starts at."""
    b = np.frombuffer(text, np.uint8)
    inside = ~_SPACE[b]
    if not inside.any():
        return np.zeros(0, _U), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a polynomial in the byte's place within its word, and the word's length
    at = np.flatnonzero(inside)
    size = end - start
    place = at - np.repeat(start, size)
    terms = (b[at].astype(_U) + _U(1)) * _powers(int(size.max()), _BASE)[place]
    return _mix(np.add.reduceat(terms, np.cumsum(size) - size) + size.astype(_U) * _STEP), start


def word_hashes(text: bytes) -> np.ndarray:
    return words_at(text)[0]


def shingle_hashes(text: str | None, words: int = WORDS, lower: bool = False) -> np.ndarray:
    """A 32-bit hash of each shingle, repeats included; a text of fewer words is one shingle, one without words has none.
    ``lower``: A-Z in lower case."""
    b = (text or "").encode("utf-8", "surrogatepass")
    w = word_hashes(b.lower() if lower else b)
    if len(w) == 0:
        return w
    k = min(words, len(w))
    s = np.zeros(len(w) - k + 1, _U)
    for i in range(k):
        s = s * _STEP + w[i:len(w) - k + 1 + i]
    return _mix(s + _U(k)) >> _U(32)


def signature(text: str | None, words: int = WORDS) -> np.ndarray:
    """PERMUTATIONS 32-bit minima; all ones for a text without words."""
    return minima(np.unique(shingle_hashes(text, words)))


def minima(s: np.ndarray) -> np.ndarray:
    low = np.full(PERMUTATIONS, ~_U(0))
    for at in range(0, len(s), _AT_ONCE):
        low = np.minimum(low, (s[at:at + _AT_ONCE] * A[:, None] + B[:, None]).min(axis=1))
    return (low >> _U(32)).astype("<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima: an estimate of the Jaccard similarity of the shingles, standard error below 0.045."""
    return float((a == b).mean())


def fingerprint(sig: np.ndarray) -> str:
    return sig.tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of a text, rounded down, replaced by as many first code points of the following one."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def with_neighbour(docs: DataFrame, bytes_a_part: int = 8 << 20, most_parts: int = 50_000) -> DataFrame:
    """Rows (doc_id, text) dealt out in ranges of descending doc_id; each range is sorted and followed by the first row
    of the next range (guest = true), the last by the first row of all.

    The text is shuffled once, and a range is read as a stream, so its size bounds no task. Range bounds are quantiles
    of doc_id, at most ``most_parts`` numbers on the driver. Null ids come last; rows that share an id go by a hash of
    the text.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumns({"_o": -F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63) + 1)), "_h": F.xxhash64("text")})
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(most_parts, -(-total // bytes_a_part)))
    cuts = d.agg(F.percentile_approx("_o", [i / parts for i in range(1, parts)], min(1_000_000, 20 * parts))).first()[0] if parts > 1 else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("int")
    def range_of(o: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, o.to_numpy(), side="right").astype(np.int32))

    # the udf sees the ids only
    d = d.withColumn("part", range_of("_o"))
    heads = {r.part: r.head for r in d.groupBy("part").agg(F.min("_o").alias("head")).collect()}
    order = sorted(heads) or [0]
    hosts = spark.createDataFrame([(int(heads[p]), int(order[i - 1])) for i, p in enumerate(order) if p in heads], "_o long, host int")
    first = F.min(F.struct("_h", "doc_id", "text", "_o")).alias("f")
    guests = d.drop("part").join(F.broadcast(hosts), "_o").groupBy("host").agg(first)  # two numbers a range are broadcast
    both = d.select("part", F.lit(False).alias("guest"), "_o", "_h", "doc_id", "text").union(
        guests.select("host", F.lit(True), "f._o", "f._h", "f.doc_id", "f.text"))
    return both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "guest", "_o", "_h").select("guest", "doc_id", "text")


def neighbour_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its ``edited`` text, made from it and the next by descending doc_id.

    Returns doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (0 to
    1). Null texts count as empty; texts without words are like each other only. A single row is its own next. Repeated
    rows are neighbours of each other. An empty table gives none.
    """
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            rows = []
            for guest, doc, text in zip(b.column("guest").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py()
                sig = signature(text)
                if before is not None:
                    i, t, s = before
                    e = edited(t, text)
                    es = signature(e)
                    sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((i, len(t), sha, fingerprint(s), fingerprint(es), likeness(s, es), likeness(s, sig)))
                before = None if guest else (doc, text, sig)
            cols = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=list(names))

    near = with_neighbour(docs)
    near = near.withColumn("doc_id", F.col("doc_id").cast("long"))
    return near.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _with_sets(docs: DataFrame, keep: tuple[str, ...], lower: bool, shingles: bool) -> DataFrame:
    """``keep`` of every row, ``class`` (a hash of its set of shingles, 0 for none), its signature and, if asked for, its
    shingles (sorted distinct 32-bit hashes), both binary."""
    cols = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    more = [T.StructField("class", T.LongType(), False), T.StructField("signature", T.BinaryType(), False)]
    more += [T.StructField("shingles", T.BinaryType(), False)] if shingles else []
    schema = T.StructType([*(f for f in cols.schema.fields if f.name != "text"), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = [np.unique(shingle_hashes(t.as_py(), lower=lower)) for t in part.column("text")]
                packed = [s.astype("<u4").tobytes() for s in sets]
                named = [xxhash.xxh64_intdigest(x) - (1 << 63) if x else 0 for x in packed]
                cols = [pa.array(named, pa.int64()), pa.array([minima(s).tobytes() for s in sets], pa.binary())]
                cols += [pa.array(packed, pa.binary())] if shingles else []
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *cols], names=schema.names)

    return cols.mapInArrow(run, schema)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _forest(rows: list[tuple[int, np.ndarray, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Verified links that span the groups of one bucket. Pairs that are already connected need no comparison."""
    label = np.arange(len(rows))
    sigs = np.stack([r[1] for r in rows])
    out = []
    for i in range(len(rows) - 1):
        apart = i + 1 + np.flatnonzero(label[i + 1:] != label[i])
        # five standard errors below the threshold an estimate rules the pair out
        for j in apart[(sigs[apart] == sigs[i]).mean(axis=1) >= similarity - 0.18] if len(apart) else ():
            if label[i] != label[j] and jaccard(rows[i][2], rows[j][2]) >= similarity:
                out.append((rows[i][0], rows[j][0]))
                label[label == label[j]] = label[i]
        if (label == label[0]).all():
            break
    return out


def near_components(docs: DataFrame, similarity: float = SIMILARITY, block: int = 2048, lower: bool = False) -> DataFrame:
    """_k1, _k2 (``row_keys``), doc_id and component (a long that names it) of every row; links are of Jaccard ``similarity``.

    Texts of equal shingle sets are one class. Classes that share a band are compared within the task that gets the
    band's bucket, by signature first and by their shingle sets then; a bucket gives a spanning forest, not its pairs.
    Buckets above ``block`` classes are cut into blocks, and every two blocks meet in a task. Only classes that share a
    band with another have their texts read again for the sets. Texts without words are one class, linked to nothing else.
    """
    k1, k2 = row_keys()
    keyed = docs.select(k1.alias("_k1"), k2.alias("_k2"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stage(_with_sets(keyed, ("_k1", "_k2", "doc_id"), lower, False))
    width = 4 * PERMUTATIONS // BANDS
    # signatures of equal classes are equal
    classes = rows.where("class <> 0").groupBy("class").agg(F.first("signature").alias("signature"), F.min(F.struct("_k1", "_k2")).alias("one"))
    classes = stage(classes.select("class", "one", *[F.xxhash64(F.lit(i), F.substring("signature", i * width + 1, width)).alias(f"b{i}") for i in range(BANDS)]))
    keys = classes.select("class", F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keys = stage(keys.join(sizes, "key"))
    met = keys.select("class").distinct().join(classes.select("class", "one"), "class")
    met = stage(met.select(F.col("one._k1").alias("_k1"), F.col("one._k2").alias("_k2")))
    sets = _with_sets(keyed.join(met, ["_k1", "_k2"]), (), lower, True)
    sets = stage(sets.groupBy("class").agg(F.first("signature").alias("signature"), F.first("shingles").alias("shingles")))

    n_blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("class", "key"), n_blocks).cast("int")
    keys = keys.withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), n_blocks - 1))})
    keys = keys.select("class", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    group = ["key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out(edges):
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            edges = []
            for *g, c, sig, sh in zip(*(b.column(n).to_pylist() for n in (*group, "class", "signature", "shingles"))):
                if g != at:
                    edges += _forest(held, similarity) if len(held) > 1 else []
                    at, held = g, []
                held.append((c, np.frombuffer(sig, "<u4"), np.frombuffer(sh, "<u4")))
            yield out(edges)
        yield out(_forest(held, similarity) if len(held) > 1 else [])

    both = keys.join(sets, "class").repartition(*group).sortWithinPartitions(*group).select(*group, "class", "signature", "shingles")
    comp = components(both.mapInArrow(run, "a long, b long")).withColumnRenamed("node", "class")
    named = rows.select("_k1", "_k2", "doc_id", "class").join(comp, "class", "left")
    return named.select("_k1", "_k2", "doc_id", F.coalesce("component", "class").alias("component"))


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, block: int = 2048) -> DataFrame:
    """_k1, _k2, doc_id and group_id of every row: the smallest doc_id that links of Jaccard ``similarity`` reach
    (``near_components``). Null ids count as largest (group_id null if there is no other)."""
    named = near_components(docs, similarity, block)
    lows = named.groupBy("component").agg(F.min(id_order()).alias("low"))
    return named.join(lows, "component").select("_k1", "_k2", "doc_id", F.when(F.col("low") < (1 << 63) - 1, F.col("low")).alias("group_id"))


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of ``near_components`` (A-Z in lower case): the one with the smallest doc_id
    (and text hash, should ids repeat). Same columns."""
    return first_of_groups(docs, near_components(docs, similarity, lower=True))
