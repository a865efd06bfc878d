"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index, distance-weighted votes.

The examples are a bounded sample of the labelled rows. Features are words and word beginnings that the sample's labels
speak about (chi-square test); their document frequencies are taken over all documents. A document's neighbours are
found through an inverted index of the examples whose postings are cut into blocks; the largest weight of each term
in each block bounds what a block can give: the blocks of the highest bounds are visited first, then at once all others that
can reach the k-th best. Votes weigh by distance and are calibrated by isotonic regression on the examples themselves, each
judged without itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reelspan.llm import minhash
from reelspan.llm.common import keep_rows, row_keys, stage

#: The bound of the labelled sample, of the features and of the neighbours.
EXAMPLES, FEATURES, NEIGHBOURS, EVIDENCE = 20_000, 4096, 15, 5
#: A feature is in at least so many examples, and its chi-square (one degree of freedom) is so large.
LEAST_EXAMPLES, LEAST_CHI2 = 4, 20.0
#: Vectors whose votes one task takes, and the number of vectors that may each be had by more than its share of the rows.
VECTORS_A_TASK, OFTEN = 1000, 1000
BLOCK, NEARNESS, PRIOR_WEIGHT = 256, 0.05, 0.5
#: Blocks visited before the k-th best is asked for.
FIRST_BLOCKS = 4
#: A text that shows nothing is not called toxic, whatever share of the examples is.
MOST_WITHOUT = 0.49
_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (4, 5)


def features(text: str | None) -> Counter:
    """Words in lower case with their counts, and, marked by ^, the first four and five letters of longer ones."""
    words = Counter(_WORD.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        for k in _BEGINNINGS:
            if len(w) > k:
                out["^" + w[:k]] += n
    return out


def _stems(vocabulary: dict[str, int]) -> set[str]:
    """How words begin that can have a feature of the vocabulary."""
    return {f.removeprefix("^")[:_BEGINNINGS[0]] for f in vocabulary}


def _hits(text: str | None, vocabulary: dict[str, int], stems: set[str]) -> tuple[list[int], list[int]]:
    """The features of a text that are in the vocabulary, ascending, and how often they occur."""
    found: dict[int, int] = {}
    k = _BEGINNINGS[0]
    for w, n in Counter([w for w in _WORD.findall((text or "").lower()) if w[:k] in stems]).items():
        for f in (w, *("^" + w[:k] for k in _BEGINNINGS if len(w) > k)):
            i = vocabulary.get(f)
            if i is not None:
                found[i] = found.get(i, 0) + n
    return (list(x) for x in zip(*sorted(found.items()))) if found else ([], [])


@dataclass
class BlockMaxIndex:
    """Unit vectors of the examples, in blocks. ``ids``, ``labels`` and the vectors (features, weights) are parallel."""

    ids: list[int]
    labels: np.ndarray
    postings: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    maxima: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: feature -> the block of each of its postings
    blocks: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def build(cls, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        # examples with the same features stand together, so that the blocks' bounds are tight
        order = sorted(range(len(ids)), key=lambda i: (vectors[i][0].tolist(), ids[i]))
        index = cls([ids[i] for i in order], np.array([labels[i] for i in order], float))
        lists: dict[int, list[tuple[int, float]]] = {}
        for place, i in enumerate(order):
            for f, w in zip(*vectors[i]):
                lists.setdefault(int(f), []).append((place, w))
        for f, p in lists.items():
            places, weights = np.array([x[0] for x in p]), np.array([x[1] for x in p])
            blocks = places // BLOCK
            first = np.flatnonzero(np.diff(blocks, prepend=-1))
            index.postings[f] = (places, weights)
            index.maxima[f] = (blocks[first], np.maximum.reduceat(weights, first))
            index.blocks[f] = blocks
        return index

    def nearest(self, feats: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples that share a feature; equal cosines go by place."""
        terms = [(self.maxima[f], self.postings[f], self.blocks[f], w) for f, w in zip(feats.tolist(), weights.tolist()) if f in self.maxima]
        if not terms:
            return np.zeros(0, int), np.zeros(0)
        bound = np.zeros(-(-len(self.ids) // BLOCK))
        for (blocks, most), _, _, w in terms:
            bound[blocks] += w * most
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        places, cosines, kth = np.zeros(0, int), np.zeros(0), 0.0
        for visit in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            visit = visit[bound[visit] >= kth - 1e-12]
            if not len(visit):
                break
            open_ = np.zeros(len(bound), bool)
            open_[visit] = True
            sums = np.zeros(len(self.ids))
            for _, (at, ws), blocks, w in terms:
                here = open_[blocks]
                sums[at[here]] += w * ws[here]
            got = np.flatnonzero(sums > 0)
            if without is not None:
                got = got[got != without]
            places, cosines = np.concatenate([places, got]), np.concatenate([cosines, np.minimum(sums[got], 1.0)])
            near = np.round(cosines, 12)
            if len(near) > k:  # only those no farther than the k-th are put in order
                among = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k])
                places, cosines, near = places[among], cosines[among], near[among]
            best = np.lexsort((places, -near))[:k]
            places, cosines = places[best], cosines[best]
            kth = cosines[-1] if len(cosines) == k else 0.0
        return places, cosines


@dataclass
class Model:
    vocabulary: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    base: float  # share of label 1 among examples without any feature
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    def vector(self, feats: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        f = np.array(feats, int)
        w = (1 + np.log(np.array(counts, float))) * self.idf[f]
        return f, w / np.sqrt((w * w).sum())

    def vote(self, feats: list[int], counts: list[int], without: int | None = None) -> tuple[float, list[int], float]:
        """Weighted share of label 1 among the neighbours, drawn to the base; the neighbours; the nearest one's cosine."""
        if not len(feats):
            return self.base, [], 0.0
        places, cosines = self.index.nearest(*self.vector(feats, counts), without=without)
        w = cosines ** 2 / (NEARNESS + 1 - cosines)  # far neighbours hardly vote
        share = ((w * self.index.labels[places]).sum() + PRIOR_WEIGHT * self.base) / (w.sum() + PRIOR_WEIGHT)
        return float(share), [self.index.ids[p] for p in places[:EVIDENCE]], float(cosines[0]) if len(cosines) else 0.0

    def calibrated(self, share: float) -> float:
        return float(np.interp(share, *self.steps)) if len(self.steps[0]) else share


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean x and smoothed mean y of the pooled, rising steps (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # n, sum x, sum y
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([1, a, b])
        while len(pools) > 1 and (pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0] or pools[-2][1] / pools[-2][0] == pools[-1][1] / pools[-1][0]):
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top)]
    mean = y.mean() if len(y) else 0.0
    return np.array([p[1] / p[0] for p in pools]), np.maximum.accumulate(np.array([(p[2] + mean) / (p[0] + 1) for p in pools]))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _feature_counts(sample: DataFrame) -> DataFrame:
    """feature, label, n: in how many examples of a label a feature occurs; summed within a batch before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for text, label in zip(b.column("text"), b.column("label").to_pylist()):
                c.update((f, label) for f in features(text.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.int32()), pa.array(list(c.values()), pa.int64())], names=["feature", "label", "n"])

    return sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, "feature string, label int, n long")


def _distinct(sample: DataFrame) -> DataFrame:
    """Examples without copies and near copies, which would make every word of a text that is often repeated speak for
    its label: of the texts of one label that verified links of Jaccard 0.8 connect one stays, by a hash of its id."""
    s = stage(sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text"))
    groups = minhash.near_components(s, lower=True).join(s.select("doc_id", "label"), "doc_id")
    one = groups.groupBy("component", "label").agg(F.min_by("doc_id", F.struct(F.xxhash64("doc_id"), "doc_id")).alias("doc_id"))
    return stage(s.join(one.select("doc_id"), "doc_id", "left_semi"))


def _document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many rows each feature occurs. vectors: f (features), rows; a task adds its vectors up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size)
        for b in batches:
            f = b.column("f")
            rows = np.repeat(b.column("rows").to_numpy(), f.value_lengths().to_numpy())
            df += np.bincount(f.flatten().to_numpy(), rows, size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at].astype(np.int64))], names=["f", "n"])

    out = np.zeros(size)
    for r in vectors.select("f", "rows").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # a row a feature
        out[r.f] = r.n
    return out


def _select(sample: DataFrame) -> dict[str, int]:
    """The vocabulary: at most FEATURES features by chi-square, ties by name."""
    totals = {r.label: r["count"] for r in sample.groupBy(F.col("label").cast("int").alias("label")).count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return {}
    c = _feature_counts(sample).groupBy("feature").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).cast("double").alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).cast("double").alias("q"))
    p, q, n = F.col("p"), F.col("q"), float(pos + neg)
    cross = p * (neg - q) - q * (pos - p)
    chi2 = n * cross * cross / ((p + q) * (n - p - q) * pos * neg)
    rows = c.where((p + q >= LEAST_EXAMPLES) & (p + q < n)).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    return {r.feature: i for i, r in enumerate(rows.orderBy(F.desc("chi2"), "feature").limit(FEATURES).select("feature").collect())}


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """_k1, _k2 (``row_keys``), doc_id, held_out, score, predicted, evidence, nearest of every row of ``docs``.

    score is a function of the text alone; evidence lists the nearest examples' ids, nearest the first one's cosine.
    Learns from at most ``examples`` rows of ``labels`` (doc_id, ``label``) that are not held out, in the order of a
    hash of doc_id. Null labels and null ids teach nothing; an id labelled twice counts by its larger label. Texts
    without a feature (also null and empty ones) get the share of label 1 among such examples, below 0.5. Without labels of both
    kinds all scores are that share, 0 without labels. An empty table gives none.
    """
    spark = docs.sparkSession
    taught = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    taught = taught.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    taught = stage(taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples))
    sample = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id")  # at most ``examples`` pairs of numbers
    sample = _distinct(sample.groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    taught = stage(sample.select("doc_id", "label"))
    vocabulary = _select(sample)
    words = spark.sparkContext.broadcast((vocabulary, _stems(vocabulary)))

    k1, k2 = row_keys()
    cols = docs.select(k1.alias("_k1"), k2.alias("_k2"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [_hits(t.as_py(), *words.value) for t in b.column("text")]
            lists = [pa.array([list(h) for h in col], pa.list_(pa.int32())) for col in zip(*hits)] if hits else [pa.array([], pa.list_(pa.int32()))] * 2
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("_k1", "_k2", "doc_id")), *lists], names=["_k1", "_k2", "doc_id", "f", "n"])

    hits = stage(cols.mapInArrow(find, "_k1 long, _k2 long, doc_id long, f array<int>, n array<int>"))
    total = hits.count()
    # many texts show the same features equally often: each such vector is counted and judged once
    vectors = stage(hits.groupBy("f", "n").agg(F.count("*").alias("rows")))
    df = _document_frequencies(vectors, len(vocabulary))
    known = hits.join(F.broadcast(taught), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("f", "n")).alias("v"))
    known = known.select("doc_id", "label", "v.f", "v.n").collect()  # the examples, bounded
    none = [r.label for r in known if not r.f]
    mean = sum(r.label for r in known) / len(known) if known else 0.0
    model = Model(vocabulary, np.log((1 + total) / (1 + df)), BlockMaxIndex([], np.zeros(0)), min((sum(none) + mean) / (len(none) + 1), MOST_WITHOUT))
    said = [r for r in known if r.f]
    model.index = BlockMaxIndex.build([r.doc_id for r in said], [r.label for r in said], [model.vector(r.f, r.n) for r in said])
    _calibrate(spark, model, said)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [m.vote(f, n) for f, n in zip(b.column("f").to_pylist(), b.column("n").to_pylist())]
            share, ids, near = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in ("f", "n", "rows")), pa.array([m.calibrated(x) for x in share], pa.float64()), pa.array(ids, pa.list_(pa.int64())), pa.array(near, pa.float64())],
                names=["f", "n", "rows", "score", "evidence", "nearest"])

    # a vote is dear and its row narrow: tasks are dealt by number, not by bytes
    tasks = max(spark.sparkContext.defaultParallelism, -(-vectors.count() // VECTORS_A_TASK))
    votes = stage(vectors.repartition(tasks, "f", "n").mapInArrow(judge, "f array<int>, n array<int>, rows long, score double, evidence array<long>, nearest double"))
    often = F.col("rows") * OFTEN > total  # of less than OFTEN vectors, so that their votes can be sent to all tasks
    hot, rest = (votes.where(c).drop("rows") for c in (often, ~often))
    d = hits.join(F.broadcast(hot), ["f", "n"]).unionByName(hits.join(F.broadcast(hot.select("f", "n")), ["f", "n"], "left_anti").join(rest, ["f", "n"]))
    return d.select("_k1", "_k2", "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "nearest")


def _calibrate(spark, model: Model, said: list) -> None:
    """Votes of the examples without themselves, taken on the executors, against their labels."""
    if not said:
        return
    place = {i: p for p, i in enumerate(model.index.ids)}
    shared = spark.sparkContext.broadcast(model)
    rows = spark.createDataFrame([(place[r.doc_id], r.label, r.f, r.n) for r in said], "p long, label int, f array<int>, n array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = [shared.value.vote(f, n, p)[0] for p, f, n in zip(*(b.column(c).to_pylist() for c in ("p", "f", "n")))]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), b.column("label")], names=["share", "label"])

    got = rows.mapInArrow(run, "share double, label int").collect()
    x, y = np.array([r.share for r in got]), np.array([r.label for r in got], float)
    steps = isotonic(x, y)
    # the ends stay below and above all steps, so that a clear vote keeps its side
    model.steps = (np.concatenate([[0.0], steps[0], [1.0]]), np.concatenate([[min(model.base, steps[1][0])], steps[1], [max(steps[1][-1], math.nextafter(0.5, 1)) if y.any() else steps[1][-1]]]))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic. Same columns."""
    bad = score(docs, labels).where("predicted = 1")
    return keep_rows(docs, bad.groupBy("_k1", "_k2").agg(F.lit(0).alias("copies"), F.lit(False).alias("single")))
