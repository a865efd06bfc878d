"""Scores of toxicity against a statement of the whole rule over dense vectors and all pairs."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from reelspan.llm import toxicity

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def thinned(texts, marks, order):
    """Of each label's texts that links of Jaccard 0.8 connect, the first by ``order``."""
    sets = {i: shingles(texts[i]) for i in marks}
    root = {i: i if sets[i] else None for i in marks}
    ids = [i for i in marks if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if root[a] != root[b] and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                old, new = root[a], root[b]
                root.update({i: new for i in ids if root[i] == old})
    first = {}
    for i in sorted(marks, key=lambda i: (order[i], i)):
        first.setdefault((root[i], marks[i]), i)
    return sorted(first.values())


def said(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        out.update([w, *("^" + w[:k] for k in (4, 5) if len(w) > k)])
    return out


def own_scores(texts, marks, order):
    examples = thinned(texts, marks, order)
    shown = {i: said(t) for i, t in texts.items()}
    pos = sum(marks[i] for i in examples)
    n, neg = len(examples), len(examples) - pos
    p = Counter(f for i in examples if marks[i] for f in shown[i])
    q = Counter(f for i in examples if not marks[i] for f in shown[i])
    chi2 = {}
    for f in p.keys() | q.keys():
        seen = p[f] + q[f]
        if 4 <= seen < n:
            cross = float(p[f] * (neg - q[f]) - q[f] * (pos - p[f]))
            chi2[f] = n * cross * cross / (float(seen) * (n - seen) * pos * neg)
    vocabulary = sorted((f for f in chi2 if chi2[f] >= 20), key=lambda f: (-chi2[f], f))[:4096]
    place = {f: k for k, f in enumerate(vocabulary)}
    df = Counter(f for s in shown.values() for f in s if f in place)
    dense = {}
    for i, s in shown.items():
        v = np.zeros(len(vocabulary))
        for f in s:
            if f in place:
                v[place[f]] = (1 + math.log(s[f])) * math.log((1 + len(texts)) / (1 + df[f]))
        dense[i] = v / np.linalg.norm(v) if v.any() else v
    none = [marks[i] for i in examples if not dense[i].any()]
    base = min((sum(none) + pos / n) / (len(none) + 1), 0.49)
    index = sorted((i for i in examples if dense[i].any()), key=lambda i: (np.flatnonzero(dense[i]).tolist(), i))
    rows, y = np.stack([dense[i] for i in index]), np.array([marks[i] for i in index], float)

    def vote(v, without=None):
        c = np.minimum(rows @ v, 1.0)
        near = [k for k in np.lexsort((np.arange(len(c)), -np.round(c, 12))) if c[k] > 0 and k != without][:15]
        w = c[near] ** 2 / (0.05 + 1 - c[near])
        return ((w * y[near]).sum() + 0.5 * base) / (w.sum() + 0.5), c[near[0]] if near else 0.0

    x, means = toxicity.isotonic(np.array([vote(rows[k], k)[0] for k in range(len(index))]), y)
    x, means = np.r_[0, x, 1], np.r_[min(base, means[0]), means, max(means[-1], np.nextafter(0.5, 1))]
    got = {i: vote(v) if v.any() else (base, 0.0) for i, v in dense.items()}
    return {i: (np.interp(share, x, means), nearest) for i, (share, nearest) in got.items()}, vocabulary


def test_scores_equal_dense_vectors(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    marks = {}
    for r in labels.where("doc_id is not null and toxic is not null").collect():
        if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5:
            marks[r.doc_id] = max(marks.get(r.doc_id, 0), int(r.toxic))
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("long")).alias("h")).collect()}
    want, vocabulary = own_scores(texts, marks, order)
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert got.keys() == texts.keys() and len(vocabulary) > 10
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in texts)
    assert not {i: (got[i].nearest, want[i]) for i in texts if abs(got[i].nearest - want[i][1]) > 1e-9}
    assert not {i: (got[i].score, want[i]) for i in texts if abs(got[i].score - want[i][0]) > 1e-6}
    assert all(got[i].predicted == (got[i].score >= 0.5) for i in texts)


def test_frequencies_count_rows(spark):
    v = spark.createDataFrame([([0, 2], [1, 1], 5), ([], [], 7), ([2], [3], 2)], "f array<int>, n array<int>, rows long")
    assert toxicity._document_frequencies(v, 4).tolist() == [5, 0, 7, 0]
