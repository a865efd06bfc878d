"""Spelling variants against all pairs, over the whole small table and over words made to collide."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.llm import catalog, spelling
from tests.llm.test_cases import docs, none  # noqa: F401
from tests.llm.test_results import SF


def brute_words(rows, misspell):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if misspell and h % misspell == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute(n):
    """Near words are those that share a word with one place blanked or taken out."""
    near = defaultdict(set)
    blank = defaultdict(list)
    for w in n:
        for i in range(len(w)):
            blank[w[:i] + "\0" + w[i + 1:]].append(w)
    for group in blank.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    for w in n:
        for cut in {w[:i] + w[i + 1:] for i in range(len(w))} & n.keys():
            near[w].add(cut)
            near[cut].add(w)
    form = {}
    for w, k in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * k:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, k, len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w, k in n.items()}


def rows(df):
    return [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()]


def test_query_equals_all_pairs(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows(catalog.QUERIES["op12_spelling"](spark, SF))
    want = brute(brute_words(texts, 31))
    assert len(got) == len(want) and set(got) == want and any(r[3] for r in got)


@pytest.mark.parametrize("cell, sample", [(8_192, 32_768), (20, 1_000), (20, 30)])
def test_colliding_words(spark, monkeypatch, cell, sample):
    """Anagrams, long runs, hot words, chains of forms; many small cells, and a sample that misses most lengths."""
    for name, v in (("CELL", cell), ("SAMPLE", sample), ("BOX", 8), ("AT_ONCE", 64)):
        monkeypatch.setattr(spelling, name, v)
    rng = np.random.default_rng(1)
    made = ["".join(rng.permutation(list("abcdefg"))) for _ in range(300)] + ["".join(rng.choice(list("abÀÿ"), rng.integers(7, 11))) for _ in range(400)]
    made += ["x" * k for k in (7, 8, 9, 60, 61, 3000, 3001)] + ["y" * 2000 + "ab" + "z" * 50, "y" * 2000 + "ba" + "z" * 50, "y" * 2000 + "bb" + "z" * 50]
    texts = [(i, f"{w} {w}, {w}") for i, w in enumerate(made)]
    texts += [(None, "hottest " * 5000), (None, "hottes " * 300), (None, "hotteq hottess " * 20), (None, "hottesq hottesq"), (7, "Ärgerlich ärgerlich ÄRGERLICH short"), (8, None), (9, "")]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for misspell in (None, 31):
        got = rows(spelling.variants(d, misspell))
        want = brute(brute_words(texts, misspell))
        assert len(got) == len(want) and set(got) == want
    assert {r[5] for r in got if r[0] == "hottesq"} == {"hottest"}


def test_awkward_rows(docs, none):  # noqa: F811
    d = docs.withColumn("word", F.lit("w")).withColumn("n", F.lit("n"))
    want = brute(brute_words([(r.doc_id, r.text) for r in docs.collect()], 31))
    got = rows(spelling.variants(d, 31))
    assert len(got) == len(want) and set(got) == want
    assert spelling.variants(none, 31).count() == 0 and spelling.variants(docs.where("doc_id = 7"), 31).count() == 0
