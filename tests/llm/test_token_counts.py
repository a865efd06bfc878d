"""Counts at every prefix against the tokenizers library."""

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelspan.llm import catalog, prefix_counts
from tests.llm.test_cases import TEXTS, docs, none  # noqa: F401
from tests.llm.test_results import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def count():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_every_prefix_of_random_texts(count):
    c = prefix_counts.PrefixCounter(PATH)
    rng = np.random.default_rng(5)
    bits = ["a", "e", "th", "ing", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "　", "'s", "'LL", "'re", "'", "é", "É", "ß", "漢", "🙂", "1", "२", "_", "...", "ZZ",
            "é", "́", "tion", "aaaa", "<|endoftext|>", "<|startoftext", "|>", "İ", "Σ", "ﬁ", "각", "각", "×"]
    for _ in range(1500):
        t = "".join(rng.choice(bits, rng.integers(0, 14)))
        got = c.counts(t).tolist()
        assert len(got) == len(t)
        for k in range(1, len(t) + 1):
            inside = k < len(t) and regex.match(r"[\p{M}ᅠ-ᇿ]", t[k])  # a cut inside a composed character
            assert inside or got[k - 1] == count(t[:k]), (t, k)


def test_query_equals_library(spark, count):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in catalog.QUERIES["op11_token_counts"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        n = count(t)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 2048)
        cut = got[i].fitting_chars
        assert count(t[:cut]) <= 2048 and (cut == len(t) or count(t[:cut + 1]) > 2048)


def test_budgets(spark, count):
    text = "internationalization of hello"
    d = prefix_counts.prefix_counts(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string"), PATH)
    c = F.col("counts")
    for budget in range(6):
        got = dict(d.select("id", prefix_counts.longest_within(c, budget)).collect())
        assert got == {1: max(k for k in range(len(text) + 1) if count(text[:k]) <= budget), 2: 0, 3: 0}
    for k in (0, 3, 10, 99):
        assert dict(d.select("id", prefix_counts.tokens_of(c, k)).collect()) == {1: count(text[:k]), 2: 0, 3: 0}


def test_awkward_rows(docs, none, count):  # noqa: F811
    got = prefix_counts.prefix_counts(docs.withColumn("text2", F.col("text")).withColumn("counts", F.lit("x")), PATH)
    assert got.columns == [*(c for c in docs.columns if c != "text"), "text2", "counts"] and got.count() == len(TEXTS)
    for r in got.collect():
        assert len(r.counts) == len(r.text2 or "") and (r.counts[-1] if r.counts else 0) == count(r.text2 or "")
    assert prefix_counts.prefix_counts(none, PATH).count() == 0
