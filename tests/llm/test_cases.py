"""Every operator on the same awkward rows: nulls, empty and long texts, ties, repeated rows, clashing extra columns, no rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from reelspan.llm import bpe, chat, exact, licenses, minhash, mixing, simhash, suffix_tree, token_files, toxicity
from reelspan.llm.catalog import vocabulary, word_pattern

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, ids string, copies int, single boolean, _k1 string, fp double, row string, score string"
TEXTS = [
    (0, "a plain text of a few words that says nothing at all", "en", "s1", 52),
    (1, "a plain  text of a few\twords that says nothing at all", "en", "s1", 53),
    (2, None, None, None, None),
    (3, "", "en", "s2", 0),
    (None, "no id here but some words", "de", None, 25),
    (None, "no id here but some words", "de", None, 25),
    (None, None, None, None, None),
    (4, " \t\n", "en", "s2", 3),
    (5, "word " * 40_000, "en", "s2", 200_000),
    (6, "é漢🙂 ß one", "xx", "s3", 10),
    (7, "same", "en", "s1", 4),
    (7, "same", "en", "s1", 4),
    (7, "other", "en", "s1", 5),
    (8, "x" * 70_000, "en", "s3", 70_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, "i", 9, True, "k", 0.5, "r", "s") for t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=repr)


def test_exact(docs, none):
    for digest in ("every", "surviving"):
        got = rows(exact.exact_groups(docs, digest=digest), "doc_id", "keep_id", "group_size", "kept")
        assert got == sorted([
            (0, 0, 2, True), (1, 0, 2, False), (2, 2, 3, True), (3, 2, 3, False), (None, 2, 3, False), (4, 4, 1, True),
            (None, None, 2, True), (None, None, 2, False), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 2, True), (7, 7, 2, False),
            (7, 7, 1, True), (8, 8, 1, True)], key=repr)
        assert exact.exact_groups(none, digest=digest).count() == 0
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert rows(kept, "doc_id", "_k1") == sorted([(i, "k") for i in (0, 2, None, 4, 5, 6, 7, 7, 8)], key=repr)
    assert exact.exact_dedup(none).count() == 0


def test_simhash(docs, none):
    got = simhash.near_groups(docs)
    assert got.count() == len(TEXTS)
    comp = dict(rows(got.where("doc_id is not null and doc_id <> 7"), "doc_id", "component_id"))
    assert comp[0] == comp[1] == 0 and comp[2] == comp[3] == comp[4] == 2 and comp[5] == 5
    assert rows(got.where("doc_id is null"), "component_id") == [(2,), (None,), (None,)]
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == sorted([(0,), (2,), (None,), (5,), (6,), (7,), (7,), (8,)], key=repr)
    assert simhash.near_groups(none).count() == 0 and simhash.near_dedup(none).count() == 0


def test_minhash(docs, none):
    got = minhash.neighbour_likeness(docs)
    assert got.count() == len(TEXTS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.collect())
    prints = {r.doc_id: r.fingerprint for r in got.collect()}
    assert prints[0] == prints[1] and prints[3] == prints[4] == "f" * 8 * minhash.PERMUTATIONS
    assert minhash.neighbour_likeness(none).count() == 0
    groups = minhash.near_groups(docs)
    assert groups.count() == len(TEXTS)
    assert dict(rows(groups.where("doc_id < 5"), "doc_id", "group_id")) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2}
    assert minhash.near_groups(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mixed_sizes(docs)
    assert got.count() == len(TEXTS)
    assert all(0 <= r.copies <= 2 and r.target <= 2 * r.source_size for r in got.collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got.collect())
    assert mixing.mixed_sizes(none).count() == 0 and mixing.mix(none).count() == 0


def test_bpe(docs, none):
    path = vocabulary("byte_bpe_50k.tiktoken")
    e = bpe.encode(docs.withColumn("text2", F.col("text")), path, word_pattern())
    d = bpe.decode(e, path)
    assert d.count() == len(TEXTS) and "copies" in d.columns
    assert all((r.text2 or "").encode() == bytes(r.decoded) for r in d.collect())
    assert bpe.decode(bpe.encode(none, path, word_pattern()), path).count() == 0


def test_token_files(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_files.read(spark, token_files.write(docs, path, 2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [0, 1, 2, 3, 4, 5, 6, 7, 7, 7, 8, None, None, None]
    assert [r.start for r in got] == [sum(q.n_ids for q in got[:i]) for i in range(len(got))]
    assert [r.n_ids for r in got if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert token_files.read(spark, token_files.write(none, path, 2)).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(0, 0, "x"), (1, None, "x"), (None, 1, "x"), (7, 1, "x"), (7, 0, "x")], "doc_id long, toxic int, score string")
    got = toxicity.score(docs, labels)
    assert got.count() == len(TEXTS) and all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(none, labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


def test_suffix_tree(docs, none):
    got = suffix_tree.score(docs)
    assert got.count() == len(TEXTS)
    assert {r.doc_id: r.n_tokens for r in got.collect() if r.doc_id not in (7, None)} == {0: 13, 1: 13, 2: 1, 3: 1, 4: 1, 5: 40_001, 6: 4, 8: 2}
    assert all(r.score <= 0 and r.base_score <= 0 for r in got.collect())
    assert suffix_tree.score(none).count() == 0


def test_licenses(spark, none):
    files = [
        (1, "a/LICENSE", "Released under the MIT License.", 1.0), (2, "a/b/c/x.py", "nothing here", 1.0), (3, "a/b/LICENSE.txt", "Licensed under CC BY-NC 4.0.\nmore", 1.0),
        (4, "a/b/c/d/y.py", None, None), (5, "z.py", "Some words. Licensed under the Apache License, Version 2.0. And more.", 0.0), (6, None, None, 0.0),
        (6, None, "Released under the MIT License.", 0.0), (7, "q/x.py", "", 0.0), (2, "a/b/c/x.py", "nothing here", 1.0), (8, "ab/x.py", "the license of the work", None)]
    got = licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string, score double"))
    assert rows(got, "doc_id", "license", "found_in") == sorted([
        (1, "MIT", "a/LICENSE"), (2, "CC-BY-NC-4.0", "a/b"), (2, "CC-BY-NC-4.0", "a/b"), (3, "CC-BY-NC-4.0", "a/b/LICENSE.txt"), (4, "CC-BY-NC-4.0", "a/b"),
        (5, "Apache-2.0", "z.py"), (6, None, None), (6, "MIT", None), (7, None, None), (8, None, None)], key=repr)
    assert licenses.scan(none.withColumn("path", F.lit("a"))).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "hi [INST] \\ </s>"), (1, 1, "assistant", "x" * 1000), (1, 1, "assistant", "x" * 1000), (2, 0, None, None), (None, 0, "assistant", ""), (2, 1, "assistant", None)]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.render(chat.fold_messages(chat.event_log(t)).withColumn("chars2", F.lit(1))))
    assert rows(back, "conv_id", "turn", "role", "text") == sorted([(c, n, r or "", x or "") for c, n, r, x in turns], key=repr)
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(back).collect()} == {1: (3, 2000), 2: (2, 0), None: (1, 0)}
    assert chat.digests(chat.read_back(chat.render(chat.fold_messages(chat.event_log(t.limit(0)))))).count() == 0
