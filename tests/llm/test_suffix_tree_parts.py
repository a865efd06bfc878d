"""Questions over relays (F1): no copy of them stays on disk, nor do they carry hash bits that no relay asks for."""

import numpy as np
from pyspark.sql import functions as F

from reelspan.llm import common, suffix_tree


def test_questions_are_deleted_once_answered(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), (i * (F.col("doc_id") % 7 + 1)) % 11)))
    docs = spark.range(30).select(F.when(F.col("id") % 10 != 9, F.col("id")).alias("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(3)))
    docs = docs.withColumn("text", text).unionByName(spark.createDataFrame([(None, "w1 w2"), (4, None), (4, "")], "doc_id long, text string"))
    plain = suffix_tree.score(docs).select("doc_id", "n_tokens", F.round("score", 9).alias("s")).collect()
    before = set(common._STAGED)
    got = suffix_tree.score(docs, chunk_tokens=100, fanout=2).select("doc_id", "n_tokens", F.round("score", 9).alias("s")).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.s))
    assert order(got) == order(plain) and len(got) == 33
    left = [spark.read.parquet(p).columns for p in common._STAGED if p not in before]
    assert left and not [c for c in left if "keys" in c]


def test_questions_carry_the_digits_alone():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64)
    path = suffix_tree.onward(hashes, 25, 2)
    assert (path == hashes // np.uint64(25) % np.uint64(25)).all()
    row = suffix_tree.questions(0, 0, np.sort(hashes), np.ones(50_000), (), path, np.arange(50_000), [0, 50_000], 2)[0]
    assert len(row[-1]) < 2 * 50_000
