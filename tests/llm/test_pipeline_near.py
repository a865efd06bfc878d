"""The near-dedup stage of the pipeline goes by SimHash as well as by Jaccard similarity."""

import corpus_pipeline
from reelspan.llm import minhash


def test_near_dedup_takes_links_of_simhash_and_of_jaccard(spark):
    # the repeated words decide the fingerprint (equal), the tails the sets of shingles (Jaccard far below 0.8)
    often = "one two three " * 300
    one = often + " ".join(f"x{i}" for i in range(8))
    two = often + " ".join(f"y{i}" for i in range(8))
    # one word of 60 differs: most shingles are shared, but not the fingerprint
    plain = [f"w{i}" for i in range(60)]
    other = [*plain[:-1], "end"]
    rows = [(1, one), (2, two), (3, " ".join(plain)), (4, " ".join(other)), (5, "quite another text of a few words"), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    by_sets = sorted(r.doc_id for r in minhash.near_dedup(docs).collect())
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert by_sets == [1, 2, 3, 5, 6] and got == [1, 3, 5, 6]
