"""Cross-tokenizer alignment against dictionaries over the two libraries' own tokens."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelspan.llm import alignment, catalog
from reelspan.llm.prefix_counts import byte_letters
from tests.llm.test_cases import TEXTS, docs, none  # noqa: F401
from tests.llm.test_results import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    t, s, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    t.encode_special_tokens = True
    bytes_a = lambda i: bytes(letters[c] for c in t.id_to_token(i))
    bytes_b = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    out, count = [], Counter()
    for x in texts:
        a = t.encode(" " + x, add_special_tokens=False).ids if x else []
        b = s.encode(x) if x else []
        want = (" " + (x or "")).encode()
        if b"".join(map(bytes_a, a)) != want or b"".join(map(bytes_b, b)) != want:
            out.append(([], [], [], []))
            continue
        ends = []
        for ids, of in ((a, bytes_a), (b, bytes_b)):
            at, found = 0, []
            for i in ids:
                at += len(of(i))
                found.append(at)
            ends.append(found)
        links = [(i, j) for i, e in zip(a, ends[0]) for j in [dict(zip(ends[1], b)).get(e)] if j is not None] if len(a) < 3000 else \
            [(i, look[e]) for look in [dict(zip(ends[1], b))] for i, e in zip(a, ends[0]) if e in look]
        count.update(links)
        both, groups = sorted(set(ends[0]) & set(ends[1])), []
        lo_a = lo_b = 0
        for e in both:
            hi_a, hi_b = ends[0].index(e, lo_a) + 1, ends[1].index(e, lo_b) + 1
            groups.append(",".join(map(str, a[lo_a:hi_a])) + "|" + ",".join(map(str, b[lo_b:hi_b])))
            lo_a, lo_b = hi_a, hi_b
        out.append((a, b, groups, links))
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(len(a), len(b), len(g), len(k), sum(count[q] == most[q[1]] for q in k), sum(count[q] for q in k), ";".join(g)) for a, b, g, k in out]


def test_query_equals_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in catalog.QUERIES["op13_alignment"](spark, SF).collect()}
    assert len(got) == len(texts)
    for (i, _), (*numbers, groups) in zip(texts, brute([t for _, t in texts])):
        r = got[i]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_awkward_rows(spark, docs, none, held, monkeypatch):  # noqa: F811
    monkeypatch.setattr(alignment, "HELD", held)
    more = [(20, "a▁b"), (21, "<|endoftext|></s> <unk><0x41>"), (22, "\x00\x01 \r\n é é"), (23, "漢字 🙂🙂　x"), (24, " "), (25, " " * 30 + "x"), (26, "ﬁ ½ ①")]
    d = docs.withColumn("text2", F.col("text")).withColumn("groups", F.lit("x")).withColumn("pairs", F.lit(1)).withColumn("doc", F.lit(2))
    extra = spark.createDataFrame(more, "doc_id long, text string").withColumn("text2", F.col("text"))
    d = d.unionByName(extra, allowMissingColumns=True)
    got = alignment.align(d, A, B, public_tokenizers.PATTERN)
    assert set(got.columns) == {*d.columns, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"} - {"text"}
    texts = [t[1] for t in TEXTS] + [t for _, t in more]
    want = sorted((t or "", *w) for t, w in zip(texts, brute(texts)))
    assert sorted((r.text2 or "", r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got.collect()) == want
    assert alignment.align(none, A, B, public_tokenizers.PATTERN).count() == 0


def test_pairs_are_bounded():
    p = alignment.pair(A, B, public_tokenizers.PATTERN)
    assert p.n_pairs < 1_000_000
