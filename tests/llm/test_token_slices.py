"""Texts are encoded by slices: each distinct word once, each new piece merged once, with the tokenizer's ids for every text."""

import random
from array import array

import numpy as np
import pyarrow as pa

from reelspan.llm import token_files
from reelspan.llm.catalog import vocabulary

END = array("I", [2]).tobytes()


def library(enc, text):
    return array("I", enc.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + END


def test_texts_have_the_tokenizers_ids():
    enc, deal = token_files.WordEncoder(vocabulary("word_bpe_49k.json")), random.Random(11)
    bits = ["a", "The", "ING", "'s", "'LL", "''", "'", "é", "É", "é", "İ", "ſ", "Σ", "ß", "×", "漢字", "ﬁ", "🙂", "1", "२", "...", "_", "x" * 60, "<|endoftext|>", "<|",
            " ", " ", "  ", "\n", "\t\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", " ", "　", "\0"]
    texts = ["", " ", "\n\n", "word", " word", "word ", *("".join(deal.choices(bits, k=deal.randint(0, 40))) for _ in range(2000))]
    want = [library(enc, t) for t in texts]
    assert enc.texts(pa.array(texts), END).to_pylist() == want  # computed
    assert enc.texts(pa.array(texts), END).to_pylist() == want  # from the caches
    assert enc.texts(pa.array(texts, pa.large_string()), END).to_pylist() == want
    assert enc.texts(pa.array(texts).slice(3, 500), END).to_pylist() == want[3:503]
    for few in (["", ""], [" "], []):
        assert enc.texts(pa.array(few, pa.string()), END).to_pylist() == [END] * len(few)
    enc.known = False  # another tokenizer's words go through all of it
    assert enc.texts(pa.array(texts), END).to_pylist() == want


def test_full_caches_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 5)
    monkeypatch.setattr(token_files, "PIECES", 5)
    enc, deal = token_files.WordEncoder(vocabulary("word_bpe_49k.json")), random.Random(3)
    texts = [" ".join("".join(deal.choices("abé.1漢", k=3)) for _ in range(20)) for _ in range(60)]
    for lo in range(0, 60, 7):
        assert enc.texts(pa.array(texts[lo:lo + 7]), END).to_pylist() == [library(enc, t) for t in texts[lo:lo + 7]]


def test_slices_are_whole_rows_of_bounded_text():
    sizes = [0, 5, 4, 30, 0, 3, 3, 3, 3, 100]
    b = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in sizes])], names=["text"])
    got = [[len(t) for t in s.column("text").to_pylist()] for s in token_files._slices(b, 10)]
    assert got == [[0, 5, 4], [30], [0, 3, 3, 3], [3], [100]]
    assert list(token_files._slices(b.slice(0, 0), 10)) == []


def test_words_are_looked_at_once_in_a_slice():
    """Before, each of a text's words was a Python value, looked up alone."""
    enc, seen = token_files.WordEncoder(vocabulary("word_bpe_49k.json")), []
    coded = enc.coded
    enc.coded = lambda words: (seen.append(len(words)), coded(words))[1]
    texts = pa.array(["one two three one"] * 500 + ["two four"] * 500)
    got = enc.texts(texts, END)
    assert seen == [4]  # 3,000 words, 4 distinct ones
    assert got.to_pylist() == [library(enc, t) for t in texts.to_pylist()]
    assert np.frombuffer(got[0].as_py(), "<u4")[-1] == 2


def test_texts_without_spaces_go_a_few_at_once_and_are_not_kept():
    enc, runs = token_files.WordEncoder(vocabulary("word_bpe_49k.json")), []
    whole = enc.tokenizer

    class Counted:
        def encode_batch_fast(self, batch, **k):
            runs.append(len(batch))
            return whole.encode_batch_fast(batch, **k)

    enc.tokenizer = Counted()
    texts = [chr(0x4E00 + i) * n for i in range(100) for n in (3, 300)]
    got = enc.texts(pa.array(texts), END).to_pylist()
    assert max(runs) == token_files.RUN and sum(runs) == 200 and set(map(len, enc.new)) == {3}
    enc.tokenizer = whole
    assert got == [library(enc, t) for t in texts]
