"""Words that skip the tokenizer's normalizer and splitter have the ids that the whole tokenizer gives."""

import random
from array import array

from reelspan.llm import token_files
from reelspan.llm.catalog import vocabulary


def test_words_have_the_tokenizers_ids_and_few_go_through_all_of_it():
    enc = token_files.WordEncoder(vocabulary("word_bpe_49k.json"))
    whole, deal = enc.tokenizer, random.Random(7)
    letters = [chr(c) for c in (*range(1, 0x250), 0x300, 0x301, 0x3A3, 0x3C2, 0x1E9E, 0x212A, 0xFB01, 0x4E00, 0x1F600)]
    words = letters + [a + b for a in "aA'1É" for b in letters] + ["<|startoftext|>", "x<|endoftext|>y", "<|ENDOFTEXT|>", "it's", "IT'S", "O'RE'll"]
    words += ["".join(deal.choices("abcDEFßéÑøÿ'st.,1290<|>×÷", k=deal.randint(1, 30))) for _ in range(3000)]
    words = [w for t in words for w in t.encode().split()]
    want = [array("I", whole.encode(w.decode(), add_special_tokens=False).ids).tobytes() for w in words]
    assert enc.ids(words) == want and enc.ids(words) == want  # first computed, then from the cache

    seen = []

    class Counted:
        def encode_batch_fast(self, batch, **k):
            seen.extend(batch)
            return whole.encode_batch_fast(batch, **k)

    enc.tokenizer = Counted()
    enc.ids([b"Unheardword%d." % i for i in range(100)] + ["ﬁne".encode()])
    assert seen == ["ﬁne"]  # before, every new word went through the whole tokenizer
