"""A chunk sorts its tokens as integers that hold their own place, and has its hashes and probabilities once a run."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from reelspan.llm import suffix_tree

FAN = 5


def grown(texts: list[str]):
    """One chunk of training texts, all answers to it and the totals, without Spark."""
    docs = pa.record_batch({"doc_id": list(range(len(texts))), "train": [True] * len(texts), "text": texts})
    chunk = pa.Table.from_batches(suffix_tree._to_chunks(1 << 20)(iter([docs])))

    def ask(asked: pa.Table, answer) -> pa.Table:
        return pa.concat_tables([answer(asked.filter(pc.equal(asked["g"], g))) for g in range(FAN) if g in asked["g"].to_pylist()])

    answers = ask(pa.Table.from_batches(suffix_tree._ask_words(FAN, 1)(iter(chunk.to_batches()))), suffix_tree._count_words)
    totals = (pc.sum(answers["tokens"]).as_py(), pc.sum(answers["kinds"]).as_py(), 0.5)
    for level in range(1, suffix_tree.DEPTH + 1):
        answers = pa.concat_tables([answers, ask(suffix_tree._ask_pairs(level, totals, FAN, 1)(chunk, answers), suffix_tree._grow(level))])
    return chunk, answers, totals


@pytest.fixture(scope="module")
def tree():
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in np.cumsum(r.integers(1, 4, 120)) % 37) for _ in range(60)]
    return texts, *grown(texts)


def test_tokens_are_not_sorted_by_index(tree, monkeypatch):
    """Indices are sorted for the chunk's distinct words only, however many tokens and levels there are."""
    texts, chunk, answers, totals = tree
    sorted_, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **kinds: (sorted_.append(len(a)), argsort(a, *args, **kinds))[1])
    got = suffix_tree._score(totals, FAN)(chunk, answers)
    assert max(answers["level"].to_pylist()) > 1 and sum(got["n_tokens"].to_pylist()) == 60 * 121
    assert 0 < sum(sorted_) <= 4 * 38


def test_pairs_of_a_level(tree):
    texts, chunk, _, totals = tree
    c = suffix_tree.Chunk(chunk.to_pylist()[0], {}, totals, FAN)
    first, order, cuts = c.pairs(1)
    own = Counter(p for t in texts for w in [t.split()] for p in zip(["^", *w], [*w, "$"]))
    assert sorted(np.diff(first, append=len(c.at)).tolist()) == sorted(own.values()) and sorted(order.tolist()) == list(range(len(own)))
    keys = (suffix_tree._mix(c.context) & ~np.uint64(0xFFFFFFFF)) | c.next >> np.uint64(32)
    for digit, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
        assert (c.context[order[low:high]] % np.uint64(FAN) == digit).all() and (np.sort(keys[order[low:high]]) == keys[order[low:high]]).all()


@pytest.mark.parametrize("most", [50, 1 << 62])
def test_ordered(most):
    """Values that leave room for the numbers, and such as do not."""
    r = np.random.default_rng(7)
    values = r.choice(r.integers(0, most, 40, dtype=np.uint64), 500)
    numbers = r.permutation(500)
    ranked, got = suffix_tree.ordered(values, numbers, 500)
    own = np.lexsort([numbers, values])
    assert (ranked == values[own]).all() and (got == numbers[own]).all()
