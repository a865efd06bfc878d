"""Language-model scores from a probabilistic suffix tree over words, built and applied by shuffles of packed arrays.

The states of the tree are contexts of up to ``DEPTH`` words; the root is the empty context. A state's distribution
over the next token is its discounted counts plus, with the mass the discount frees, the distribution of the context
without its first word. A context is kept only if its counts diverge from the shorter context's distribution: the log
ratio of the two, summed over its training tokens with each token left out in turn, must reach ``LEAST_GAIN`` nats. A
context is lengthened only where it was kept, so kept states have all their suffixes, and a token is scored by the
longest kept suffix of what precedes it. The root gives the discounted mass to the one symbol for unknown words.

Everything is held in chunks of documents. A chunk sends each (context, next token) pair it has once, with its count in
training texts, to the group that owns the context, and gets back the numbers of the kept ones. Nothing of the model
passes the driver but four sums; the number of states grows with the corpus. A chunk has ``FANOUT`` rows to send at
most: where there are more groups, pairs travel over relays, each of which adds up the pairs of about as many chunks,
sends the sums on by the next digit of the group's number, and hands the answers back. So rows grow with the text, and
the pairs of a frequent context arrive added up. Words and contexts are named by 64-bit hashes; the group's number and 32
further bits of a context are compared, and 32 bits of the next token.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from reelspan.llm.common import drop_staged, release, stage, stage_at
from reelspan.llm.minhash import _mix, words_at
from reelspan.session import ensure_checkpoint_dir

#: Longest context, nats a context must gain, discount of its counts, tokens of a chunk, chunks (of six bytes a token) to
#: a group, rows a chunk or a relay sends at most.
DEPTH, LEAST_GAIN, DISCOUNT, CHUNK, CHUNKS_A_GROUP, FANOUT = 3, 2.0, 0.75, 1 << 20, 4, 64
#: Questions go over relays in so many parts, one after the other: the disk holds the shuffles of one.
PARTS = 4
_U = np.uint64
END, BEGIN, _STEP = _U(0x1F83D9ABFB41BD6B), _U(0x5BE0CD19137E2179), _U(0xC2B2AE3D27D4EB4F)
#: ln p is sent in tenths for the divergence test only; scores use it in full.
_TENTHS = 10.0


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


# --- chunks ---------------------------------------------------------------------------------------------------------

_CHUNK_SCHEMA = "chunk long, doc_ids array<long>, sizes array<int>, train array<boolean>, words binary, tokens binary"


def _tokens(column: pa.Array, at_once: int = 1 << 20) -> Iterator[np.ndarray]:
    """Each text's word hashes and END; hashed about a megabyte at a time."""
    held, size = [], 0

    def cut():
        hashes, start = words_at(b"\n".join(held))
        ends = np.searchsorted(start, np.cumsum([len(h) + 1 for h in held]))
        return np.split(np.insert(hashes, ends, END), ends[:-1] + np.arange(1, len(held))) if held else []

    for text in column:
        held.append((text.as_py() or "").encode("utf-8", "surrogatepass").lower())
        size += len(held[-1])
        if size >= at_once:
            yield from cut()
            held, size = [], 0
    yield from cut()


def _to_chunks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        docs, train, held, n = [], [], [], 0

        def row():
            hashes = np.concatenate(held)
            found = pa.array(hashes).dictionary_encode()
            words, token = found.dictionary.to_numpy(), found.indices.to_numpy()
            order = np.argsort(-np.bincount(token), kind="stable")  # frequent words get small numbers, which pack well
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order), dtype="<u4")
            cols = [[number], [list(docs)], [[len(h) for h in held]], [list(train)], [words[order].tobytes()], [_pack(place[token])]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["chunk", "doc_ids", "sizes", "train", "words", "tokens"])

        for b in batches:
            for d, t, tokens in zip(b.column("doc_id").to_pylist(), b.column("train").to_pylist(), _tokens(b.column("text"))):
                held.append(tokens)
                docs.append(d)
                train.append(t)
                n += len(tokens)
                if n >= most:
                    yield row()
                    number, docs, train, held, n = number + 1, [], [], [], 0
        if docs:
            yield row()

    return run


def _by_chunk(chunks: DataFrame, groups: int) -> DataFrame:
    """The chunks as a table bucketed by chunk in the shared folder, so that answers come to them and they stay."""
    spark = chunks.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"suffix_tree_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    chunks.repartition(groups, "chunk").write.bucketBy(groups, "chunk").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: the files stay
    return table


class Chunk:
    """One chunk's tokens with the probabilities of the states known so far.

    The tokens still in the tree are sorted by themselves, then by the word before, the one before that and so on, a word
    more at each level. So those that share a (context, next token) pair are one run, and hashes, counts and
    probabilities are held once a run.
    """

    def __init__(self, row: dict, answers: dict[tuple[int, int], tuple[bytes, bytes, bytes]], totals: tuple[int, int, float], fan: int):
        self.fan = fan
        words = np.frombuffer(row["words"], _U)
        ranked = np.argsort(words)
        rank = np.empty(len(words), _U)
        rank[ranked] = np.arange(len(words), dtype=_U)
        self.words, self.token = words[ranked], rank[_unpack(row["tokens"], "<u4")]  # numbered by hash here
        self.sizes = np.array(row["sizes"], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(np.array(row["train"], bool), self.sizes)
        self.number = row["chunk"]
        # root
        order, cuts = by_digit(self.words, fan)
        self.count = np.zeros(len(self.words), np.int64)
        for g in range(fan):
            if (0, g) in answers:
                self.count[order[cuts[g]:cuts[g + 1]]] = _unpack(answers[0, g][0], "<u4")
        tokens, kinds, discount = totals
        # of each run: its context, its next token, that one's probability; of each token: its place and its run
        self.context, self.next = np.zeros(len(self.words), _U), self.words
        self.p = np.where(self.count > 0, self.count - discount, discount * kinds) / max(tokens, 1) if tokens else np.ones(len(self.words))
        self.at, self.run, self.before = np.arange(len(self.token)), self.token.view(np.int64), self.token
        self.kept, self.known = None, [(self.at, self.run, self.p)]
        # contexts, longer and longer
        for level in range(1, 1 + max((k[0] for k in answers), default=0)):
            pairs = self.pairs(level)
            if pairs is None:
                break
            first, order, cuts = pairs
            self.run = np.repeat(np.arange(len(first)), np.diff(first, append=len(self.at)))
            self.kept = np.zeros(len(first), bool)
            got = [(cuts[g], cuts[g + 1], *answers[level, g]) for g in range(fan) if (level, g) in answers]
            if got:
                where = np.concatenate([order[lo:hi][np.unpackbits(_unpack(mask, "<u1"), count=hi - lo).view(bool)] for lo, hi, mask, _, _ in got])
                size, nexts = (np.concatenate(x) for x in zip(*(np.split(_unpack(figures, "<u4"), 2) for *_, figures in got)))
                own, rest = shares(np.concatenate([_unpack(n, "<u4") for *_, n, _ in got]), size, nexts)
                self.kept[where] = True
                self.p[where] = own + rest * self.p[where]
            self.known.append((self.at, self.run, self.p))

    def pairs(self, level: int):
        """Distinct (context, next token) pairs of the tokens that are still in the tree: where each begins among the tokens,
        the order by digit and key and the digits' bounds in it. Narrows to tokens with so long a context."""
        begin = len(self.words)  # one BEGIN stands before each document, nothing before that
        self.before = np.concatenate([self.before[:1], self.before[:-1]])
        self.before[self.first] = begin + (level > 1)
        before = self.before[self.at]
        there = before <= _U(begin)
        if self.kept is not None:
            there &= self.kept[self.run]
        if not there.any():
            return None
        bits = _U(begin.bit_length())
        before |= self.run.view(_U) << bits  # runs are numbered in order
        both, self.at = ordered(before[there], self.at[there], len(self.token))
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        both = both[first]
        shorter, word = (both >> bits).view(np.int64), (both & ((_U(1) << bits) - _U(1))).view(np.int64)
        self.next, self.p = self.next[shorter], self.p[shorter]
        with np.errstate(over="ignore"):
            words = np.append(self.words, BEGIN)
            if level == 1:  # each word is a context
                context = _mix(words + _U(level))
                self.context, owner = context[word], self.owner(context)[word]
            else:
                self.context = _mix(self.context[shorter] * _STEP + words[word] + _U(level))
                owner = self.owner(self.context)
        # runs of one context are in the order of their next tokens already
        owner, order = ordered(owner, np.arange(len(first)), len(first))
        return first, order, np.searchsorted(owner, np.arange(self.fan + 1, dtype=_U) << _U(32))

    def owner(self, context: np.ndarray) -> np.ndarray:
        """What orders contexts: their digits, then the bits of them that are compared."""
        return context % _U(self.fan) << _U(32) | _mix(context) >> _U(32)

    def probabilities(self) -> np.ndarray:
        """Of each token, by the longest context known."""
        out = np.empty(len(self.token))
        for at, run, p in self.known[1:] or self.known:  # every token has a context of one
            out[at] = p[run]
        return out


def ordered(values: np.ndarray, numbers: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Values in order, and their numbers, each less than ``below``; those of equal values in their own order."""
    bits = _U(int(below).bit_length())
    if int(values.max(initial=0)).bit_length() + int(bits) <= 64:  # sorting integers of 64 bits takes far less than sorting indices
        both = values << bits
        both |= numbers.view(_U)
        both.sort()
        numbers = (both & ((_U(1) << bits) - _U(1))).view(np.int64)
        both >>= bits
        return both, numbers
    order = np.lexsort([numbers, values])
    return values[order], numbers[order]


def distinct(keys: np.ndarray, kind: str = "quicksort") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, one place of each, and each row's number among them."""
    order = np.argsort(keys, kind=kind)
    ranked = keys[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[:len(keys)]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], order[new], inverse


def by_digit(owner: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in stable order by their next group digit, and the digits' bounds in it."""
    digit = (owner % _U(fan)).astype(np.uint16)
    return np.argsort(digit, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(digit, minlength=fan))])


def onward(owner: np.ndarray, fan: int, hops: int) -> np.ndarray:
    """The digits of the group's number after the first, and no more of the hash, which would not pack."""
    return owner // _U(fan) % _U(fan ** (hops - 1))


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=_U(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, "<u8"), dtype=_U)


# --- counting and growing -------------------------------------------------------------------------------------------

_ASK = "g long, chunk long, keys binary, counts binary, tenths binary, path binary"
_ASK_NAMES = [c.split()[0] for c in _ASK.split(", ")]
_ASK_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_ANSWER = "chunk long, level int, g long, x binary, y binary, z binary, tokens long, kinds long, ones long, twos long"
_TOTALS = ("tokens", "kinds", "ones", "twos")
_ANSWER_NAMES = [c.split()[0] for c in _ANSWER.split(", ")]
_ANSWER_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _table(rows: list[tuple], names, kinds) -> pa.Table:
    cols = zip(*rows) if rows else [()] * len(kinds)
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


def questions(source: int, node: int, keys, n, tenths, path, order, cuts, hops: int) -> list[tuple]:
    """A row for each next digit that some key has. path: what is left of the keys' group numbers after this digit."""
    out = []
    for d, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
        if low < high:
            o = order[low:high]
            out.append((node * (len(cuts) - 1) + d, source, _pack_sorted(keys[o]), _pack(n[o].astype("<u4")), _pack(tenths[o]) if len(tenths) else b"",
                        _pack(path[o].astype("<u8")) if hops > 1 else b""))
    return out


class Asked:
    """The keys of several questions, added up."""

    def __init__(self, table: pa.Table):
        self.rows = table.to_pylist()
        keys = [_unpack_sorted(r["keys"]) for r in self.rows]
        self.sizes = [len(k) for k in keys]
        self.keys, self.first, self.inverse = distinct(np.concatenate(keys), "stable")  # runs are in order already
        self.n = np.bincount(self.inverse, np.concatenate([_unpack(r["counts"], "<u4") for r in self.rows])).astype(np.int64)

    def plane(self, name: str, kind: str) -> np.ndarray:
        """A further array of the questions, empty if they have none."""
        return np.concatenate([_unpack(r[name], kind) for r in self.rows])[self.first] if self.rows[0][name] else np.empty(0, kind)

    def answers(self, level: int, kept: np.ndarray, n: np.ndarray, *context: np.ndarray) -> list[tuple]:
        """To each asker: which of its keys are kept, their counts, and two figures of their contexts. At the root: counts."""
        out, at = [], 0
        for r, size in zip(self.rows, self.sizes):
            pair = self.inverse[at:at + size]
            at += size
            if level == 0:
                out.append((r["chunk"], 0, r["g"], _pack(n[pair].astype("<u4")), None, None, 0, 0, 0, 0))
            elif (mask := kept[pair]).any():
                pair = pair[mask]
                figures = _pack(np.concatenate([c[pair] for c in context]).astype("<u4"))
                out.append((r["chunk"], level, r["g"], _pack(np.packbits(mask)), _pack(n[pair].astype("<u4")), figures, 0, 0, 0, 0))
        return out


def _relay(fan: int, hops: int):
    """Adds up the questions of a block of askers and sends them on by the next digit; ``hops`` are left."""
    def run(table: pa.Table) -> pa.Table:
        a = Asked(table)
        path = a.plane("path", "<u8")
        order, cuts = by_digit(path, fan)
        block, node = a.rows[0]["block"], a.rows[0]["g"]
        return _table(questions(block, node, a.keys, a.n, a.plane("tenths", "<u1"), path // _U(fan), order, cuts, hops), _ASK_NAMES, _ASK_KINDS)

    return run


def _hand_back(fan: int, level: int):
    """Answers to a relay's questions become answers to its askers."""
    def run(asked: pa.Table, answers: pa.Table) -> pa.Table:
        if not asked.num_rows or not answers.num_rows:
            return _table([], _ANSWER_NAMES, _ANSWER_KINDS)
        a = Asked(asked)
        order, cuts = by_digit(a.plane("path", "<u8"), fan)
        kept = np.zeros(len(a.keys), bool)
        n, size, nexts = (np.zeros(len(a.keys), np.int64) for _ in range(3))
        for r in answers.select(["digit", "x", "y", "z"]).to_pylist():
            where = order[cuts[r["digit"]]:cuts[r["digit"] + 1]]
            if level == 0:
                n[where] = _unpack(r["x"], "<u4")
            else:
                where = where[np.unpackbits(_unpack(r["x"], "<u1"), count=len(where)).view(bool)]
                kept[where], n[where] = True, _unpack(r["y"], "<u4")
                size[where], nexts[where] = np.split(_unpack(r["z"], "<u4"), 2)
        return _table(a.answers(level, kept, n, size, nexts), _ANSWER_NAMES, _ANSWER_KINDS)

    return run


def _ask_words(fan: int, hops: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row, {}, (0, 0, 0.0), fan)
                n = np.bincount(c.token[c.train].view(np.int64), minlength=len(c.words))
                out = questions(c.number, 0, c.words, n, (), onward(c.words, fan, hops), *by_digit(c.words, fan), hops)
                yield from _table(out, _ASK_NAMES, _ASK_KINDS).to_batches()

    return run


def _count_words(table: pa.Table) -> pa.Table:
    """Counts of a group's words, given back to each asker in its order; the group's totals in the first row."""
    a = Asked(table)
    out = a.answers(0, None, a.n)
    out[0] = (*out[0][:6], int(a.n.sum()), int((a.n > 0).sum()), int((a.n == 1).sum()), int((a.n == 2).sum()))
    return _table(out, _ANSWER_NAMES, _ANSWER_KINDS)


def kept_contexts(context: np.ndarray, n: np.ndarray, ln_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The divergence test. Sorted distinct pairs: their context, training count and ln of the shorter context's
    probability. Gives per pair whether its context is kept, the context's tokens and its distinct next tokens."""
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    of = np.cumsum(np.concatenate([[True], context[1:] != context[:-1]])) - 1
    size, kinds = np.add.reduceat(n, first), np.add.reduceat((n > 0).astype(np.int64), first)
    p = np.exp(ln_p)
    rest, rest_kinds = np.maximum(size[of] - 1, 1), kinds[of] - (n == 1)
    without = np.maximum(n - 1 - DISCOUNT, 0) / rest + DISCOUNT * rest_kinds / rest * p
    gain = np.where((n > 0) & (size[of] > 1), n * (np.log(np.maximum(without, 1e-300)) - ln_p), 0.0)
    kept = np.add.reduceat(gain, first) >= LEAST_GAIN
    return kept[of], size[of], kinds[of]


def shares(n: np.ndarray, size: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a pair has of its own in its context's distribution, and how much of the shorter context's is added."""
    size = np.maximum(size.astype(np.int64), 1)
    return np.maximum(n.astype(np.int64) - DISCOUNT, 0) / size, DISCOUNT * kinds / size


def _grow(level: int):
    def run(table: pa.Table) -> pa.Table:
        a = Asked(table)
        kept, size, nexts = kept_contexts(a.keys >> _U(32), a.n, a.plane("tenths", "<u1") / -_TENTHS)
        return _table(a.answers(level, kept, a.n, size, nexts), _ANSWER_NAMES, _ANSWER_KINDS)

    return run


def _with_answers(chunks: pa.Table, answers: pa.Table, totals, fan: int) -> Iterator[Chunk]:
    given = {(r["level"], r["g"]): (r["x"], r["y"], r["z"]) for r in answers.select(["level", "g", "x", "y", "z"]).to_pylist()}
    for row in chunks.to_pylist():
        yield Chunk(row, given, totals, fan)


def _ask_pairs(level: int, totals, fan: int, hops: int):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for c in _with_answers(chunks, answers, totals, fan):
            pairs = c.pairs(level)
            if pairs is None:
                continue
            first, order, cuts = pairs
            keys = (_mix(c.context) & ~_U(0xFFFFFFFF)) | c.next >> _U(32)
            n = np.add.reduceat(c.train[c.at], first, dtype=np.int64)
            tenths = np.clip(np.round(-np.log(c.p) * _TENTHS), 0, 255).astype("<u1")
            out += questions(c.number, 0, keys, n, tenths, onward(c.context, fan, hops) if hops > 1 else (), order, cuts, hops)
        return _table(out, _ASK_NAMES, _ASK_KINDS)

    return run


def routes(groups: int, most: int) -> tuple[int, int]:
    """Digits of a group's number: how many values each has, at most ``most``, and how many there are."""
    hops = 1
    while most ** hops < groups:
        hops += 1
    fan = 1
    while fan ** hops < groups:
        fan += 1
    return fan, hops


def exchange(asked: DataFrame, answer, level: int, fan: int, hops: int, askers: int) -> tuple[DataFrame, DataFrame]:
    """The answers of the groups to ``askers`` chunks, and the totals of the groups.

    Over relays the questions are kept for the way back, and go in ``PARTS`` parts by their next digit, which all
    questions to a group share. Of each part nothing but its answers stays, and of the questions nothing in the end.
    """
    if hops == 1:
        given = stage(asked.groupBy("g").applyInArrow(answer, _ANSWER))
        return given, given
    spark = asked.sparkSession
    whole, path = stage_at(asked.withColumn("part", (F.col("g") % PARTS).cast("int")), "part")
    release(spark)
    answers, totals = [], []
    for part in range(PARTS):
        a, t = _over_relays(whole.where(F.col("part") == part).drop("part"), answer, level, fan, hops, askers)
        answers, totals = [*answers, a], [*totals, t]
        release(spark)
    drop_staged(spark, path)
    return reduce(DataFrame.union, answers), reduce(DataFrame.union, totals)


def _over_relays(asked: DataFrame, answer, level: int, fan: int, hops: int, askers: int) -> tuple[DataFrame, DataFrame]:
    """``exchange`` of one part of the questions, which are staged."""
    passed, paths = [], []
    for left in range(hops - 1, 0, -1):
        askers = -(-askers // fan)
        passed.append(asked.withColumn("block", F.pmod(F.xxhash64("chunk"), F.lit(askers))))
        asked = passed[-1].groupBy("g", "block").applyInArrow(_relay(fan, left), _ASK)
        if left > 1:
            asked, path = stage_at(asked)
            paths.append(path)
    given, path = stage_at(asked.groupBy("g").applyInArrow(answer, _ANSWER))
    paths.append(path)
    totals, answers = stage(given.select(*_TOTALS)), given
    for questions_ in reversed(passed):
        back = answers.select(F.expr(f"g div {fan}").alias("g"), F.col("chunk").alias("block"), F.expr(f"cast(g % {fan} as int)").alias("digit"), "x", "y", "z")
        answers, path = stage_at(questions_.groupBy("g", "block").cogroup(back.groupBy("g", "block")).applyInArrow(_hand_back(fan, level), _ANSWER))
        paths.append(path)
    drop_staged(asked.sparkSession, *paths[:-1])
    return answers, totals


def _score(totals, fan: int):
    tokens, kinds, _ = totals

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        cols = [[] for _ in range(6)]
        for row, c in zip(chunks.select(["doc_ids", "train"]).to_pylist(), _with_answers(chunks, answers, totals, fan)):
            base = np.log10((c.count + 1) / (tokens + kinds + 1))[c.token]
            for col, x in zip(cols, (row["doc_ids"], [not t for t in row["train"]], c.sizes, np.add.reduceat((c.count > 0)[c.token], c.first, dtype=np.int64),
                                     np.add.reduceat(base, c.first), np.add.reduceat(np.log10(c.probabilities()), c.first))):
                col.extend(x)
        kinds_ = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, k) for x, k in zip(cols, kinds_)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, folds: int = 7, fold: int = 2, depth: int = DEPTH, chunk_tokens: int = CHUNK,
          fanout: int = FANOUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Tokens are the words of the text with A-Z in lower case and one end. Rows whose crc32(doc_id) mod ``folds`` is
    ``fold`` are held out, others train; null ids train. base_score: add-one unigram; score: the tree; both log10 of
    the whole text's probability, over the training words and one symbol for all others. Null and empty texts are one
    end. Repeated rows count and are scored as often as they occur. An empty table gives none.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held).alias("train"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (CHUNKS_A_GROUP * 6 * chunk_tokens)))
    release(spark)
    chunks = _by_chunk(cols.mapInArrow(_to_chunks(chunk_tokens), _CHUNK_SCHEMA), groups)

    fan, hops = routes(groups, fanout)
    askers = chunks.count()

    answers, given = exchange(chunks.mapInArrow(_ask_words(fan, hops), _ASK), _count_words, 0, fan, hops, askers)
    t = given.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _TOTALS]).first()
    discount = t.ones / (t.ones + 2 * t.twos) if t.ones and t.twos else 0.5
    totals = (t.tokens, t.kinds, discount)

    def together(fn, schema: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(fn, schema)

    for level in range(1, depth + 1):
        grown, _ = exchange(together(_ask_pairs(level, totals, fan, hops), _ASK), _grow(level), level, fan, hops, askers)
        answers = answers.union(grown)
        del grown
        release(spark)
    out = together(_score(totals, fan), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(t.tokens).cast("long"))
