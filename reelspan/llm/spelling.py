"""Spelling variants: words one edit apart, found by K-d trees over their letter counts.

One inserted or deleted letter moves a word's vector of letter counts by one in one place, one replaced letter by one up
and one down: an L1 distance of at most two. So near words of one length, or of two neighbouring lengths, lie in boxes
within that reach. Per length a K-d tree cuts the words into cells; its planes are fitted on a bounded sample of all
words, every word is put into its cell, and also sent, as a question, to each cell of its own and of the next length
that its reach touches. In a cell a finer tree over all its words prunes box by box; what is left is compared by whole
vectors and then letter by letter. All words meet all their near words, and no pair leaves its cell: a word takes
its number of near words and the best of them along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reelspan.llm.common import stage

#: Letters of a word, as a Java pattern; the last code points are Latin-1.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Least length and occurrences of a word; how many times more frequent its form is.
LEAST_CHARS, LEAST_N, TIMES = 7, 2, 10
#: Words sampled to fit the cells; words aimed at in a cell, points in a box of the finer tree, questions asked at a time.
SAMPLE, CELL, BOX, AT_ONCE = 32_768, 8_192, 128, 4_096
_PLACE = np.full(256, -1, np.int64)
_PLACE[list(range(97, 123)) + list(range(192, 256))] = np.arange(90)
PLACES = 90
_INDEX, _SAME, _SHORTER = 0, 1, 2  # what a row is to its cell: one of its words, a question of equal length, of the length before


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(docs: DataFrame, misspell: int | None = None) -> DataFrame:
    """word, n: distinct letter runs of all texts, A-Z lower-cased, of at least LEAST_CHARS code points and LEAST_N occurrences.

    With ``misspell``, of the occurrences whose crc32 of ``doc_id:run`` it divides, the code point at crc32 % length is left
    out. Null texts have no words; a null doc_id stands as an empty string. Counts are summed before the shuffle.
    """
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"({LETTERS}{{{LEAST_CHARS},}})"), 1)  # shorter runs stay too short
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    w = _ascii_lower(F.col("run"))
    if misspell:
        d = d.select("id", w.alias("w")).select("w", F.crc32(F.concat("id", F.lit(":"), "w").cast("binary")).alias("h"))
        at = (F.col("h") % F.length("w")).cast("int")
        cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
        w = F.when(F.col("h") % misspell == 0, cut).otherwise(F.col("w"))
    d = d.select(w.alias("word")).where(F.length("word") >= LEAST_CHARS)
    return d.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_N)


# --- trees ----------------------------------------------------------------------------------------------------------

def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def vectors(codes: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each word."""
    n = len(codes)
    return np.bincount((np.arange(n)[:, None] * PLACES + _PLACE[codes]).ravel(), minlength=n * PLACES).reshape(n, PLACES).astype(np.int32)


class Tree:
    """A K-d tree over letter counts: each inner node cuts at the place and count that halve its points best."""

    def __init__(self, x: np.ndarray, most: float, least: int = 1):
        """Cuts until a leaf has at most ``most`` points, or no cut leaves ``least`` points on each side."""
        self.nodes: list[tuple[int, int, int, int] | None] = []  # place, cut (right: count >= cut), left, right; a leaf: None
        self.points: dict[int, np.ndarray] = {}
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            idx, parent, side = todo.pop()
            me = len(self.nodes)
            self.nodes.append(None)
            if parent >= 0:
                p = self.nodes[parent]
                self.nodes[parent] = (p[0], p[1], me if side == 0 else p[2], me if side else p[3])
            cut = self._cut(x[idx], least) if len(idx) > most else None
            if cut is None:
                self.points[me] = idx
                continue
            place, at = cut
            right = x[idx, place] >= at
            self.nodes[me] = (place, at, -1, -1)
            todo += [(idx[right], me, 1), (idx[~right], me, 0)]

    @staticmethod
    def _cut(x: np.ndarray, least: int) -> tuple[int, int] | None:
        n = len(x)
        middle = np.partition(x, n // 2, axis=0)[n // 2]
        best = None
        for at in (middle, middle + 1):
            above = (x >= at).sum(axis=0)
            d = int(np.argmin(np.abs(2 * above - n)))
            worth = min(int(above[d]), n - int(above[d]))
            if worth >= least and (best is None or worth > best[0]):
                best = (worth, d, int(at[d]))
        return best and best[1:]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf each point lies in."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            me, idx = todo.pop()
            node = self.nodes[me]
            if node is None:
                out[idx] = me
            elif len(idx):
                right = x[idx, node[0]] >= node[1]
                todo += [(node[2], idx[~right]), (node[3], idx[right])]
        return out

    def reach(self, x: np.ndarray, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the points that become one of theirs when one letter is added and ``down`` letters are taken away."""
        zero = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)), zero, zero, {})]
        while todo:
            me, idx, up_used, down_used, box = todo.pop()
            node = self.nodes[me]
            if node is None:
                yield me, idx
                continue
            place, at, left, right = node
            v = x[idx, place]
            lo, hi = box.get(place, (0, 1 << 30))
            up = up_used - np.maximum(lo - v, 0) + np.maximum(at - v, 0)
            dn = down_used - np.maximum(v - hi, 0) + np.maximum(v - (at - 1), 0)
            for child, ok, u, d, b in ((right, up <= 1, up, down_used, (at, hi)), (left, dn <= down, up_used, dn, (lo, at - 1))):
                if ok.any():
                    todo.append((child, idx[ok], u[ok], d[ok], {**box, place: b}))


class Cells:
    """Numbers of the cells: per length a tree's leaves, each split by hash where its points cannot be told apart."""

    def __init__(self, sample: dict[int, np.ndarray], a_point: float):
        """sample: vectors by length; a_point: how many words one of them stands for."""
        self.trees: dict[int, Tree] = {}
        self.first: dict[tuple[int, int], tuple[int, int]] = {}  # (length, leaf) -> first cell, number of cells
        n = 0
        for size in sorted(sample):
            t = self.trees[size] = Tree(sample[size], max(16.0, CELL / a_point), 4)
            for leaf, points in t.points.items():
                salts = max(1, round(len(points) * a_point / (4 * CELL)))
                self.first[size, leaf] = (n, salts)
                n += salts
            t.points = {}

    def of(self, size: int, leaf: int) -> tuple[int, int]:
        return self.first[size, leaf] if size in self.trees else (-size, 1)

    def route(self, size: int, x: np.ndarray, salt: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(cell, role, rows): where the words of one length are, and where they ask."""
        own = self.trees.get(size)
        leaf = own.leaf(x) if own else np.zeros(len(x), np.int64)
        for k in np.unique(leaf):
            idx = np.flatnonzero(leaf == k)
            cell, salts = self.of(size, int(k))
            for s in range(salts):
                part = idx[salt[idx] % salts == s]
                if len(part):
                    yield cell + s, _INDEX, part
        for other, role, down in ((size, _SAME, 1), (size + 1, _SHORTER, 0)):
            t = self.trees.get(other)
            for k, idx in t.reach(x, down) if t else [(0, np.arange(len(x)))]:
                cell, salts = self.of(other, k)
                for s in range(salts):
                    yield cell + s, role, idx


class Cell:
    """The words of one cell, those with larger n and then smaller letters first, below a tree of boxes."""

    def __init__(self, words: list[str], n: np.ndarray):
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.words, self.n = [words[i] for i in order], n[order]
        self.codes = letters(self.words)
        x = vectors(self.codes)
        self.tree = Tree(x, BOX)
        # inner products are exact in this type
        self.kind = np.float32 if self.codes.shape[1] < 2000 else np.float64
        self.boxes = {}
        for leaf, idx in self.tree.points.items():
            p = x[idx]
            self.boxes[leaf] = (np.sort(idx), p.min(axis=0), p.max(axis=0))
        self.x, self.squares = x.astype(self.kind), (x.astype(np.int64) ** 2).sum(axis=1)
        self.near = np.zeros(len(words), np.int64)
        self.best: list[tuple[int, str] | None] = [None] * len(words)

    def ask(self, words: list[str], n: np.ndarray, shorter: bool) -> tuple[np.ndarray, list[tuple[int, str] | None]]:
        """For each question its near words here: how many, and the best as (-n, word). Questions of the length before
        also count for the words they meet."""
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i])) if shorter else list(range(len(words)))
        asked, n = [words[i] for i in order], n[order]
        codes = letters(asked)
        x = vectors(codes)
        near, best = np.zeros(len(asked), np.int64), np.full(len(asked), len(self.words))
        theirs = np.full(len(self.words), len(asked))
        squares, xk, apart = (x.astype(np.int64) ** 2).sum(axis=1), x.astype(self.kind), 1 if shorter else 2
        for leaf, idx in self.tree.reach(x, 0 if shorter else 1):
            points, lo, hi = self.boxes[leaf]
            q = x[idx]
            idx = idx[(np.maximum(lo - q, 0).sum(axis=1) <= 1) & (np.maximum(q - hi, 0).sum(axis=1) <= apart - 1)]
            if not len(idx):
                continue
            # whole numbers whose squared differences add up to one or two (with equal sums) differ by one in one or two places
            far = squares[idx][:, None] + self.squares[points][None, :] - 2 * (xk[idx] @ self.x[points].T)
            i, j = np.nonzero(far == apart)
            i, j = idx[i], points[j]
            ok = self._inserted(codes[i], self.codes[j]) if shorter else (codes[i] != self.codes[j]).sum(axis=1) == 1
            i, j = i[ok], j[ok]
            np.add.at(near, i, 1)
            np.minimum.at(best, i, j)
            if shorter:
                np.add.at(self.near, j, 1)
                np.minimum.at(theirs, j, i)
        for j in np.flatnonzero(theirs < len(asked)):
            found = (-int(n[theirs[j]]), asked[theirs[j]])
            if self.best[j] is None or found < self.best[j]:
                self.best[j] = found
        out, counts = [None] * len(asked), np.zeros(len(asked), np.int64)
        for k, i in enumerate(order):
            counts[i] = near[k]
            if near[k]:
                out[i] = (-int(self.n[best[k]]), self.words[best[k]])
        return counts, out

    @staticmethod
    def _inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
        """Whether one code point put into the shorter word gives the longer one."""
        n = short.shape[1]
        front = np.logical_and.accumulate(short == long[:, :n], axis=1).sum(axis=1)
        back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        return front + back >= n


# --- Spark ----------------------------------------------------------------------------------------------------------

def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return {int(s): np.flatnonzero(sizes == s) for s in np.unique(sizes)}


def _fit(w: DataFrame) -> Cells:
    """Cells fitted on about SAMPLE words, picked by hash; what reaches the driver is their vectors."""
    total = w.count()
    share = min(1.0, SAMPLE / max(1, total))
    picked = w.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = b.column("word").to_pylist()
            for size, idx in _by_length(ws).items():
                x = np.minimum(vectors(letters([ws[i] for i in idx])), 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(x), pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], names=["size", "x"])

    got = picked.mapInArrow(run, "size int, x binary").toArrow()
    sizes, raw = got["size"].to_numpy(), got["x"].to_pylist()
    x = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, PLACES).astype(np.int32)
    return Cells({int(s): x[sizes == s] for s in np.unique(sizes)}, total / max(1, len(x)))


def near_words(w: DataFrame) -> DataFrame:
    """word, n_near, best (struct of less = -n, and word) of every word of ``w`` (word, n; distinct) that has near words."""
    cells = w.sparkSession.sparkContext.broadcast(_fit(w))  # planes over at most SAMPLE points

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws, n, salts = b.column("word").to_pylist(), b.column("n"), b.column("salt").to_numpy()
            for size, idx in _by_length(ws).items():
                x = vectors(letters([ws[i] for i in idx]))
                for cell, role, rows in cells.value.route(size, x, salts[idx]):
                    at = pa.array(idx[rows])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), cell)), pa.array(np.full(len(rows), role, np.int8)), b.column("word").take(at), n.take(at)],
                                                     names=["cell", "role", "word", "n"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, built = None, [], None

        def rows(words, near, best):
            hit = [i for i in range(len(words)) if near[i]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            cols = [words[i] for i in hit], [int(near[i]) for i in hit], [best[i][0] for i in hit], [best[i][1] for i in hit]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["word", "n_near", "less", "near"])

        for b in batches:
            keys = b.column("cell").to_numpy() * 4 + b.column("role").to_numpy()
            starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else []
            for lo, hi in zip(starts, [*starts[1:], len(keys)]):
                of, role = int(keys[lo]) // 4, int(keys[lo]) % 4
                if of != cell:
                    if built is not None:
                        yield rows(built.words, built.near, built.best)
                    cell, held, built = of, [], None
                ws, n = b.column("word").slice(lo, hi - lo).to_pylist(), b.column("n").slice(lo, hi - lo).to_numpy()
                if role == _INDEX:
                    held.append((ws, n))
                    continue
                if not held:
                    continue  # nobody to ask here
                if built is None:
                    built = Cell([x for ws_, _ in held for x in ws_], np.concatenate([n_ for _, n_ in held]))
                for at in range(0, len(ws), AT_ONCE):
                    some = ws[at:at + AT_ONCE]
                    yield rows(some, *built.ask(some, n[at:at + AT_ONCE], role == _SHORTER))
        if built is not None:
            yield rows(built.words, built.near, built.best)

    d = w.select("word", "n", F.pmod(F.xxhash64("word", F.lit("salt")), F.lit(1 << 30)).alias("salt"))
    d = d.mapInArrow(route, "cell long, role byte, word string, n long").repartition("cell").sortWithinPartitions("cell", "role")
    d = d.mapInArrow(match, "word string, n_near long, less long, near string")
    return d.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def variants(docs: DataFrame, misspell: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``docs`` (see ``words``).

    Near words differ by exactly one inserted, deleted or replaced code point; n_near is their number. form is the near word of
    largest n (ties: smallest in code-point order) if that is at least TIMES the word's own n, else null, form_n its n. root
    is where the forms lead, the word itself without one. Repeated rows count; texts without words give nothing, an empty
    table gives an empty table. Other columns of ``docs`` take no part.
    """
    w = stage(words(docs.select("doc_id", "text"), misspell))
    near = w.join(near_words(w), "word", "left")
    ok = -F.col("best.less") >= TIMES * F.col("n")
    d = stage(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                          F.when(ok, F.col("best.near")).alias("form"), F.when(ok, -F.col("best.less")).cast("long").alias("form_n")))
    # n grows tenfold a step, so a path has fewer than 20; its reach doubles a round
    roots = d.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = stage(roots.join(step, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return d.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
