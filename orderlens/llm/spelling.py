"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

One inserted, deleted or replaced letter moves a word's vector of letter counts by a distance (L1)
of two at most: one count rises by one, or one falls by one, or both. Words of one length are points of
a k-d tree. A search for a word's neighbours walks down the tree of its own length (one count may
rise and one fall) and the tree of the length below (one count falls); it enters a box only while
the rise and the fall that lead into it are still to be had. Words met in the same leaf with
matching vectors are then compared letter by letter.

The tree has two levels. Its upper part is grown in Spark: in each round every cell with too many words is split
at the count that halves it best, by exact histograms of its words. It has one leaf per ``CELL``
words and goes to all tasks. Every word is sent to its cell as a point and to the cells
that its search enters as a query; a task builds the lower part over the points of one cell.
Searches stop at an upper leaf by the same rule as below, so nothing is lost between cells.

Letters are A-Z, a-z and U+00C0 to U+00FF, one byte each in Latin-1, whose order is code-point order.

Nulls and edges: a null or empty text has no words; a null doc_id counts as an empty one in the
deletion rule. Counts above 255 in a vector stand as 255, which only widens a search. Rows repeat:
every occurrence counts. A word of any length is handled whole. Words whose letter counts are all equal share
a cell and a leaf, however many they are. No documents give no words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.storage import stored
from orderlens.llm.text import LOWER, UPPER

#: Words of a cell that is not split further, of a leaf within a cell, and searches that walk together.
CELL, LEAF, TOGETHER = 1 << 14, 16, 1 << 15
#: Bytes of letters compared at a time.
COMPARED = 1 << 24
#: Shortest word, least occurrences, and how many times more often a form occurs than its variant.
SHORTEST, LEAST, RATIO = 7, 2, 10
#: Of the runs of a document, those whose hash this divides lose a letter.
LOSSY = 31

N_LETTERS = 26 + 64
_LETTER = np.full(256, -1, dtype=np.int64)
_LETTER[97:123] = np.arange(26)
_LETTER[0xC0:0x100] = np.arange(26, 90)

#: Hash weights of the letters; a vector's hash is the weighted sum of its counts, modulo 2**64.
_WEIGHT = np.random.default_rng(12).integers(1, 1 << 63, N_LETTERS, dtype=np.uint64) | np.uint64(1)


def _steps_table() -> np.ndarray:
    """Which 20 leading bits a hash difference of one rise, one fall or both can have."""
    table = np.zeros(1 << 20, dtype=bool)
    both = _WEIGHT[:, None] - _WEIGHT[None, :]
    table[(both[~np.eye(N_LETTERS, dtype=bool)] >> np.uint64(44)).astype(np.int64)] = True
    table[((np.uint64(0) - _WEIGHT) >> np.uint64(44)).astype(np.int64)] = True
    return table


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the runs of letters, A-Z lower-cased, some with a letter deleted by the rule of ``LOSSY``."""
    runs = F.regexp_extract_all(F.col(text), F.lit("[A-Za-zÀ-ÿ]{%d,}" % SHORTEST), F.lit(0))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    run = docs.select(key.alias("key"), F.explode(runs).alias("run"))
    run = run.select("key", F.translate("run", UPPER, LOWER).alias("run"))
    run = run.withColumn("hash", F.crc32(F.concat_ws(":", "key", "run")))
    at = (F.col("hash") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("hash") % LOSSY == 0, shorter).otherwise(F.col("run"))
    words = run.select(word.alias("word")).where(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)


def letters_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Count vectors (up to 255) of Latin-1 words, and their hashes."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = _LETTER[np.frombuffer(b"".join(words), dtype=np.uint8)]
    vectors = np.zeros((len(words), N_LETTERS), dtype=np.uint8)
    row = np.repeat(np.arange(len(words)), sizes)
    cell, n = np.unique(row * N_LETTERS + letters, return_counts=True)
    vectors.ravel()[cell] = np.minimum(n, 255)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_WEIGHT[letters], dtype=np.uint64)])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return vectors, sums[ends[1:]] - sums[ends[:-1]]


class Tree:
    """Splits of a k-d tree: words whose count of ``letter`` is at most ``most`` go to ``low``, others to ``high``.

    Node numbers below zero are leaves: -1 - leaf.
    """

    def __init__(self) -> None:
        self.letter: list[int] = []
        self.most: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []

    def split(self, letter: int, most: int, low: int, high: int) -> int:
        for column, value in zip((self.letter, self.most, self.low, self.high), (letter, most, low, high), strict=True):
            column.append(value)
        return len(self.letter) - 1

    def leaf_of(self, root: int, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector itself."""
        leaf = np.empty(len(vectors), dtype=np.int64)
        open_ = [(root, np.arange(len(vectors)))]
        while open_:
            node, rows = open_.pop()
            if node < 0:
                leaf[rows] = -1 - node
            elif len(rows):
                below = vectors[rows, self.letter[node]] <= self.most[node]
                open_ += [(self.low[node], rows[below]), (self.high[node], rows[~below])]
        return leaf

    def search(self, root: int, vectors: np.ndarray, rise: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, and the vectors that one fall (and, if asked, one rise) can bring into them.

        A walk carries the letter that has risen and the one that has fallen, or -1.
        """
        start, none = np.arange(len(vectors)), np.full(len(vectors), -1, dtype=np.int16)
        blocked = none if rise else np.full(len(vectors), N_LETTERS, dtype=np.int16)
        open_ = [(root, start, blocked, none)]
        while open_:
            node, rows, up, down = open_.pop()
            if node < 0:
                yield -1 - node, rows
                continue
            letter, most = self.letter[node], self.most[node]
            count = vectors[rows, letter].astype(np.int16) + (up == letter) - (down == letter)
            below = count <= most
            climbs = (count == most) & (up == -1) & (down != letter)
            falls = (count == most + 1) & (down == -1) & (up != letter)
            for child, stay, cross in ((self.low[node], below, falls), (self.high[node], ~below, climbs)):
                own_up, own_down = up, down
                if cross.any():
                    if cross is falls:
                        own_down = np.where(cross, np.int16(letter), down)
                    else:
                        own_up = np.where(cross, np.int16(letter), up)
                    stay = stay | cross
                if stay.any():
                    open_.append((child, rows[stay], own_up[stay], own_down[stay]))


def best_split(vectors: np.ndarray) -> tuple[int, int] | None:
    """Letter and count that halve the vectors best; None where all are equal."""
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    best = None
    for letter in np.flatnonzero(high > low).tolist():
        below = np.cumsum(np.bincount(vectors[:, letter]))[low[letter] : high[letter]]
        at = int(np.argmin(np.abs(2 * below - len(vectors))))
        off = abs(2 * int(below[at]) - len(vectors))
        if best is None or off < best[0]:
            best = off, letter, int(low[letter]) + at
    return best and best[1:]


def grown(vectors: np.ndarray, leaf: int) -> tuple[Tree, int, list[np.ndarray]]:
    """A tree whose leaves hold at most so many points or equal ones, its root, and the points of each leaf."""
    tree, leaves = Tree(), []

    def grow(rows: np.ndarray) -> int:
        split = best_split(vectors[rows]) if len(rows) > leaf else None
        if split is None:
            leaves.append(rows)
            return -len(leaves)
        below = vectors[rows, split[0]] <= split[1]
        return tree.split(*split, grow(rows[below]), grow(rows[~below]))

    return tree, grow(np.arange(len(vectors))), leaves


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by exactly one edit; a's are as long as b's or one longer."""
    n = b.shape[1]
    if a.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    differ = np.ones((len(a), n + 1), dtype=bool)
    differ[:, :n] = a[:, :n] != b
    same = np.argmax(differ, axis=1)  # letters that agree from the start on
    after = np.where(a[:, 1:] != b, np.arange(n), -1).max(axis=1, initial=-1)  # last one that does not, once a has lost one
    return after < same


def pairs_in_cell(points: list[bytes], queries: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries and points one edit apart; points are of one length, queries of one length."""
    steps, size = _steps_table(), len(points[0])
    vectors, hashes = letters_of(points)
    tree, root, leaves = grown(vectors, LEAF)
    letters = np.frombuffer(b"".join(points), dtype=np.uint8).reshape(len(points), size)
    most = max(1, COMPARED // size)
    for start in range(0, len(queries), min(TOGETHER, most)):
        asked = queries[start : start + min(TOGETHER, most)]
        their_vectors, their_hashes = letters_of(asked)
        theirs = np.frombuffer(b"".join(asked), dtype=np.uint8).reshape(len(asked), -1)
        found_q, found_p, held = [], [], 0

        def checked() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if found_q:
                q, p = np.concatenate(found_q), np.concatenate(found_p)
                for a in range(0, len(q), most):
                    qa, pa_ = q[a : a + most], p[a : a + most]
                    near = one_edit(theirs[qa], letters[pa_])
                    yield start + qa[near], pa_[near]

        for leaf, rows in tree.search(root, their_vectors, theirs.shape[1] == size):
            held_points = leaves[leaf]
            for a in range(0, len(held_points), 256):  # more only where vectors are equal
                part = held_points[a : a + 256]
                block = max(1, (1 << 21) // len(part))
                for b in range(0, len(rows), block):
                    own = rows[b : b + block]
                    # the point's vector less the query's
                    gap = (hashes[part][None, :] - their_hashes[own][:, None]) >> np.uint64(44)
                    i, j = np.nonzero(steps[gap.astype(np.int64)])
                    if len(i):
                        found_q.append(own[i])
                        found_p.append(part[j])
                        held += len(i)
                if held >= most:
                    yield from checked()
                    found_q, found_p, held = [], [], 0
        yield from checked()


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths and the places of their words."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


class Cells:
    """The upper part of the tree: a root for every length, and the cells that are its leaves."""

    def __init__(self, lengths: list[int]) -> None:
        self.tree = Tree()
        self.roots = {size: -1 - i for i, size in enumerate(lengths)}
        self.n = len(lengths)

    def split(self, splits: dict[int, tuple[int, int]]) -> None:
        """Split cells at a letter and a count; one half keeps the cell's number."""
        node = {}
        for cell, (letter, most) in splits.items():
            node[-1 - cell] = self.tree.split(letter, most, -1 - cell, -1 - self.n)
            self.n += 1
        new = set(node.values())
        self.roots = {size: node.get(root, root) for size, root in self.roots.items()}
        for i in range(len(self.tree.letter)):
            if i not in new:
                self.tree.low[i] = node.get(self.tree.low[i], self.tree.low[i])
                self.tree.high[i] = node.get(self.tree.high[i], self.tree.high[i])

    def own(self, words: list[bytes]) -> np.ndarray:
        """The cell of each word."""
        cell = np.empty(len(words), dtype=np.int64)
        for size, rows in _by_length(words):
            cell[rows] = self.tree.leaf_of(self.roots[size], letters_of([words[i] for i in rows.tolist()])[0])
        return cell


def _histograms(words: DataFrame, cells: Cells) -> DataFrame:
    """cell, letter, held, n: of the words of every cell, how many hold a letter so many times; letter -1 counts words."""
    shared = words.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            latin = _latin(batch.column(0))
            if not latin:
                continue
            cell = shared.value.own(latin)
            vectors, _ = letters_of(latin)
            row, letter = np.nonzero(vectors)
            key = (cell[row] * N_LETTERS + letter) * 256 + vectors[row, letter]
            keys, n = np.unique(key, return_counts=True)
            whole, total = np.unique(cell, return_counts=True)
            columns = [
                np.concatenate([whole, keys // (256 * N_LETTERS)]),
                np.concatenate([np.full(len(whole), -1), keys // 256 % N_LETTERS]),
                np.concatenate([np.zeros(len(whole), dtype=np.int64), keys % 256]),
                np.concatenate([total, n]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "letter", "held", "n"])

    rows = words.select("word").mapInArrow(run, "cell bigint, letter bigint, held bigint, n bigint")
    return rows.groupBy("cell", "letter", "held").agg(F.sum("n").alias("n"))


def grow_cells(words: DataFrame, most: int = CELL) -> Cells:
    """Cells of at most so many words, or of words with equal vectors; words is read once a round."""
    lengths = [r.size for r in words.select(F.length("word").alias("size")).distinct().orderBy("size").collect()]
    cells = Cells(lengths)
    while True:
        counted = _histograms(words, cells)
        total = counted.where("letter < 0").select("cell", F.col("n").alias("total")).where(F.col("total") > most)
        # counts held by no word of the cell are no splits; those without the letter hold it 0 times
        rows = counted.where("letter >= 0").join(total, "cell")
        absent = rows.groupBy("cell", "letter", "total").agg(F.sum("n").alias("with"))
        absent = absent.select("cell", "letter", F.lit(0).cast("bigint").alias("held"), (F.col("total") - F.col("with")).alias("n"), "total")
        every = rows.select("cell", "letter", "held", "n", "total").unionByName(absent.where("n > 0"))
        below = F.expr("sum(n) OVER (PARTITION BY cell, letter ORDER BY held)")
        every = every.withColumn("below", below).where(F.col("below") < F.col("total"))
        off = F.abs(2 * F.col("below") - F.col("total"))
        splits = every.groupBy("cell").agg(F.min(F.struct(off.alias("off"), "letter", "held")).alias("best"))
        found = {r.cell: (r.best.letter, r.best.held) for r in splits.collect()}
        if not found:
            return cells
        cells.split(found)


def near_counts(words: DataFrame, cells: Cells) -> DataFrame:
    """word, n_near, form, form_n (its near word of largest n; ties: the smallest), for words with near words."""
    shared = words.sparkSession.sparkContext.broadcast(cells)
    kind = "cell bigint, longer boolean, word string, n bigint"

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            latin = _latin(batch.column(0))
            if latin:
                own = pa.array(shared.value.own(latin))
                false = pa.array(np.zeros(len(latin), dtype=bool))
                yield pa.RecordBatch.from_arrays([own, false, *batch.columns], names=["cell", "longer", "word", "n"])

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            latin = _latin(batch.column(0))
            for size, rows in _by_length(latin):
                vectors, _ = letters_of([latin[i] for i in rows.tolist()])
                for below in (0, 1):
                    root = shared.value.roots.get(size - below)
                    if root is None:
                        continue
                    for cell, reached in shared.value.tree.search(root, vectors, not below):
                        own = batch.take(pa.array(np.unique(rows[reached])))
                        n = own.num_rows
                        made = [pa.array(np.full(n, cell)), pa.array(np.full(n, bool(below))), *own.columns]
                        yield pa.RecordBatch.from_arrays(made, names=["cell", "longer", "word", "n"])

    def linked(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Per word of the cell and of its queries: near words within this cell, and the best of them."""
        names, counts = left["word"].to_pylist(), left["n"].to_numpy()
        held = _latin(left["word"])
        out: list[tuple] = []
        for longer in (False, True):
            asked = right.filter(pa.compute.equal(right["longer"], longer))
            if not asked.num_rows or not held:
                continue
            their_names, their_counts = asked["word"].to_pylist(), asked["n"].to_numpy()
            found = list(pairs_in_cell(held, _latin(asked["word"])))
            if not found:
                continue
            q, p = (np.concatenate(x) for x in zip(*found, strict=True))
            out += _best(q, p, their_names, names, counts)
            if longer:  # words of equal length meet both ways, as points and as queries
                out += _best(p, q, names, their_names, their_counts)
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "form", "form_n"])

    own = words.select("word", "n").mapInArrow(points, kind).groupBy("cell")
    asked = words.select("word", "n").mapInArrow(queries, kind).groupBy("cell")
    parts = own.cogroup(asked).applyInArrow(linked, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    parts = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return parts.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def _best(a: np.ndarray, b: np.ndarray, names: list[str], other_names: list[str], other_n: np.ndarray) -> list[tuple]:
    """For every distinct a: how many b it has, and the one of largest n; ties: the smallest in order."""
    if not len(a):
        return []
    rank = np.empty(len(other_names), dtype=np.int64)
    by_name = sorted(range(len(other_names)), key=other_names.__getitem__)
    rank[by_name] = np.arange(len(by_name))
    order = np.lexsort((rank[b], -other_n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    n = np.diff(np.append(first, len(a)))
    return [
        (names[i], k, other_names[j], int(other_n[j]))
        for i, k, j in zip(a[first].tolist(), n.tolist(), b[first].tolist(), strict=True)
    ]


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """word, root: the last of the forms that follow a word, at most so many; each round doubles the hops."""
    reached, done = forms.select("word", F.col("form").alias("root")), 1
    while done < hops:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        reached, done = stored(step, "roots"), 2 * done
    return reached


def variants(words: DataFrame, cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words and their counts n."""
    words = stored(words, "words")
    near = stored(near_counts(words, grow_cells(words, cell)), "near-words")
    rare = F.col("form_n") >= RATIO * F.col("n")
    kept: list[Column] = [F.when(rare, F.col(c)).alias(c) for c in ("form", "form_n")]
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), *kept)
    found = stored(found, "forms")
    top = words.agg(F.max("n")).first()[0] or 1
    hops = max(1, math.ceil(math.log(top, RATIO)) + 1)  # every hop multiplies n by the ratio at least
    ends = roots(found.where("form IS NOT NULL").select("word", "form"), hops)
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all documents with their forms and roots."""
    return variants(word_counts(docs, doc_id, text))
