"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

1. A document's shingle set gives a signature of ``SYMBOLS`` minima of 16 bits each. Equal
   sets are one class, told by two 64-bit sums over the set; its smallest doc_id stands for it.
2. Signatures that differ in at most ``RADIUS`` symbols are candidates. The signature is
   split into ``CHUNKS`` chunks; by the pigeonhole principle, with RADIUS = CHUNKS * s + t,
   one of the first t + 1 chunks has at most s errors or one of the others at most s - 1. The
   allowed errors are enumerated by leaving out that many symbols of a chunk; every pair within
   the radius thus shares an index key. Keys of one class only are dropped.
3. In each key's rows (split into blocks where there are many) signatures are compared. Only
   the pairs that join two groups are put out, so rows out follow rows in, not pairs.
4. The groups so found are compared on full shingle sets, block by block of a group; again
   only links that join two parts are put out. Their components are the answer.

A pair at similarity 0.85 exceeds 23 differing symbols of 60 with probability 2.3e-6, one at 0.80
exceeds 26 with 1.1e-5, a closer pair far more rarely; such a link is still found if other pairs
bring both into one group, as step 4 asks nothing of signatures.

Nulls and edges: a null or empty text has an empty set and links with nothing; one of fewer words
than a shingle has its whole sequence as its set. Rows under one doc_id are one document, linked
by any of them. A row without doc_id is not linked: its component is null and it is kept.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.components import components
from orderlens.llm.storage import stored
from orderlens.llm.text import mixed, space_words, text_bytes, text_slices

SHINGLE = 5
#: Links by default: at least this many hundredths of the union of two sets are in both.
PERCENT = 85
SYMBOLS, CHUNKS, RADIUS = 60, 12, 23
#: Rows of one key, and documents or shingles of one group, that a task compares at once.
BLOCK_ROWS, BLOCK_DOCS, BLOCK_SHINGLES = 512, 256, 1 << 19
SLICE_BYTES = 4 << 20

_rng = np.random.default_rng(20240607)
_FACTORS = _rng.integers(0, 1 << 64, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_MASKS = _rng.integers(0, 1 << 64, SYMBOLS, dtype=np.uint64)
_MULTIPLY, _SECOND = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit shingle hashes."""
    words, counts = space_words(*text_bytes(column))
    ends = np.cumsum(counts)
    starts = ends - counts
    grams = np.full(max(0, len(words) - size + 1), np.uint64(size), dtype=np.uint64)
    for i in range(size):
        grams = grams * _MULTIPLY + words[i : len(words) - size + 1 + i]
    grams = mixed(grams)
    out = []
    for start, n in zip(starts.tolist(), counts.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(grams[start : start + n - size + 1]))
        elif n:
            value = np.full(1, n, dtype=np.uint64)
            for word in words[start : start + n]:
                value = value * _MULTIPLY + word
            out.append(mixed(value))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit symbols per set; all zero for an empty one."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), SYMBOLS), dtype=np.uint16)
    if full:
        values = np.concatenate([sets[i] for i in full])
        sizes = np.array([len(sets[i]) for i in full])
        first = np.cumsum(sizes) - sizes
        for k in range(SYMBOLS):
            least = np.minimum.reduceat((values ^ _MASKS[k]) * _FACTORS[k], first)
            out[full, k] = mixed(least) & np.uint64(0xFFFF)
    return out


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (set size), f1 and f2 (sums that tell the set) and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for a, b in text_slices(offsets, SLICE_BYTES):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column(1))
                sums = [
                    np.array([mixed(s ^ salt).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                    for salt in (np.uint64(0), _SECOND)
                ]
                signed = signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.array([row.tobytes() for row in signed], pa.binary()),
                    ],
                    names=["doc_id", "n", "f1", "f2", "signature"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n bigint, f1 bigint, f2 bigint, signature binary"
    )


def key_plan(symbols: int = SYMBOLS, chunks: int = CHUNKS, radius: int = RADIUS) -> list[np.ndarray]:
    """The symbols that make up each index key: every chunk, without each allowed set of errors."""
    errors, more = divmod(radius, chunks)
    plan = []
    for i, chunk in enumerate(np.array_split(np.arange(symbols), chunks)):
        allowed = errors if i <= more else errors - 1
        if allowed >= 0:
            plan += [np.setdiff1d(chunk, left) for left in combinations(chunk.tolist(), allowed)]
    return plan


def index_keys(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, id) for every class and every entry of the key plan."""
    plan = key_plan(radius=radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16)
            signed = signed.reshape(-1, SYMBOLS).astype(np.uint64)
            for i, used in enumerate(plan):
                value = np.full(len(signed), np.uint64(i + 1))
                for k in used:
                    value = mixed(value * _MULTIPLY + signed[:, k])
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(0)], names=["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, f"key bigint, id {classes.schema['id'].dataType.simpleString()}")


def in_blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Each row once per pair of blocks it is in, so that any two rows of a key meet; bounded groups."""
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    return rows.select(key, F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "*")


class Groups:
    """Joins of local rows by id; says which pairs still join two groups."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.row = np.unique(ids, return_inverse=True)
        self.root = np.arange(len(self.ids))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def flat(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return up[self.row]
            self.root = up

    def join(self, a: int, b: int) -> bool:
        x, y = self.find(self.row[a]), self.find(self.row[b])
        self.root[max(x, y)] = min(x, y)
        return x != y


def _runs(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[pa.Table]:
    """Sorted rows in tables that hold all rows of each group they have (the first columns)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = np.ones(batch.num_rows, dtype=bool)
        for c in batch.columns[:n_key]:
            value = c.to_numpy(zero_copy_only=False)
            last &= value == value[-1]
        n = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if n:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, n)])
            held = [batch.slice(n)]
    if held:
        yield pa.Table.from_batches(held)


def _same_run(table: pa.Table, n_key: int) -> np.ndarray:
    """A number per row that tells its group."""
    change = np.zeros(table.num_rows, dtype=bool)
    for c in table.columns[:n_key]:
        value = c.to_numpy()
        change[1:] |= value[1:] != value[:-1]
    return np.cumsum(change)


def _close(n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])


def near_pairs(rows: DataFrame, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """Pairs within the radius that join two groups, of rows (key, b1, b2, id, n, signature)."""
    names = ["key", "b1", "b2", "id", "n", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            group, n = _same_run(table, 3), table["n"].to_numpy()
            ids = table["id"].to_numpy()
            signed = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
            groups, found = Groups(ids), []
            for step in range(1, int(np.bincount(group).max())):
                flat = groups.flat()
                a = np.flatnonzero((group[:-step] == group[step:]) & (flat[:-step] != flat[step:]))
                a = a[_close(n, a, a + step, percent)]
                for i in range(0, len(a), 1 << 16):
                    part = a[i : i + (1 << 16)]
                    part = part[(signed[part] != signed[part + step]).sum(axis=1) <= radius]
                    found += [(x, x + step) for x in part.tolist() if groups.join(x, x + step)]
            if found:
                at = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])

    kind = rows.schema["id"].dataType.simpleString()
    sorted_rows = rows.select(*names).repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2", "id")
    return sorted_rows.mapInArrow(run, f"a {kind}, b {kind}")


def confirmed_links(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links on full sets that join two parts, of rows (component, b1, b2, id, shingles)."""
    names = ["component", "b1", "b2", "id", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            group = _same_run(table, 3)
            ids = table["id"].to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table["shingles"].to_pylist()]
            n = np.array([len(s) for s in sets])
            groups, found = Groups(ids), []
            for step in range(1, int(np.bincount(group).max())):
                flat = groups.flat()
                a = np.flatnonzero((group[:-step] == group[step:]) & (flat[:-step] != flat[step:]))
                a = a[_close(n, a, a + step, percent)]
                for x in a.tolist():
                    both = len(np.intersect1d(sets[x], sets[x + step], assume_unique=True))
                    if 100 * both >= percent * (n[x] + n[x + step] - both) and groups.join(x, x + step):
                        found.append((x, x + step))
            if found:
                at = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])

    kind = rows.schema["id"].dataType.simpleString()
    sorted_rows = rows.select(*names).repartition("component", "b1", "b2").sortWithinPartitions("component", "b1", "b2", "id")
    return sorted_rows.mapInArrow(run, f"a {kind}, b {kind}")


def with_sets(docs: DataFrame) -> DataFrame:
    """The shingle sets of (component, blocks, id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(3))
            for a, b in text_slices(offsets, SLICE_BYTES):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column(3))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["component", "blocks", "id", "shingles"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("component", "blocks", "id", "text").mapInArrow(
        run, f"component {kind}, blocks bigint, id {kind}, shingles binary"
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, radius: int = RADIUS
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept.

    Sets link from ``percent`` hundredths of similarity on; a lower one needs a larger ``radius``.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketches = stored(sketched(docs), "sketches")
    classes = (
        sketches.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("f1", "f2", "n")
        .agg(F.min("doc_id").alias("id"), F.any_value("signature").alias("signature"))
    )
    classes = stored(classes, "set-classes")
    # a set of so few shingles can reach the similarity only with its equal
    keys = stored(index_keys(classes.where(F.col("n") * 100 >= percent * (F.col("n") + 1)), radius), "index-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("least"), F.max("id").alias("most"))
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks")
    shared = stored(shared.where("least <> most").select("key", blocks), "shared-keys")
    rows = keys.join(shared, "key").join(classes.select("id", "n", "signature"), "id")
    candidates = components(near_pairs(in_blocks(rows, "key", "blocks"), percent, radius))

    candidates = stored(candidates, "candidate-groups")
    sizes = candidates.join(classes.select("id", "n"), "id").groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    blocks = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("n") / BLOCK_SHINGLES)).alias("blocks")
    sizes = stored(sizes.select("component", blocks), "candidate-sizes")
    members = stored(candidates.join(sizes, "component"), "candidate-members")
    texts = docs.withColumnRenamed("doc_id", "id").join(members, "id")
    sets = in_blocks(stored(with_sets(texts), "candidate-sets"), "component", "blocks")
    links = components(confirmed_links(sets, percent))

    named = classes.join(links, "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component"))
    named = stored(named, "class-components")
    found = sketches.join(named, ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
