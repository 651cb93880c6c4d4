"""Alignment of two tokenizers over exact distinct texts.

Rows are shuffled by their full text, equal texts become one row with a multiplicity, and each
distinct text is encoded by both tokenizers and aligned once. Tokens of A and B are byte ranges of
the same bytes; where both end, a group ends, and every stretch between two neighbouring ends of
either is one link, as just one token of A and one of B hold it.

A task aligns its texts in slices of some megabytes. It stores per text its measures and its linked
id pairs, and per slice the pairs that occur in it, weighted by the multiplicity of their texts.
Pair counts of the whole corpus are sums over the slices' rows, with map-side reduction; each
slice then gets back the counts of its own pairs. So nothing of the corpus is broadcast, and a
group is a slice, or the pairs of one B id, of which there are as many as A has ids at most.
Last, the measures are joined to the doc_ids by the text's SHA-256.

Within a task texts are cut at spaces into units that both tokenizers encode by themselves, and a
unit that occurs again is not encoded again.

The tokenizer files (bounded) are broadcast; their paths are parameters.

Nulls and edges: a null or empty text, or one whose tokens of A or B do not join to a space and
the text, has no tokens, no groups and no links: zeros, and an empty digest. Strings of special
tokens are plain text. Rows repeat: each gets the measures of its text, and its links count each
time. A null doc_id stays null. A text of any length is one row and is aligned whole. No rows
give no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.batches import int_lists, ragged, slices
from orderlens.llm.storage import stored

#: Bytes of text whose pair counts are looked up together, and of texts that are encoded together.
SLICE_BYTES, BATCH_BYTES = 1 << 25, 1 << 18
#: Units, and characters of units, that a task keeps for later texts.
KEPT_UNITS, KEPT_BYTES = 1 << 19, 1 << 23

#: Where texts are cut: before a space between two characters that are no white space in any version of Unicode.
_CUT = re.compile("(?<=[!-~À-ɏ])(?= [!-~À-ɏ])")

MEASURES = ("n_a", "n_b", "n_groups", "n_links")
_ROW = "slice bigint, digest binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, counts array<bigint>"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_tokenizers(a_path: str, b_path: str) -> dict:
    """A: a byte-level BPE file of the tokenizers library; B: a SentencePiece model; and the bytes of their tokens."""
    import sentencepiece
    import tokenizers

    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        files = {"a": a.read(), "b": b.read()}
    byte_of = _byte_letters()
    names = tokenizers.Tokenizer.from_str(files["a"]).get_vocab(with_added_tokens=False)
    a_bytes = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        a_bytes[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
    model = sentencepiece.SentencePieceProcessor(model_proto=files["b"])
    if any(" " in model.id_to_piece(i).replace("▁", " ").lstrip(" ") for i in range(model.get_piece_size())):
        raise ValueError("pieces with an inner space: units would not be independent")
    b_bytes = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return files | {"a_tokens": _flat(a_bytes), "b_tokens": _flat(b_bytes)}


def _flat(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all items in a row, where each starts, and its size."""
    sizes = np.array([len(x) for x in items], dtype=np.int64)
    return np.frombuffer(b"".join(items), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def _spans(offsets: np.ndarray) -> zip:
    return zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


class Aligner:
    """Both tokenizers, and the alignment of their tokens."""

    def __init__(self, shared: dict):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(shared["a"])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=shared["b"])
        self.tokens = shared["a_tokens"], shared["b_tokens"]
        self.n_b = len(shared["b_tokens"][1])
        self.decimals = _flat([str(i).encode() for i in range(max(len(t[1]) for t in self.tokens))])

    def _encoded(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Ids of all texts in a row and how many each has, for A and B; those whose bytes they miss have none, and are marked."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        whole = [b" " + x.encode() for x in texts]
        ends, good, out = _offsets(np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))), np.ones(len(texts), dtype=bool), []
        for lists, (data, starts, sizes) in zip((a, b), self.tokens, strict=True):
            counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            ids = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(counts.sum()))
            joined = data[ragged(starts[ids], sizes[ids])].tobytes()
            edges = _offsets(sizes[ids])[_offsets(counts)]
            if not np.array_equal(edges, ends) or joined != b"".join(whole):
                good &= [joined[i:j] == x for x, (i, j) in zip(whole, _spans(edges), strict=True)]
            out.append((ids, counts))
        return [(ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in out], good

    def align(self, texts: list[str]) -> dict:
        """Of all texts in a row: token ids, ends of groups and links, and how many each text has."""
        ((a, n_a), (b, n_b)), good = self._encoded(texts)
        ends_a, ends_b = np.cumsum(self.tokens[0][2][a]), np.cumsum(self.tokens[1][2][b])
        total = int(ends_a[-1]) if len(ends_a) else 0
        at_a, at_b = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
        at_a[ends_a], at_b[ends_b] = True, True
        common, either = np.flatnonzero(at_a & at_b), np.flatnonzero(at_a | at_b)
        text_ends = np.concatenate([[0], ends_a])[_offsets(n_a)[1:]]
        link_a, link_b = np.searchsorted(ends_a, either), np.searchsorted(ends_b, either)
        per_text = lambda ends: np.diff(np.searchsorted(ends, np.append(0, text_ends), "right"))
        return {
            "a": a, "b": b, "n_a": n_a, "n_b": n_b, "n_groups": per_text(common), "n_links": per_text(either),
            "a_before": np.searchsorted(ends_a, common, "right"), "b_before": np.searchsorted(ends_b, common, "right"),
            "pairs": a[link_a] * self.n_b + b[link_b], "good": good,
        }

    def group_texts(self, x: dict) -> list[bytes]:
        """Every text's groups in decimal ids, as in ``1,2|3;4|5``."""
        data, starts, sizes = self.decimals
        n_groups = len(x["a_before"])
        a_in, b_in = np.diff(x["a_before"], prepend=0), np.diff(x["b_before"], prepend=0)
        group_a, group_b = np.repeat(np.arange(n_groups), a_in), np.repeat(np.arange(n_groups), b_in)
        order_a = np.arange(len(x["a"])) + (x["b_before"] - b_in)[group_a]
        order_b = np.arange(len(x["b"])) + x["a_before"][group_b]
        ids, stops = np.empty(len(x["a"]) + len(x["b"]), dtype=np.int64), np.full(len(x["a"]) + len(x["b"]), ord(","), dtype=np.uint8)
        ids[order_a], ids[order_b] = x["a"], x["b"]
        last = x["a_before"] + x["b_before"] - 1  # the last B of a group
        stops[last], stops[last - b_in] = ord(";"), ord("|")
        size = sizes[ids] + 1
        out = np.empty(int(size.sum()), dtype=np.uint8)
        at = np.cumsum(size) - size
        out[ragged(at, size - 1)] = data[ragged(starts[ids], size - 1)]
        out[at + size - 1] = stops
        raw, edges = out.tobytes(), _offsets(size)[_offsets(x["n_a"] + x["n_b"])]
        return [raw[i : max(i, j - 1)] for i, j in _spans(edges)]


class Units:
    """Measures of texts out of their units, each aligned once; those met before are kept, up to a bound.

    A unit ends before a space between two characters of ``_CUT``: A's pattern always begins a match
    there, and no piece of B holds a space behind another character, so both encode units by themselves.
    """

    def __init__(self, shared: dict):
        self.aligner = Aligner(shared)
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.size = 0
        self.counts, self.good = np.zeros((0, len(MEASURES)), dtype=np.int64), np.zeros(0, dtype=bool)
        self.pairs, self.starts, self.groups = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []

    def _add(self, units: list[str]) -> None:
        counts, good, pairs, start = [self.counts], [self.good], [self.pairs], 0
        while start < len(units):
            size, end = 0, start
            while end < len(units) and (end == start or size + len(units[end]) <= BATCH_BYTES):
                size, end = size + len(units[end]), end + 1
            x = self.aligner.align([u[1:] for u in units[start:end]])
            counts.append(np.stack([x[c] for c in MEASURES], axis=1))
            good.append(x["good"])
            pairs.append(x["pairs"])
            self.groups += self.aligner.group_texts(x)
            self.size, start = self.size + size, end
        self.counts, self.good, self.pairs = np.concatenate(counts), np.concatenate(good), np.concatenate(pairs)
        self.starts = np.cumsum(self.counts[:, -1]) - self.counts[:, -1]

    def measured(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Per text its measures; the pairs of all texts in a row; and the digest of its groups."""
        if len(self.number) > KEPT_UNITS or self.size > KEPT_BYTES:
            self._forget()
        old = len(self.number)
        used = []
        for text in texts:
            units = _CUT.split(" " + text)
            used.append(np.fromiter(map(self.number.__getitem__, units), dtype=np.int64, count=len(units)))
        if len(self.number) > old:
            self._add(list(islice(self.number, old, None)))
        # a text with a unit whose bytes a tokenizer misses has no tokens
        used = [u if self.good[u].all() else u[:0] for u in used]
        digests = [hashlib.sha256(b";".join([self.groups[i] for i in u.tolist()])).hexdigest() if len(u) else "" for u in used]
        edges = _offsets(np.array([len(u) for u in used], dtype=np.int64))
        flat = np.concatenate(used)
        sums = np.concatenate([np.zeros((1, len(MEASURES)), dtype=np.int64), np.cumsum(self.counts[flat], axis=0)])
        return np.diff(sums[edges], axis=0), self.pairs[ragged(self.starts[flat], self.counts[flat, -1])], digests


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def aligned(docs: DataFrame, shared_tables: dict, text: str = "text") -> DataFrame:
    """Per distinct text: digest, measures, pairs (a id * number of B ids + b id) and how often each occurs.

    Rows without digest hold the pairs of a whole slice, weighted by multiplicity.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shared_tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(shared.value)
        number, size = TaskContext.get().partitionId() << 32, 0
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        names = ["slice", "digest", *MEASURES, "groups_sha256", "pairs", "counts"]

        def total() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip(*sums, strict=True)))

        def whole_slice() -> pa.RecordBatch:
            pairs, n = total()
            empty = [pa.nulls(1, pa.binary()), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string())]
            columns = [pa.array([number]), *empty, int_lists(pairs, [len(pairs)]), int_lists(n, [len(n)])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for part in slices(batch, BATCH_BYTES):
                texts, copies = part.column(0).to_pylist(), part.column(1).to_numpy()
                found, pairs, groups = units.measured(texts)
                row = np.repeat(np.arange(len(texts)), found[:, -1])
                keys, n = np.unique(row << 40 | pairs, return_counts=True)
                row, pairs = keys >> 40, keys & ((1 << 40) - 1)
                sums.append(_summed(pairs, n * copies[row]))
                if len(sums) == 16:
                    sums[:] = [total()]
                held = np.bincount(row, minlength=len(texts))
                made = [pa.array(np.ascontiguousarray(column)) for column in found.T]
                digests = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
                columns = [pa.array(np.full(len(texts), number)), digests, *made, pa.array(groups, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, int_lists(pairs, held), int_lists(n.astype(np.int64), held)], names=names)
                size += sum(map(len, texts))
                if size >= SLICE_BYTES:
                    yield whole_slice()
                    number, size = number + 1, 0
                    sums.clear()
        if sums:
            yield whole_slice()

    texts = docs.where(F.col(text) != "").groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    return texts.mapInArrow(run, _ROW)


def pair_counts(slice_pairs: DataFrame, n_b: int) -> DataFrame:
    """pair, n (links that hold it in the corpus), best (no pair of its B id has more)."""
    totals = slice_pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair") % n_b)
    return totals.withColumn("best", F.col("n") == F.max("n").over(of_b))


def _with_counts(key: tuple, texts: pa.Table, counted: pa.Table) -> pa.Table:
    """Measures of a slice's texts, whose pairs all have a row in ``counted``."""
    pair = counted["pair"].to_numpy()
    order = np.argsort(pair)
    pair, n, best = pair[order], counted["n"].to_numpy()[order], counted["best"].to_numpy()[order]
    n_best, sums = [], []
    for batch in texts.to_batches(max_chunksize=512):
        pairs, counts = batch.column("pairs"), batch.column("counts")
        times = counts.flatten().to_numpy()
        at = np.searchsorted(pair, pairs.flatten().to_numpy())
        edges = pairs.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        for values, out in ((times * best[at], n_best), (times * n[at], sums)):
            out.append(np.diff(np.concatenate([[0], np.cumsum(values)])[edges]))
    made = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (n_best, sums)]
    kept = texts.select(["digest", *MEASURES, "groups_sha256"])
    return kept.append_column("n_best", made[0]).append_column("count_sum", made[1])


def measures(docs: DataFrame, shared_tables: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row per row of docs."""
    rows = stored(aligned(docs, shared_tables, text), "aligned", compression="zstd")
    whole = rows.where("digest IS NULL").select(F.col("slice").alias("slice"), F.inline(F.arrays_zip("pairs", "counts")).alias("pair", "n"))
    counted = pair_counts(whole, len(shared_tables["b_tokens"][1]))
    back = whole.select("slice", "pair").join(counted, "pair").select("slice", "pair", "n", "best")
    texts = rows.where("digest IS NOT NULL").groupBy("slice").cogroup(back.groupBy("slice"))
    numbers = (*MEASURES, "n_best", "count_sum")
    schema = "digest binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    found = texts.applyInArrow(_with_counts, schema)
    keys = docs.select(F.col(doc_id).alias("doc_id"), _digest(text).alias("digest"))
    return keys.join(found, "digest", "left").select(
        "doc_id",
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
