"""Byte-level BPE encoding and decoding with segment trees over byte positions.

A text is cut into matches of the tokenizer's pattern, and each match is encoded by itself. Every
match that a task has not met yet gets a segment tree whose leaves are its byte positions. A leaf
holds the rank of the pair of tokens that starts there, with its place in the low bits, so that the
root is the leftmost pair of least rank. A merge sets three leaves, that of the merged pair, of
the token that ended and of the live neighbour on the left, and repairs the paths above them.
Trees of one size take their steps together as numpy columns; a match above ``WIDEST`` bytes has a
tree of its own, whose paths are repaired only as far up as they change.

As in tiktoken, a match that is a token as a whole is that token, whatever its merges would give,
and characters are of the classes that tiktoken knows.
The ranks (bounded by the vocabulary file) are broadcast; the file's path is a parameter.

Nulls and edges: a null or empty text has no tokens and decodes to no bytes. Strings of special
tokens are plain text. A match of any length is encoded whole, in time about n log n (a text of
1,000,000 letters without a space takes seconds). Repeated rows are encoded each. No rows give no
rows. Other columns are passed on; one that has the name of a made column is replaced.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from orderlens.llm.batches import int_lists, ragged, slices, with_made
from orderlens.llm.pieces import _slot, pair_table

#: Bytes of the longest match that shares its steps with others; trees that do so at a time.
WIDEST, TREES = 256, 1 << 13
#: Matches, and bytes of matches, whose tokens a task keeps for later texts.
KEPT_MATCHES, KEPT_BYTES = 1 << 19, 1 << 23
#: Characters of the longest text whose matches are listed at once, and matches listed at a time beyond.
LISTED_CHARS, LISTED = 1 << 20, 100_000

_NO_TOKEN = (1 << 20) - 1
_NO_PAIR = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are also their ids, of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def substitutes() -> dict[int, str]:
    """Characters that tiktoken and the regex library class differently, and one that stands for each.

    The two follow different versions of Unicode: what is a letter in the newer one can be
    unassigned in the older. tiktoken itself is asked, once, about every character.
    """
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    out: dict[int, str] = {}
    for kind, usual in ((r"\p{L}", "Z"), (r"\p{N}", "0")):
        known = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs, ours = set(bytes(known.encode_ordinary(chars)).decode()), set(regex.findall(kind, chars))
        out |= {ord(c): "\uffff" for c in ours - theirs if ord(c) not in out} | {ord(c): usual for c in theirs - ours}
    return out


def tables(ranks: dict[bytes, int], pattern: str) -> dict:
    """What encoding and decoding look up, as arrays."""
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte without a token: texts could not be encoded whole")
    if max(ranks.values()) >= _NO_TOKEN:
        raise ValueError("token ids of 20 bits at most are supported")
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs[left << 20 | right] = rank
    keys, values = pair_table(pairs)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    sizes = np.array([len(token) for token in by_id])
    return {
        "pattern": pattern,
        "substitutes": substitutes(),
        "ranks": ranks,
        "byte_ids": np.array([ranks[bytes([b])] for b in range(256)]),
        "pair_keys": keys,
        "pair_values": values,
        "token_bytes": np.frombuffer(b"".join(by_id), dtype=np.uint8),
        "token_sizes": sizes,
        "token_starts": np.cumsum(sizes) - sizes,
    }


def pair_ranks(t: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of the token that two tokens merge into; ``_NO_PAIR`` where there is none."""
    keys, mask = t["pair_keys"], len(t["pair_keys"]) - 1
    wanted = a << 20 | b
    at = _slot(wanted, mask.bit_length())
    held = keys[at]
    out = np.where(held == wanted, t["pair_values"][at], _NO_PAIR)
    open_ = np.flatnonzero((held != wanted) & (held >= 0))
    while len(open_):
        at[open_] = (at[open_] + 1) & mask
        held = keys[at[open_]]
        hit = held == wanted[open_]
        out[open_[hit]] = t["pair_values"][at[open_[hit]]]
        open_ = open_[~hit & (held >= 0)]
    return out


def merge_together(t: dict, matches: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of matches of at most ``width`` (a power of two) bytes, and how many each has."""
    n, bits = len(matches), width.bit_length() - 1
    sizes = np.fromiter(map(len, matches), dtype=np.int64, count=n)
    token = np.full((n, width + 1), _NO_TOKEN)  # the last column stands for "no neighbour"
    place = np.arange(width)
    inside = place < sizes[:, None]
    token[:, :width][inside] = t["byte_ids"][np.frombuffer(b"".join(matches), dtype=np.uint8)]
    after = np.tile(np.arange(1, width + 2), (n, 1))
    after[:, :width][place + 1 >= sizes[:, None]] = width
    before = np.tile(np.concatenate([[width], np.arange(width)]), (n, 1))
    tree = np.full((n, 2 * width), _NO_PAIR)
    ranks = pair_ranks(t, token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width)
    tree[:, width:] = np.where(ranks < _NO_PAIR, ranks << bits | place, _NO_PAIR)
    for level in range(bits - 1, -1, -1):
        a, b = 1 << level, 2 << level
        tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])
    flat, tokens, nexts, previous = tree.ravel(), token.ravel(), after.ravel(), before.ravel()
    rows = np.flatnonzero(tree[:, 1] < _NO_PAIR)
    while len(rows):
        top, row, base = tree[rows, 1], rows * (width + 1), rows * (2 * width)
        at, merged = top & (width - 1), top >> bits
        right = nexts[row + at]
        far, left = nexts[row + right], previous[row + at]
        tokens[row + at], tokens[row + right] = merged, _NO_TOKEN
        nexts[row + at], previous[row + far] = far, at
        new = pair_ranks(t, np.concatenate([merged, tokens[row + left]]), np.concatenate([tokens[row + far], merged]))
        m = len(rows)
        leaf = np.where(new < _NO_PAIR, new << bits | np.concatenate([at, left]), _NO_PAIR)
        # node 0 is no part of the tree: it takes what "no neighbour" would get
        node = np.concatenate([width + at, np.where(left < width, width + left, 0), width + right])
        bases = np.tile(base, 3)
        flat[bases + node] = np.concatenate([leaf, np.full(m, _NO_PAIR)])
        for _ in range(bits):
            node >>= 1
            child = bases + 2 * node
            flat[bases + node] = np.minimum(flat[child], flat[child + 1])
        rows = rows[tree[rows, 1] < _NO_PAIR]
    live = token[:, :width] != _NO_TOKEN
    return token[:, :width][live], live.sum(axis=1)


def merge_alone(t: dict, match: bytes) -> np.ndarray:
    """Tokens of one match of any length."""
    n = len(match)
    bits = max(1, (n - 1).bit_length())
    width, pairs = 1 << bits, t.setdefault("pairs", {})
    if not pairs:
        used = t["pair_keys"] >= 0
        pairs.update(zip(t["pair_keys"][used].tolist(), t["pair_values"][used].tolist(), strict=True))
    start = t["byte_ids"][np.frombuffer(match, dtype=np.uint8)]
    ranks = pair_ranks(t, start[:-1], start[1:])
    levels = [np.full(width, _NO_PAIR)]
    levels[0][: n - 1] = np.where(ranks < _NO_PAIR, ranks << bits | np.arange(n - 1), _NO_PAIR)
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = array("q", np.concatenate([[_NO_PAIR], *levels[::-1]]).tobytes())
    token = array("q", np.concatenate([start, [_NO_TOKEN]]).tobytes())
    after, before = array("q", range(1, n + 2)), array("q", range(-1, n))

    def put(leaf: int, value: int) -> None:
        node = width + leaf
        tree[node] = value
        while node > 1:
            least = min(tree[node], tree[node ^ 1])
            node >>= 1
            if tree[node] == least:
                return
            tree[node] = least

    def pair(i: int, a: int, b: int) -> int:
        rank = pairs.get(a << 20 | b)
        return _NO_PAIR if rank is None else rank << bits | i

    while tree[1] < _NO_PAIR:
        at, merged = tree[1] & (width - 1), tree[1] >> bits
        right, left = after[at], before[at]
        far = after[right]
        token[at], token[right] = merged, _NO_TOKEN
        after[at], before[far] = far, at
        put(right, _NO_PAIR)
        put(at, pair(at, merged, token[far]))
        if left >= 0:
            put(left, pair(left, token[left], merged))
    done = np.frombuffer(token, dtype=np.int64)
    return done[done != _NO_TOKEN].copy()


def encode_matches(t: dict, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all matches in a row, and how many each has."""
    counts = np.zeros(len(matches), dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # matches and their ids, in a row
    by_width = defaultdict(list)
    whole, whole_ids, ranks = [], [], t["ranks"]
    for i, match in enumerate(matches):
        known = ranks.get(match)
        if known is not None:
            whole.append(i)
            whole_ids.append(known)
        elif len(match) <= WIDEST:
            by_width[1 << (len(match) - 1).bit_length()].append(i)
        else:
            ids = merge_alone(t, match)
            counts[i] = len(ids)
            done.append((np.array([i]), ids))
    counts[whole] = 1
    done.append((np.array(whole, dtype=np.int64), np.array(whole_ids, dtype=np.int64)))
    for width, members in by_width.items():
        for a in range(0, len(members), TREES):
            part = np.array(members[a : a + TREES])
            ids, n = merge_together(t, [matches[i] for i in part.tolist()], width)
            counts[part] = n
            done.append((part, ids))
    out = np.empty(int(counts.sum()), dtype=np.int32)
    first = np.cumsum(counts) - counts
    for members, ids in done:
        out[ragged(first[members], counts[members])] = ids
    return out, counts


def _runs(numbers: Iterable[int]) -> list[tuple[int, int]]:
    """First and last of every run of consecutive numbers."""
    at = np.array(sorted(numbers))
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True))


class Encoder:
    """Encodes batch after batch; tokens of matches met before are kept, up to a bound."""

    def __init__(self, t: dict):
        self.tables = dict(t)
        self.find = regex.compile(t["pattern"])
        # re has a bitmap for such a class
        self.odd = re.compile("[%s]" % "".join(f"{chr(a)}-{chr(b)}" for a, b in _runs(t["substitutes"]))) if t["substitutes"] else None
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.size = 0
        self.ids, self.counts, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _matches(self, text: str) -> Iterator[list[str]]:
        odd = self.odd is not None and not text.isascii() and self.odd.search(text)
        if not odd and len(text) <= LISTED_CHARS:
            yield self.find.findall(text)
            return
        found = (text[m.start() : m.end()] for m in self.find.finditer(text.translate(self.tables["substitutes"]) if odd else text))
        while part := list(islice(found, LISTED)):
            yield part

    def _add(self, matches: list[bytes]) -> None:
        ids, counts = encode_matches(self.tables, matches)
        self.size += sum(map(len, matches))
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        self.starts = np.cumsum(self.counts) - self.counts

    def _numbers(self, text: str) -> np.ndarray:
        parts = [
            np.fromiter(map(self.number.__getitem__, part), dtype=np.int64, count=len(part)) for part in self._matches(text)
        ]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if len(self.number) > KEPT_MATCHES or self.size > KEPT_BYTES:
            self._forget()
        old = len(self.number)
        used = [self._numbers(text or "") for text in texts]
        if len(self.number) > old:
            self._add([m.encode() for m in islice(self.number, old, None)])
        edges = np.concatenate([[0], np.cumsum([len(x) for x in used])]).astype(np.int64)
        used = np.concatenate(used) if used else np.zeros(0, dtype=np.int64)
        n = self.counts[used]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.ids[ragged(self.starts[used], n)], np.diff(total[edges])


def decode(t: dict, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The bytes of every text's ids."""
    sizes = t["token_sizes"][ids]
    raw = t["token_bytes"][ragged(t["token_starts"][ids], sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
    if ends[-1] >= 1 << 31:
        raise ValueError("2 GB of bytes or more in one batch")
    return pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())]
    )


def encoded(docs: DataFrame, t: dict, text: str = "text", name: str = "ids") -> DataFrame:
    """All columns, and the ids of the text's tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(t)

    def make(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[tuple]:
        for part in slices(batch):
            yield part, int_lists(*encoder.encode(part.column(0).to_pylist()))

    return with_made(docs, text, {name: "array<int>"}, lambda: Encoder(shared.value), make)


def decoded(docs: DataFrame, t: dict, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns, and the bytes of the ids; null ids are no bytes."""
    shared = docs.sparkSession.sparkContext.broadcast({k: v for k, v in t.items() if k.startswith("token_")})

    def make(used: dict, batch: pa.RecordBatch) -> Iterator[tuple]:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            column = part.column(0).fill_null([]) if part.column(0).null_count else part.column(0)
            yield part, decode(used, column.flatten().to_numpy(), np.diff(column.offsets.to_numpy()))

    return with_made(docs, ids, {name: "binary"}, lambda: shared.value, make)


def round_trip(docs: DataFrame, t: dict, text: str = "text", names: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """All columns, the ids of the text's tokens and the bytes of these ids: both in one task."""
    shared = docs.sparkSession.sparkContext.broadcast(t)

    def make(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[tuple]:
        for part in slices(batch):
            ids, counts = encoder.encode(part.column(0).to_pylist())
            yield part, int_lists(ids, counts), decode(shared.value, ids, counts)

    return with_made(docs, text, dict(zip(names, ("array<int>", "binary"), strict=True)), lambda: Encoder(shared.value), make)
