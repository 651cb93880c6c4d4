"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

The distinct space-separated units of a batch that its task has not encoded yet are joined into
one text per block and indexed by a suffix array. Every piece of the vocabulary is looked up by binary search, which gives
all its occurrences; these are the edges of a lattice over byte positions. Edges are sorted by
position and relaxed from left to right, for all units at once.

A BPE model does not maximise a sum of scores, so an edge is relaxed by BPE's own rule: an
encoding is BPE's exactly if every two neighbouring pieces stay apart when merged on their own.
Each position has one last piece whose predecessor allows it, so the path is unique and equals
the result of merging the best-scored pair again and again.

A long unit is relaxed in many lanes side by side, in sections of bounded size. A lane counts only
from where it agrees, over the length of the longest piece, with what is known to be right.

Pieces never hold a space after another character, nor a line end, so units are independent.
The vocabulary (bounded by the model file) is broadcast; its path is a parameter.

Nulls and edges: a null or empty text has no pieces and decodes to an empty text. Characters
without a piece become byte pieces. A literal U+2581 is the same symbol as a space and decodes to
one. A text of any length, with or without spaces, is encoded whole, at some seconds per million
letters. Repeated rows are encoded each. Other columns are passed on.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.text import text_bytes, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of distinct units in one suffix array, of texts handled at once, and of encoded units kept for later texts.
BLOCK_BYTES, SLICE_BYTES, KEPT_BYTES = 1 << 18, 1 << 20, 1 << 21

#: A unit of more bytes is encoded by lanes of so many bytes, each begun so many bytes before.
LONG_BYTES, LANE_BYTES, WARM_BYTES = 1 << 13, 1 << 10, 1 << 8

_UNITS = re.compile(rb"\n| +[^ \n]*|[^ \n]+")
_NONE, _BEGIN, _BYTES = -3, -2, -1  # nothing reached; start of a unit; a character without a piece


def _merged(chars: list[str], order: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """BPE on a short string: the symbols left, and the two that were merged last."""
    parts, last = list(chars), None
    while True:
        best = min(
            ((order[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in order),
            default=None,
        )
        if best is None:
            return parts, last
        i = best[1]
        last = parts[i], parts[i + 1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def read_vocabulary(path: str = MODEL) -> dict[str, np.ndarray]:
    """Tables of a BPE model. Pieces are numbered by rank: characters, then merges by score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual, byte_ids = {}, np.zeros(256, dtype=np.int32)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            usual[piece.replace(SPACE, " ")] = i
    if any(" " in p.lstrip(" ") or "\n" in p for p in usual):
        raise ValueError("pieces with an inner space or a line end: units would not be independent")
    merges = sorted((p for p in usual if len(p) > 1), key=lambda p: -model.get_score(usual[p]))
    order = {p: r for r, p in enumerate(merges)}
    split = {}
    for p in merges:
        left, last = _merged(list(p), order)
        if len(left) == 1 and last:
            split[p] = last
    names = sorted(p for p in usual if len(p) == 1)
    n_chars = len(names)
    names += [p for p in merges if p in split]
    rank = {p: r for r, p in enumerate(names)}
    right, left = np.arange(len(names)), np.arange(len(names))
    pairs = {}
    for p, (a, b) in split.items():
        left[rank[p]], right[rank[p]] = rank[a], rank[b]
        for i in range(1, len(p)):
            if p[:i] in rank and p[i:] in rank:
                pairs[rank[p[:i]] << 20 | rank[p[i:]]] = rank[p]
    keys, values = pair_table(pairs)
    encoded = [p.encode() for p in names]
    all_bytes = [model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(model.get_piece_size())]
    for b, i in enumerate(byte_ids.tolist()):
        all_bytes[i] = bytes([b])
    for i in range(model.get_piece_size()):
        if model.is_control(i):
            all_bytes[i] = b""
    raw, sizes = np.frombuffer(b"".join(encoded), dtype=np.uint8), np.array([len(x) for x in encoded])
    return {
        "ids": np.array([usual[p] for p in names], dtype=np.int32),
        "byte_ids": byte_ids,
        "n_chars": n_chars,
        "left": left,
        "right": right,
        "pair_keys": keys,
        "pair_values": values,
        "bytes": raw,
        "sizes": sizes,
        "prefixes": _prefix_keys(raw, sizes),
        "piece_bytes": np.frombuffer(b"".join(all_bytes), dtype=np.uint8),
        "piece_sizes": np.array([len(x) for x in all_bytes]),
    }


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def pair_table(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A hash table with open addressing, an eighth full at most; empty slots hold -1."""
    bits = max(4, (8 * len(pairs)).bit_length())
    keys, values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
    if pairs:
        for key, at in zip(pairs, _slot(np.array(list(pairs)), bits).tolist(), strict=True):
            while keys[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            keys[at], values[at] = key, pairs[key]
    return keys, values


def _combined(v: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of the piece that a and b merge into; a huge number where there is none."""
    keys, size = v["pair_keys"], len(v["pair_keys"])
    wanted = a << 20 | b
    at = _slot(wanted, size.bit_length() - 1)
    out = np.full(len(a), 1 << 40)
    open_ = np.arange(len(a))
    while len(open_):
        held = keys[at[open_]]
        hit = held == wanted[open_]
        out[open_[hit]] = v["pair_values"][at[open_[hit]]]
        open_ = open_[~hit & (held >= 0)]
        at[open_] = (at[open_] + 1) & (size - 1)
    return out


def stay_apart(v: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether BPE on the two pieces alone gives the two pieces.

    Merges are undone from the last one back; a merge across the border that would have come
    before the one undone (further left first, among equals) joins them.
    """
    left, right, n_chars = v["left"], v["right"], v["n_chars"]
    apart = np.ones(len(a), dtype=bool)
    at, a, b = np.arange(len(a)), a.copy(), b.copy()
    limit = np.full(len(a), 1 << 40)
    while len(at):
        joins = _combined(v, a, b) < limit
        apart[at[joins]] = False
        go = ~joins & (np.maximum(a, b) >= n_chars)
        at, a, b = at[go], a[go], b[go]
        undo_a = a > b
        limit = np.where(undo_a, a, b + 1)
        a, b = np.where(undo_a, right[a], a), np.where(undo_a, b, left[b])
    return apart


def _prefix_keys(raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per piece: its first 16 bytes as two words, low and high ends of the range it spans."""
    start = np.cumsum(size) - size
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    window = padded[start[:, None] + np.arange(16)]
    inside = np.arange(16) < size[:, None]
    low, high = np.where(inside, window, 0).astype(np.uint8), np.where(inside, window, 255).astype(np.uint8)
    words = [np.ascontiguousarray(x).view(">u8").astype(np.uint64) for x in (low, high)]
    return words[0][:, 0], words[0][:, 1], words[1][:, 0], words[1][:, 1]


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places sorted by their next 16 bytes (zeros past the end), and these bytes as two words."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    n = len(data)
    word = np.zeros(n + 8, dtype=np.uint64)
    for i in range(8):
        word |= padded[i : i + n + 8].astype(np.uint64) << np.uint64(56 - 8 * i)
    order = np.lexsort((word[8:], word[:n]))
    return order, word[:n][order], word[8:][order]


def _bound(high: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray, after: bool) -> np.ndarray:
    """Binary search, for all pieces at once, of the first place not below (or above) the key."""
    begin, end = np.zeros(len(a), dtype=np.int64), np.full(len(a), len(high))
    for _ in range(len(high).bit_length()):
        mid = np.minimum((begin + end) // 2, len(high) - 1)
        h, x = high[mid], low[mid]
        below = (h < a) | ((h == a) & ((x <= b) if after else (x < b)))
        live = begin < end
        begin, end = np.where(live & below, mid + 1, begin), np.where(live & ~below, mid, end)
    return begin


def occurrences(v: dict, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and piece ranks of every piece in the text, within the unit that ends at stop[place]."""
    order, high, low = suffix_array(data)
    a, b, c, d = v["prefixes"]
    first, last = _bound(high, low, a, b, False), _bound(high, low, c, d, True)
    n = np.maximum(last - first, 0)
    piece = np.repeat(np.arange(len(n)), n)
    place = order[np.arange(len(piece)) + np.repeat(first - (np.cumsum(n) - n), n)]
    size = v["sizes"]
    keep = place + size[piece] <= stop[place]
    place, piece = place[keep], piece[keep]
    begin = np.cumsum(size) - size
    for k in np.flatnonzero(size[piece] > 16).tolist():  # few: the rest of a long piece
        p, i = piece[k], place[k]
        if (data[i + 16 : i + size[p]] != v["bytes"][begin[p] + 16 : begin[p] + size[p]]).any():
            piece[k] = -1
    return place[piece >= 0], piece[piece >= 0]


def _edges(v: dict, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, piece rank and width of all edges: pieces, and characters without a piece."""
    place, piece = occurrences(v, data, stop)
    width = v["sizes"][piece]
    starts = (data & 0xC0) != 0x80
    starts[place[piece < v["n_chars"]]] = False  # what is left are characters without a piece
    plain = np.flatnonzero(starts)
    bound = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    place = np.concatenate([place, plain])
    piece = np.concatenate([piece, np.full(len(plain), _BYTES)])
    return place, piece, np.concatenate([width, bound[np.searchsorted(bound, plain) + 1] - plain])


def _relaxed(
    v: dict, sizes: np.ndarray, unit: np.ndarray, offset: np.ndarray, piece: np.ndarray, width: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Last piece and its width per node, of edges (unit, offset in it, piece, width), for all units at once.

    A unit has a node before every byte and one after its last.
    """
    begin = np.cumsum(sizes + 1) - sizes - 1
    small = np.uint16 if sizes.max(initial=0) < 1 << 16 else np.int64
    order = np.argsort(offset.astype(small), kind="stable")
    node, piece, width = (begin[unit] + offset)[order], piece[order], width[order]
    steps = np.searchsorted(offset[order], np.arange(sizes.max(initial=0) + 1))
    last = np.full(int(sizes.sum()) + len(sizes), _NONE)
    back = np.zeros(len(last), dtype=np.int64)
    last[begin] = _BEGIN
    for i, j in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
        before = last[node[i:j]]
        good = before != _NONE
        test = np.flatnonzero((before >= 0) & (piece[i:j] >= 0))
        good[test] = stay_apart(v, before[test], piece[i:j][test])
        n, w = node[i:j][good], width[i:j][good]
        last[n + w], back[n + w] = piece[i:j][good], w
    return last, back


def encode_units(v: dict, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units in a row, and how many each has."""
    data = np.frombuffer(b"".join(units), dtype=np.uint8)
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    unit = np.repeat(np.arange(len(units)), sizes)
    place, piece, width = _edges(v, data, (begin + sizes)[unit])
    last, back = _relaxed(v, sizes, unit[place], place - begin[unit[place]], piece, width)

    # from the ends of the units back to their starts
    at = begin + sizes + np.arange(len(units))
    live = np.flatnonzero(sizes)
    out_unit, out_id, turn, out_turn = [], [], 0, []
    while len(live):
        token, w = last[at[live]], back[at[live]]
        whole = token >= 0
        out_unit.append(live[whole])
        out_id.append(v["ids"][token[whole]])
        out_turn.append(np.full(int(whole.sum()), turn))
        for x, k in zip(live[~whole].tolist(), w[~whole].tolist(), strict=True):
            end = at[x] - x
            raw = data[end - k : end][::-1]
            out_unit.append(np.full(k, x))
            out_id.append(v["byte_ids"][raw])
            out_turn.append(turn + np.arange(k))
        at[live] -= w
        turn += 4  # a character has four bytes at most
        live = live[at[live] > begin[live] + live]
    if not out_unit:
        return np.zeros(0, dtype=np.int32), np.zeros(len(units), dtype=np.int64)
    out_unit, out_id, out_turn = map(np.concatenate, (out_unit, out_id, out_turn))
    order = np.lexsort((-out_turn, out_unit))
    return out_id[order].astype(np.int32), np.bincount(out_unit, minlength=len(units))


def _char_start(data: np.ndarray, at: int) -> int:
    """The nearest start of a character at or before a place, or the end."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


class _Long:
    """Encodes one long unit, section by section, each by many lanes at once.

    A lane relaxes its part of the text from some way before it on, as if the text began there.
    What a node holds depends on the nodes within the reach of the longest piece before it
    alone. So if a lane and the exact nodes agree for that reach, the lane is exact from there
    on. Where they do not, the part is relaxed by itself, from the exact nodes on.
    """

    def __init__(self, v: dict, unit: bytes):
        self.v, self.data = v, np.frombuffer(unit, dtype=np.uint8)
        self.reach = max(4, int(v["sizes"].max(initial=4)))
        self.last = np.full(len(unit) + 1, _NONE, dtype=np.int32)
        self.back = np.zeros(len(unit) + 1, dtype=np.int32)
        self.last[0] = _BEGIN
        self.known: dict[tuple[int, int], bool] = {}

    def _apart(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return True
        if (a, b) not in self.known:
            if len(self.known) >= 1 << 20:
                self.known.clear()
            self.known[a, b] = bool(stay_apart(self.v, np.array([a]), np.array([b]))[0])
        return self.known[a, b]

    def _step_by_step(self, start: int, end: int, edges: tuple[np.ndarray, ...]) -> None:
        """The nodes before ``end``, from exact ones for a reach after ``start`` on."""
        place, piece, width = edges
        i, j = np.searchsorted(place, [start, end]).tolist()
        last, back = self.last[start : end + self.reach].tolist(), self.back[start : end + self.reach].tolist()
        for p, x, w in zip((place[i:j] - start).tolist(), piece[i:j].tolist(), width[i:j].tolist(), strict=True):
            if last[p] != _NONE and p + w < len(last) and self._apart(last[p], x):
                last[p + w], back[p + w] = x, w
        n = min(end, len(self.last)) - start
        self.last[start : start + n], self.back[start : start + n] = last[:n], back[:n]

    def _section(self, start: int, end: int) -> None:
        """The nodes up to a reach after ``end``, given those for a reach after ``start``."""
        data, n = self.data, len(self.data)
        first, stop = _char_start(data, max(0, start - WARM_BYTES)), min(n, end + self.reach)
        while stop < n and data[stop] & 0xC0 == 0x80:
            stop += 1
        edges = _edges(self.v, data[first:stop], np.full(stop - first, stop - first))
        order = np.argsort(edges[0], kind="stable")
        place, piece, width = edges[0][order] + first, edges[1][order], edges[2][order]

        parts = np.append(np.arange(start, end, LANE_BYTES), end)
        low = np.array([_char_start(data, max(0, p - WARM_BYTES)) for p in parts[:-1].tolist()])
        high = np.minimum(stop, parts[1:] + self.reach)
        i, j = np.searchsorted(place, low), np.searchsorted(place, high)
        lane = np.repeat(np.arange(len(low)), j - i)
        at = np.arange(len(lane)) + np.repeat(i - (np.cumsum(j - i) - (j - i)), j - i)
        inside = place[at] + width[at] <= high[lane]
        lane, at = lane[inside], at[inside]
        last, back = _relaxed(self.v, high - low, lane, place[at] - low[lane], piece[at], width[at])

        base = np.cumsum(high - low + 1) - (high - low + 1)
        for k, (p, q) in enumerate(zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True)):
            node = int(base[k]) + p - int(low[k])
            size = min(n + 1, q + self.reach) - p
            held, wide = last[node : node + size], back[node : node + size]
            r = min(self.reach, size)
            same = (self.last[p : p + r] == held[:r]).all() and (self.back[p : p + r] == wide[:r]).all()
            if p == 0 or same:
                self.last[p : p + size], self.back[p : p + size] = held, wide
            else:
                self._step_by_step(p, p + size, (place, piece, width))

    def ids(self) -> np.ndarray:
        v, n = self.v, len(self.data)
        for start in range(0, n, BLOCK_BYTES):
            self._section(start, min(n, start + BLOCK_BYTES))
        out, at = [], n
        while at > 0:  # from the end back, some nodes at a time
            low = max(0, at - BLOCK_BYTES)
            last, back = self.last[low : at + 1].tolist(), self.back[low : at + 1].tolist()
            while at > low:
                token, w = last[at - low], back[at - low]
                if token >= 0:
                    out.append(v["ids"][token])
                else:
                    out += v["byte_ids"][self.data[at - w : at][::-1]].tolist()
                at -= w
        return np.array(out[::-1], dtype=np.int32)


class Encoder:
    """Encodes batch after batch; units of earlier batches are kept, up to ``KEPT_BYTES`` of them."""

    def __init__(self, vocabulary: dict):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.size = 0
        self.ids, self.counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def _index(self, units: list[bytes]) -> None:
        """Encode new units block by block, each block through its own suffix array."""
        ids, counts, block, size = [self.ids], [self.counts], [], 0

        def put(part_ids: np.ndarray, part_counts: np.ndarray) -> None:
            ids.append(part_ids)
            counts.append(part_counts)

        for i, unit in enumerate(units):
            long = len(unit) > LONG_BYTES
            if not long:
                block.append(unit)
                size += len(unit)
            if block and (long or size >= BLOCK_BYTES or i == len(units) - 1):
                put(*encode_units(self.vocabulary, block))
                self.size, block, size = self.size + size, [], 0
            if long:
                found = _Long(self.vocabulary, unit).ids()
                put(found, np.array([len(found)]))
                self.size += len(unit)
        self.ids, self.counts = np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if self.size > KEPT_BYTES:
            self._forget()
        number, old = self.number, len(self.number)
        used, per_text = [], []
        for text in texts:
            units = _UNITS.findall(b" " + text.replace(SPACE, " ").encode()) if text else []
            per_text.append(len(units))
            used.append(np.fromiter(map(number.__getitem__, units), dtype=np.int64, count=len(units)))
        if len(number) > old:
            self._index(list(islice(number, old, None)))
        if not sum(per_text):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        used = np.concatenate(used)
        first, n = (np.cumsum(self.counts) - self.counts)[used], self.counts[used]
        total = np.concatenate([[0], np.cumsum(n)])
        taken = self.ids[np.arange(total[-1]) + np.repeat(first - total[:-1], n)]
        edges = np.concatenate([[0], np.cumsum(per_text)])
        return taken, np.diff(total[edges])


def encode_texts(v: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each has."""
    return Encoder(v).encode(texts)


def decode_ids(v: dict, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """Texts: bytes of the pieces in a row, without the leading space that encoding adds."""
    n = v["piece_sizes"][ids]
    first = (np.cumsum(v["piece_sizes"]) - v["piece_sizes"])[ids]
    total = np.concatenate([[0], np.cumsum(n)])
    raw = v["piece_bytes"][np.arange(total[-1]) + np.repeat(first - total[:-1], n)].tobytes()
    edges = total[np.concatenate([[0], np.cumsum(counts)])].tolist()
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out.append(raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace"))
    return out


def _with_columns(docs: DataFrame, source: str, made: dict[str, str], begin, make) -> DataFrame:
    """All columns and those made of ``source`` (name to type), batch by batch, with the state that a task begins with."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = begin()
        for batch in batches:
            for part, *new in make(state, batch):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *new], names=[*inner, *outer])

    inner, outer = [f"c{i}" for i in range(len(columns))], [f"made{i}" for i in range(len(made))]
    renamed = docs.select(F.col(source).alias("source"), *(F.col(c).alias(i) for c, i in zip(columns, inner, strict=True)))
    kinds = [f"{i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(columns, inner, strict=True)]
    kinds += [f"{i} {kind}" for i, kind in zip(outer, made.values(), strict=True)]
    names = zip([*inner, *outer], [*columns, *made], strict=True)
    return renamed.mapInArrow(run, ", ".join(kinds)).select(*(F.col(i).alias(c) for i, c in names))


def _id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))


def _encoded_slices(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    _, offsets = text_bytes(batch.column(0))
    for a, b in text_slices(offsets, SLICE_BYTES):
        part = batch.slice(a, b - a)
        yield part, *encoder.encode(part.column(0).to_pylist())


def encoded(docs: DataFrame, vocabulary: dict, text: str = "text", name: str = "ids") -> DataFrame:
    """All columns, and the ids of the text's pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for part, ids, counts in _encoded_slices(encoder, batch):
            yield part, _id_lists(ids, counts)

    return _with_columns(docs, text, {name: "array<int>"}, lambda: Encoder(shared.value), make)


def decoded(docs: DataFrame, vocabulary: dict, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns, and the text of the ids; null ids are no text."""
    # of the tables, those that decoding reads
    shared = docs.sparkSession.sparkContext.broadcast({k: vocabulary[k] for k in ("piece_bytes", "piece_sizes")})

    def make(tables: dict, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            column = part.column(0).fill_null([]) if part.column(0).null_count else part.column(0)
            values = column.flatten().to_numpy()
            counts = np.diff(column.offsets.to_numpy())
            yield part, pa.array(decode_ids(tables, values, counts), pa.string())

    return _with_columns(docs, ids, {name: "string"}, lambda: shared.value, make)


def round_trip(docs: DataFrame, vocabulary: dict, text: str = "text", names: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """All columns, the ids of the text's pieces and the text of these ids: encoded() and decoded() in one task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array]]:
        for part, ids, counts in _encoded_slices(encoder, batch):
            yield part, _id_lists(ids, counts), pa.array(decode_ids(shared.value, ids, counts), pa.string())

    return _with_columns(docs, text, dict(zip(names, ("array<int>", "string"), strict=True)), lambda: Encoder(shared.value), make)
