"""Words, word hashes and crc folds shared by the text operators.

All rules here are on UTF-8 bytes and lower-case A-Z only, so they give the same words in
any locale. Arrow buffers are read directly: no Python object is made for a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that are cut into words at once.
PIECE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Lower-cases A-Z and turns every byte that is not 0-9, a-z or part of a non-ASCII letter into a space.
_WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_power = np.ones(1, dtype=np.uint64)
_unpower = np.ones(1, dtype=np.uint64)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def unused(frame: DataFrame, name: str) -> str:
    """A column name like this one that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_fold(key: Column, modulus: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key leaves none."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == fold, F.lit(False))


def alnum_words(text: bytes, piece: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """Lower-cased words of ASCII letters, digits and non-ASCII bytes, some at a time."""
    start = 0
    while start < len(text):
        end = min(len(text), start + piece)
        while end < len(text) and _WORD_TABLE[text[end]] != 32:
            end += 1
        yield text[start:end].translate(_WORD_TABLE).split()
        start = end


def word_spans(text: bytes) -> Iterator[re.Match]:
    """The places of the words that alnum_words() gives."""
    return re.finditer(rb"[^ ]+", text.translate(_WORD_TABLE))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _unpower
    if len(_power) <= n:
        steps = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
        for x in steps:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        _power, _unpower = steps
    return _power, _unpower


def space_words(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words between ASCII white space, and words per text.

    A word's hash is a polynomial in its bytes, mixed with its length. The text is cut
    into pieces at white space or between texts, so memory follows the words, not the bytes.
    """
    n = len(offsets) - 1
    edges = np.unique(offsets)
    hashes, firsts = [], []
    start, size = 0, len(data)
    while start < size:
        end = min(size, start + piece)
        while end < size:
            near = np.flatnonzero(_SPACE[data[end : end + 4096]])
            stop = end + (int(near[0]) if len(near) else 4096)
            k = np.searchsorted(edges, end)
            if k < len(edges) and edges[k] <= stop:
                end = int(edges[k])
                break
            end = min(stop, size)
            if len(near):
                break
        part = _LOWER[data[start:end]]
        blank = _SPACE[part]
        first = ~blank
        first[1:] &= blank[:-1]
        cut = edges[np.searchsorted(edges, start) : np.searchsorted(edges, end)] - start
        first[cut] = ~blank[cut]
        begins = np.flatnonzero(first)
        if len(begins):
            last = ~blank
            last[:-1] &= blank[1:]
            inner = cut[cut > 0] - 1
            last[inner] = ~blank[inner]
            ends = np.flatnonzero(last) + 1
            power, unpower = _powers(len(part))
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
            value = (sums[ends] - sums[begins]) * unpower[begins]
            hashes.append(mixed(value + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            firsts.append(begins + start)
        start = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    at = np.searchsorted(np.concatenate(firsts), offsets)
    return np.concatenate(hashes), np.diff(at)


def text_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about this many bytes; a longer text stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, n)
        start = end
