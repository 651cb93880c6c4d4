"""Columns made batch by batch from one source column, and ragged rows in flat arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.text import text_bytes, text_slices

#: Bytes of text that a task handles at once; a longer text stands alone.
SLICE_BYTES = 1 << 20


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all items of the runs that begin at ``starts``, run after run."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def int_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about this many bytes in their first column, which is text."""
    _, offsets = text_bytes(batch.column(0))
    for a, b in text_slices(offsets, most):
        yield batch.slice(a, b - a)


def with_made(
    docs: DataFrame,
    source: str,
    made: dict[str, str],
    begin: Callable[[], object],
    make: Callable[[object, pa.RecordBatch], Iterator[tuple]],
) -> DataFrame:
    """All columns and the made ones (name to type); a column that has the name of a made one is replaced.

    ``begin`` gives a task its state; ``make`` turns the state and a batch, whose first column
    is the source, into parts of the batch with their new columns.
    """
    taken = {c.lower() for c in made}
    columns = [c for c in docs.columns if c.lower() not in taken]
    inner, outer = [f"c{i}" for i in range(len(columns))], [f"made{i}" for i in range(len(made))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = begin()
        for batch in batches:
            for part, *new in make(state, batch):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *new], names=[*inner, *outer])

    kept = [F.col(f"`{c}`").alias(i) for c, i in zip(columns, inner, strict=True)]
    kinds = [f"{i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(columns, inner, strict=True)]
    kinds += [f"{i} {kind}" for i, kind in zip(outer, made.values(), strict=True)]
    rows = docs.select(F.col(f"`{source}`").alias("source"), *kept).mapInArrow(run, ", ".join(kinds))
    names = zip([*inner, *outer], [*columns, *made], strict=True)
    return rows.select(*(F.col(i).alias(c) for i, c in names))
