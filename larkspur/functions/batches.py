"""Slices of Arrow batches of bounded size, so that a kernel holds few texts at once however long they are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: int, size: int = 2_000_000, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch in order, each of at most `rows` rows and, but for a single longer text, `size` bytes of the text column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = 0
    while at < len(lengths):
        to, total = at + 1, lengths[at]
        while to < len(lengths) and to - at < rows and total + lengths[to] <= size:
            total += lengths[to]
            to += 1
        yield batch.slice(at, to - at)
        at = to
