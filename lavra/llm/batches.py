"""Arrow batches cut into pieces of bounded size, so that a Python worker holds few texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose `column` holds at most `most` bytes, or one row where that alone is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts of a piece; null reads as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Whole texts of a piece as UTF-8; null reads as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
