"""Arrow batches as Python workers read them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

SLICE = 500  # rows of a batch that a Python worker has in hand at once


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what Python makes of them stays small; freed memory goes back."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)
        pa.default_memory_pool().release_unused()
