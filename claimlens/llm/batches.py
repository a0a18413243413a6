"""Arrow batches in pieces of bounded size, so that what a task holds doesn't follow the length of texts; free column names."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of a piece; a single row may be larger.
ROWS, BYTES = 500, 4 << 20


def free(columns: list[str], name: str) -> str:
    """name, or with as many underscores as it takes for none of the columns to have it (Spark's names have no case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _bytes(column: pa.Array) -> np.ndarray:
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(column.type):
        return 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), 8, np.int64)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, in order, of at most so many rows and bytes (but one row at least); none is empty."""
    for b in batches:
        total = np.cumsum(sum(_bytes(c) for c in b.columns))
        at = 0
        while at < b.num_rows:
            before = int(total[at - 1]) if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(total, before + size, side="right"))))
            yield b.slice(at, end - at)
            at = end


_CACHES: list[dict] = []


def sole(*mine: dict) -> None:
    """Empties what other operators have kept in this Python worker: it goes on through all stages, with all their caches."""
    for c in _CACHES:
        if not any(c is m for m in mine):
            c.clear()
    _CACHES[:] = mine


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy(f: Callable) -> Callable:
    """f of batches for a task; memory that is free at its end goes back to the system, as the worker that holds it lives on."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)

    return run
