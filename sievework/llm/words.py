"""Words of a text: A-Z lower-cased, everything of ASCII but letters and digits separates. Memory of Python workers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte table: A-Z lower-cased; 0x00-0x2F, 0x3A-0x60 (after lower-casing) and 0x7B-0x7F become spaces.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256)
)
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def slices(batches: Iterator[pa.RecordBatch], at: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, of at most ``rows`` rows and ``size`` bytes of column ``at``; one row at least."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(upto, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def release() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(clear: Callable[[], object] | None = None) -> Callable:
    """Decorator of what runs over a partition's batches: in the end caches are emptied and memory is released.

    Python workers outlive their tasks, and the next task may run in another of them, so what one keeps adds up.
    ``clear`` must be a function of a module: methods of a module's objects would reach workers as copies.
    """

    def wrap(run: Callable) -> Callable:
        @functools.wraps(run)
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from run(batches)
            finally:
                if clear:
                    clear()
                release()

        return whole

    return wrap
