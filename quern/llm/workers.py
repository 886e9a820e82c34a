"""What the Arrow functions of this subpackage share: a Python worker that waits for its next task holds little memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Gives freed memory back to the system: Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The function, which releases its memory when its task ends. Reused workers would keep the peak of every task."""

    @wraps(run)
    def ended(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return ended
