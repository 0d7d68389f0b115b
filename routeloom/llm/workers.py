"""What a Python worker leaves behind: workers are reused, and idle ones should hold little memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def _trim() -> None:
    """Give freed memory of the C allocator back to the system, where there is such a call."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


_settled = False


def _settle() -> None:
    """Once in a worker: what its modules hold is left out of later collections, which else walk it after every task."""
    global _settled
    if not _settled:
        gc.collect()
        gc.freeze()
        _settled = True


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that frees what its pass has used when the pass ends."""

    @wraps(run)
    def inner(batches: Iterator) -> Iterator:
        _settle()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            _trim()

    return inner
