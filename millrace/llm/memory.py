"""What a Python worker holds: slices of batches, nothing from other operators, and memory given back after a task.

Spark uses a worker again for the tasks of other operators, so what one leaves there counts beside the next one's.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa

#: The cache that tasks of the last operator with one left in this process.
_left: list = []


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    """The C library's way to give free memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def give_back() -> None:
    """Return what Arrow and the C library hold without need."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def sliced(batches: Iterator[pa.Array], rows: int) -> Iterator[pa.Array]:
    """Every batch in slices of at most ``rows``; results yielded slice by slice are never held for a whole batch."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def lean(run: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], cache=None) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """``run`` as an Arrow UDF of iterators. The task begins by clearing what another operator's cache (an
    ``lru_cache``) holds in the process, leaves its own ``cache`` for the next task, and gives the rest back."""

    def task(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if _left and _left[0] is not cache:
            _left.pop().cache_clear()
        if cache is not None:
            _left[:] = [cache]
        try:
            yield from run(batches)
        finally:
            give_back()

    task.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return task
