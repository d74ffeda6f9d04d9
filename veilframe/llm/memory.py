"""Gives memory back between tasks.

Python workers are used for many tasks and stages, two or more beside one JVM.
What a task has freed stays with its worker unless it is handed back, so the
largest moment of every stage would add up.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def release_memory() -> None:
    """Hand freed memory back to the machine, as far as the platform can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of ``mapInArrow`` or ``mapInPandas`` that hands back memory at the end of its task, and at its begin what others left."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        release_memory()
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def lean_group(run: Callable) -> Callable:
    """The same for a function of ``applyInPandas``, of one group."""

    def wrapped(rows):
        try:
            return run(rows)
        finally:
            release_memory()

    return wrapped
