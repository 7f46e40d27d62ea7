"""What a Python worker keeps between tasks, and what it gives back after each.

Spark uses its Python workers again for later tasks, those of other operators
included, so whatever a worker keeps stays in an executor's memory.  A worker
keeps one heavy thing at a time: a tokenizer or a language model with the
answers that it remembers.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

from . import _text

_HELD: dict[tuple, Any] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """The thing named ``key``, made by a worker once; that of another name is let go before."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


def rest() -> None:
    """Gives memory that a task has used and freed back to the system."""
    _text.forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with a rest at the end of each task; unless it ``keeps`` something held, what others held goes first."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _HELD.clear()
        try:
            yield from run(batches)
        finally:
            rest()

    return whole
