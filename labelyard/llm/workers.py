"""What tasks in Python workers need: shared state and slices of bounded size."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()`` once per process and ``key``; the last value of each name (``key[0]``) is kept.

    Functions reach the workers by value, so a module of this library keeps nothing there.
    """
    store = sys.modules.setdefault("_labelyard_worker", ModuleType("_labelyard_worker"))
    kept = getattr(store, key[0], None)
    if kept is None or kept[0] != key:
        setattr(store, key[0], kept := (key, make()))
    return kept[1]


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most about ``most`` bytes of text, as (start, count)."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(size // most)) + 1, [len(texts)]])
    yield from ((int(a), int(b - a)) for a, b in zip(bounds[:-1], bounds[1:]) if b > a)


def batches_of_texts(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text, or one longer text."""
    for start, n in slices(batch.column(column), most):
        yield batch.slice(start, n)
