"""Pieces of Arrow columns, so that what a Python step holds follows a bounded number of bytes and not the size of its batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of input that a Python step works on at once; a longer row is a piece of its own.
PIECE = 1 << 20


def pieces(columns: list[pa.Array], size: int | None = None) -> Iterator[list[pa.Array]]:
    """Neighbouring rows of columns of one length, in their order, as slices of at most ``size`` bytes or of one row."""
    size = PIECE if size is None else size
    todo = [(0, len(columns[0]))]
    while todo:
        start, n = todo.pop()
        own = [c.slice(start, n) for c in columns]
        if n > 1 and sum(c.nbytes for c in own) > size:
            todo += [(start + n // 2, n - n // 2), (start, n // 2)]
        elif n:
            yield own
