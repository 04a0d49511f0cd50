"""Arrow arrays a few rows at a time: what Python holds depends neither on the rows of a batch nor on its largest texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text, or words, that are Python objects at a time; a single row may have more.
TEXT_BYTES, WORDS = 1 << 20, 1 << 16


def pieces(array: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, stop) of runs of rows, of texts or of lists of words: one row at least, not more than ``most`` if there are two."""
    lists = pa.types.is_list(array.type) or pa.types.is_large_list(array.type)
    most = most or (WORDS if lists else TEXT_BYTES)
    sizes = pc.fill_null((pc.list_value_length if lists else pc.binary_length)(array), 0).to_numpy(zero_copy_only=False)
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += int(n)
    if first < len(sizes):
        yield first, len(sizes)


def in_pieces(batches: Iterator, work: Callable[..., pa.Array]) -> Iterator[pa.Array]:
    """``work`` over the pieces of each batch (an array, or several of which the first decides); each result leaves the
    worker before the next piece is read."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for first, stop in pieces(columns[0]):
            yield work(*(c.slice(first, stop - first) for c in columns))
        pa.default_memory_pool().release_unused()
