"""Words of a block of texts as numbers: 64-bit hashes by numpy over the block's UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of text that are worked on at a time, whatever the size of an Arrow batch or of a text.
BLOCK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread each number over 64 bits, one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, stop) of runs of texts: one text at least, and not more than ``most`` bytes if there are two."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += int(n)
    if first < len(sizes):
        yield first, len(sizes)


def in_blocks(batches: Iterator[pa.Array], work, kind: pa.DataType) -> Iterator[pa.Array]:
    """``work`` (a list of texts to a list of values) over Arrow arrays of texts.

    One block is in memory as Python strings, and its values leave the worker
    before the next is read: they may be as large as the texts.
    """
    for batch in batches:
        for first, stop in blocks(batch):
            yield pa.array(work(batch.slice(first, stop - first).to_pylist()), kind)
        pa.default_memory_pool().release_unused()


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _hashed(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes: a polynomial modulo 2^64 from running sums, and the length."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(flat)), out=sums[1:])
    back = _powers(pow(_BASE, -1, 1 << 64), len(flat))[starts]
    return mixed((sums[ends] - sums[starts]) * back + mixed((ends - starts).astype(np.uint64)))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words begin (one entry more than texts).

    Words are runs of ASCII letters and digits and of all that is not ASCII;
    A-Z counts as a-z. A hash depends on its word only.
    """
    coded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b" ".join(coded) + b" ", dtype=np.uint8)
    flat = flat + ((flat >= 65) & (flat <= 90)).astype(np.uint8) * np.uint8(32)
    in_word = (flat >= 128) | ((flat >= 97) & (flat <= 122)) | ((flat >= 48) & (flat <= 57))
    edges = np.flatnonzero(np.diff(in_word.astype(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    hashes, first = [np.zeros(0, dtype=np.uint64)], 0
    while first < len(starts):
        # A long text in pieces of whole words.
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK_BYTES, side="right")))
        lo, hi = starts[first], ends[last - 1]
        hashes.append(_hashed(flat[lo:hi], starts[first:last] - lo, ends[first:last] - lo))
        first = last
    lengths = np.fromiter((len(c) + 1 for c in coded), dtype=np.int64, count=len(coded))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return np.concatenate(hashes), np.searchsorted(starts, bounds)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, those over the end of a text too."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total *= np.uint64(_BASE)
        total += words[k : k + n]
    return mixed(total + np.uint64(size))


def mapped_blocks(
    df: DataFrame, text_col: str, work: Callable[[pa.RecordBatch], list[pa.Array]], added: dict[str, str], keep: list[str] | None = None,
    **given: Column,
) -> DataFrame:
    """``row`` (a struct of the columns ``keep``, all by default) beside the columns ``added`` (name: type) that ``work`` makes.

    ``work`` sees ``text`` and the columns ``given``, one block of texts at a
    time, and each block's result leaves the worker before the next is made.
    """
    row = F.struct("*") if keep is None else F.struct(*[F.col(f"`{c}`") for c in keep])
    base = df.select(row.alias("row"), F.col(text_col).alias("text"), *[c.alias(n) for n, c in given.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop in blocks(batch.column("text")):
                block = batch.slice(first, stop - first)
                yield pa.RecordBatch.from_arrays([block.column("row"), *work(block)], names=["row", *added])
            pa.default_memory_pool().release_unused()

    schema = T.StructType([base.schema["row"]])
    for name, kind in added.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return base.mapInArrow(run, schema)
