"""Exact top-k search by inner product over a bit-sliced index.

Components become integers. The index holds blocks of rows, and for each
component of a block one bitmap per bit of its value (less the block's least
value of that component), without the lowest ``dropped`` bits. A query's score
over all rows of a block is a sum of such slices, shifted by the digits of the
query's components: it is formed by bitmap arithmetic, three slices of one
weight into one of that weight and one of the next, until each weight has one.
The top rows are then selected from the most significant slice downward. The
dropped bits bound the error, so every row that may still be among the best is
a boundary row, and boundary rows are resolved with their exact integers.

The queries, a stated set, meet all rows in blocks: both sides are cut into
blocks, a block of rows lies in one slot, and every block of queries is copied
to all slots, so the shuffle carries the rows once and the queries as often as
there are slots. A task holds one pair of blocks at a time; it yields at most
k rows for a query and block, and ranks are formed from these.

Defined results: components are floor(scale * x), x as double; vectors null or
with null or non-finite components take no part, nor do those with a component
whose product with the scale is beyond the doubles (1e307, say); a vector is a candidate for
queries of its own length only; equal scores go to the smaller id; rows of an id that occurs more than once are all candidates, but never
for a query of that id; queries alike in id and vector are one. Rows with a
null id take no part. Scores beyond a long are cut to its range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

BLOCK_ROWS = 1 << 14
QUERY_ROWS = 1 << 9
DROPPED_BITS = 2
# Sums of products below this are exact in 64 bits; larger components go through Python's integers.
SAFE = 1 << 62


def add_up(slices: dict[int, list[np.ndarray]]) -> list[np.ndarray | None]:
    """The sum of bitmaps, each of a weight: one bitmap per weight, from weight 0 on."""
    out: list[np.ndarray | None] = []
    weight, top = 0, max(slices, default=-1)
    while weight <= top:
        held = slices.get(weight)
        if held:
            stack = np.concatenate(held)
            while len(stack) > 1:
                carries = slices.setdefault(weight + 1, [])
                if len(stack) == 2:
                    carries.append((stack[:1] & stack[1:]))
                    stack = stack[:1] ^ stack[1:]
                else:
                    n = len(stack) // 3
                    a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                    half = a ^ b
                    carries.append((a & b) | (c & half))
                    stack = np.concatenate([half ^ c, stack[3 * n :]])
                top = max(top, weight + 1)
            out.append(stack[0])
        else:
            out.append(None)
        weight += 1
    return out


def digits(n: int) -> list[tuple[int, int]]:
    """(place, +1 or -1) of a number's binary digits with as few as possible that are not 0."""
    found, place = [], 0
    while n:
        if n & 1:
            d = 2 - (n & 3)
            found.append((place, d))
            n -= d
        n >>= 1
        place += 1
    return found


class SlicedBlock:
    """Rows of integers with bitmaps per component and bit."""

    def __init__(self, rows: np.ndarray, dropped: int = DROPPED_BITS):
        self.rows, self.dropped = rows, dropped
        self.count, self.dims = rows.shape
        # Beyond 32 bits there are no slices: all rows are boundary rows.
        self.sliced = rows.dtype != np.float64
        if not self.sliced:
            return
        self.least = rows.min(axis=0) if self.count else np.zeros(self.dims, dtype=np.int64)
        self.words = -(-self.count // 64)
        raised = (rows - self.least).astype(np.uint64)
        # Kept bits of each component; a component that is the same in all rows has none.
        self.bits = [max(0, int(m).bit_length() - dropped) for m in (raised.max(axis=0) if self.count else [])]
        self.slices = []
        for d in range(self.dims):
            column = raised[:, d] >> np.uint64(dropped)
            bitmaps = np.zeros((self.bits[d], self.words * 64), dtype=np.uint8)
            for b in range(self.bits[d]):
                bitmaps[b, : self.count] = (column >> np.uint64(b)) & np.uint64(1)
            self.slices.append(np.packbits(bitmaps, axis=1, bitorder="little").view(np.uint64))
        full = np.zeros(self.words * 64, dtype=np.uint8)
        full[: self.count] = 1
        self.all = np.packbits(full, bitorder="little").view(np.uint64)

    def positions(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.count])

    def score_slices(self, query: list[int]) -> tuple[list[np.ndarray | None], int]:
        """Slices of the score from the kept bits, less a constant; and how much the dropped bits may add or take."""
        sums: dict[int, list[np.ndarray]] = {}
        for d, q in enumerate(query):
            if not self.bits[d]:
                continue
            for place, sign in digits(q):
                # Taking a number away is adding its complement, up to a constant.
                part = self.slices[d] if sign > 0 else ~self.slices[d]
                for b in range(self.bits[d]):
                    sums.setdefault(place + b, []).append(part[b : b + 1])
        unknown = (1 << self.dropped) - 1
        return add_up(sums), unknown * sum(abs(q) for q in query)

    def candidates(self, query: list[int], k: int, leave_out: np.ndarray | None = None) -> np.ndarray:
        """Positions of all rows that may be among the best k by the exact score."""
        among = self.all if leave_out is None else self.all & ~leave_out
        if self.count <= 64 or int(np.bitwise_count(among).sum()) <= k:
            return self.positions(among)
        slices, slack = self.score_slices(query)
        # The k-th best kept score, from the most significant slice downward.
        tied, above, kth = among, np.zeros_like(among), 0
        for s in reversed(slices):
            kth <<= 1
            if s is None:
                continue
            ones = tied & s
            more = above | ones
            if int(np.bitwise_count(more).sum()) >= k:
                tied, kth = ones, kth | 1
            else:
                above, tied = more, tied & ~s
        # Rows of at least that score less the slack, which counts in units of the kept bits.
        floor = kth - (-(-slack // (1 << self.dropped)))
        if floor <= 0:
            return self.positions(among)
        greater, equal = np.zeros_like(among), among
        for place in range(len(slices) - 1, -1, -1):
            s = slices[place]
            if floor >> place & 1:
                equal = equal & s if s is not None else np.zeros_like(equal)
            elif s is not None:
                greater = greater | (equal & s)
                equal = equal & ~s
        if floor >> len(slices):
            return np.zeros(0, dtype=np.int64)
        return self.positions(greater | equal)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products, cut to the range of a long."""
    largest = int(np.abs(rows).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(1, rows.shape[1])
    if largest < SAFE:
        return rows.astype(np.int64) @ query.astype(np.int64)
    limit = (1 << 63) - 1
    totals = (sum(int(a) * int(b) for a, b in zip(row, query)) for row in rows)
    return np.array([max(-limit - 1, min(limit, t)) for t in totals], dtype=np.int64)


def best_of_block(block: SlicedBlock, ids: np.ndarray, query: np.ndarray, query_id: int, k: int):
    """(ids, scores) of the best k rows of a block whose rows are in order of id, without those of the query's id."""
    first, stop = np.searchsorted(ids, query_id, "left"), np.searchsorted(ids, query_id, "right")
    if block.sliced and query.dtype != np.float64:
        own = None
        if stop > first:
            mask = np.zeros(block.words * 64, dtype=np.uint8)
            mask[first:stop] = 1
            own = np.packbits(mask, bitorder="little").view(np.uint64)
        at = block.candidates(query.tolist(), k, own)
    else:
        at = np.concatenate([np.arange(first), np.arange(stop, block.count)])
    scores = exact_scores(block.rows[at], query)
    # Places are in order of id, so ties go to the smaller one.
    best = np.lexsort((at, -scores.astype(object) if scores.min(initial=0) == -(1 << 63) else -scores))[:k]
    return ids[at[best]], scores[best]


PACKED = "dims int, n int, ids binary, cells binary, wide boolean"
PACKED_SCHEMA = pa.schema(
    [("dims", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary()), ("wide", pa.bool_())]
)


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of at most ``most`` rows (``id``, ``cells`` array<double> of whole numbers) of one length, in order of id."""

    def emit(dims: int, ids: list[np.ndarray], cells: list[np.ndarray]) -> pa.RecordBatch:
        i, c = np.concatenate(ids), np.concatenate(cells)
        order = np.argsort(i, kind="stable")
        wide = bool(np.abs(c).max(initial=0) >= 1 << 31)
        c = c[order].astype("<f8" if wide else "<i4")
        values = [[dims], [len(i)], [i[order].astype("<i8").tobytes()], [c.tobytes()], [wide]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, PACKED_SCHEMA)], schema=PACKED_SCHEMA)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, int]] = {}
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            lists = batch.column("cells")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(offsets)
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                cells = flat[offsets[at][:, None] + np.arange(dims)]
                for first in range(0, len(at), most):
                    some = slice(first, first + most)
                    i, c, n = held.get(dims, ([], [], 0))
                    i.append(ids[at[some]])
                    c.append(cells[some])
                    held[dims] = (i, c, n + len(i[-1]))
                    if held[dims][2] >= most:
                        yield emit(dims, *held.pop(dims)[:2])
        for dims, (i, c, _) in held.items():
            yield emit(dims, i, c)

    return rows.select("id", "cells").mapInArrow(work, PACKED)


def _blocks(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The blocks, written to the shared folder, and their number; rows are dealt evenly before."""
    parts = max(1, -(-rows.count() // most))
    packed = cut_lineage(_packed(rows.repartition(parts, F.hash("id", "cells")), most))
    return packed, packed.count()


def _usable(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, cells`` of the rows that take part; whole numbers, still as doubles, which hold them all."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: x * scale)
    # Numbers of 2^52 and more have no fraction, and floor() would return them as a long.
    cells = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return df.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), cells.alias("cells")
    )


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
) -> DataFrame:
    """``query_id, rank, id_col, score``: the ``k`` rows of ``vectors`` with the highest scores for each row of ``queries``."""
    index, slots = _blocks(_usable(vectors, id_col, vector_col, scale), BLOCK_ROWS)
    asked, _ = _blocks(_usable(queries, id_col, vector_col, scale).distinct(), QUERY_ROWS)
    slots = max(1, slots)
    lying = index.withColumn("slot", F.pmod(F.hash("ids"), F.lit(slots)))
    copied = asked.select(
        F.col("dims"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.col("wide").alias("q_wide"),
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
    )
    pairs = lying.join(copied, ["slot", "dims"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None)
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: E731, B023
                dims, ids = get("dims"), np.frombuffer(get("ids"), dtype="<i8")
                cells = get("cells")
                if kept[0] != cells:
                    table = np.frombuffer(cells, dtype="<f8" if get("wide") else "<i4").reshape(len(ids), dims)
                    kept = (cells, SlicedBlock(table if get("wide") else table.astype(np.int64)))
                q_ids = np.frombuffer(get("q_ids"), dtype="<i8")
                q_cells = np.frombuffer(get("q_cells"), dtype="<f8" if get("q_wide") else "<i4").reshape(len(q_ids), dims)
                out: list[list] = [[], [], [], []]
                for query_id, query in zip(q_ids, q_cells):
                    found, scores = best_of_block(kept[1], ids, query, query_id, k)
                    out[0] += [query_id] * len(found)
                    out[1] += [zlib.crc32(query.tobytes())] * len(found)
                    out[2] += found.tolist()
                    out[3] += scores.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["query_id", "q", "id", "score"])

    met = pairs.select("dims", "ids", "cells", "wide", "q_ids", "q_cells", "q_wide").mapInArrow(
        work, "query_id long, q long, id long, score long"
    )
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
