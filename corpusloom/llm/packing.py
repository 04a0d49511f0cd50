"""Best-fit packing of documents into training sequences of several permitted lengths.

A document longer than the largest length is cut into pieces; nothing is left
out. Pieces go, longest first, each into the open bin with the least room that
holds it. Where none does, a bin opens. All permitted lengths compete for it:
each is filled in thought with the piece and, greedily, with the longest of the
shorter pieces still to come that fit, by the histogram of their lengths; the
length whose contents would cost least for each token wins. The cost of a
sequence has a fixed part, a linear part and a quadratic one, as attention has,
and counts for the permitted length the contents would need in the end. So a
piece that would leave half of the smallest fitting length empty opens a larger
one where others can share it. At the end every bin is cut down to the smallest
permitted length that holds its contents.

Pieces are dealt by hash into shards of about ``shard_pieces``; a shard is
packed in one task, whose memory depends on that number only. Each shard
wastes less than a bin or two, so the number of shards hardly costs space.
Texts never move: only ids, places and lengths are shuffled.

Defined results: a length is the number of UTF-8 bytes and one end mark, or the
column ``length_col`` plus nothing; null and empty texts are one piece of the
end mark; a null or negative length counts as 0, and such a document is a piece
of no tokens; rows alike in id and text are packed once each; ties in length go
by id (nulls last), text hash and piece. Ids keep their type and value.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed

CAPACITIES = (1024, 2048, 4096, 8192)
SHARD_PIECES = 1 << 16
PLACED = "th long, piece int, start long, n int, bin_id long, bin_offset int, bin_fill int, capacity int"


def bin_cost(capacity: int, fixed: float = 64, quadratic: float = 1 / 16384) -> float:
    return fixed + capacity + quadratic * capacity * capacity


class ToCome:
    """The lengths still to come, and how often, in order."""

    def __init__(self, lengths: Sequence[int]):
        values, counts = np.unique(np.array(lengths, dtype=np.int64), return_counts=True)
        self.values, self.counts = values.tolist(), counts.tolist()

    def taken(self, length: int) -> None:
        """The longest is packed."""
        assert self.values[-1] == length
        self.counts[-1] -= 1
        if not self.counts[-1]:
            self.values.pop()
            self.counts.pop()

    def fill(self, room: int) -> int:
        """What the longest ones that fit, one after the other, make of a room."""
        filled, at = 0, len(self.values)
        while room > filled:
            at = bisect_left(self.values, room - filled + 1, 0, at) - 1
            if at < 0 or not self.values[at]:
                break
            filled += self.values[at] * min(self.counts[at], (room - filled) // self.values[at])
        return filled


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost=bin_cost):
    """Bins of pieces that come longest first: per piece (bin, offset), and per bin its final capacity."""
    sizes = sorted(capacities)
    costs = [cost(c) for c in sizes]
    to_come = ToCome(lengths)
    rooms: list[tuple[int, int]] = []  # (room, bin), in order
    fills: list[int] = []
    places = []
    for n in lengths:
        to_come.taken(n)
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            least = bisect_left(sizes, n)
            expected = [n + to_come.fill(size - n) for size in sizes[least:]]
            per_token = [costs[bisect_left(sizes, fill)] / max(1, fill) for fill in expected]
            room, number = sizes[least + per_token.index(min(per_token))], len(fills)
            fills.append(0)
        places.append((number, fills[number]))
        fills[number] += n
        if room > n:
            insort(rooms, (room - n, number))
    return places, [sizes[bisect_left(sizes, fill)] for fill in fills]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str | None = None,
    capacities: Sequence[int] = CAPACITIES,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row per piece: ``id_col, text_hash, piece, start, n_tokens, bin_id, bin_offset, bin_fill, capacity``."""
    largest = max(capacities)
    sizes = tuple(capacities)
    base = keyed(docs, id_col, text_col)
    length = (
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
        if length_col is None
        else F.greatest(F.coalesce(F.col("row").getField(length_col).cast("long"), F.lit(0)), F.lit(0))
    )
    measured = base.select("id", "th", length.alias("length"))
    last = F.greatest(F.ceil(F.col("length") / F.lit(largest)).cast("int"), F.lit(1))
    pieces = measured.select("id", "th", "length", F.explode(F.sequence(F.lit(0), last - 1)).alias("piece"))
    start = F.col("piece").cast("long") * largest
    pieces = pieces.select(
        "id", "th", "piece", start.alias("start"), F.least(F.col("length") - start, F.lit(largest)).cast("int").alias("n")
    )
    total = measured.agg(F.sum(last)).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "th", "piece"), F.lit(shards)).cast("int"))

    schema = T.StructType([base.schema["id"], *T.DataType.fromDDL(PLACED).fields])

    def pack_shard(key: tuple, rows: pa.Table) -> pa.Table:
        # In Arrow throughout: an id never becomes a float beside a null.
        rows = rows.sort_by([("n", "descending"), ("id", "ascending"), ("th", "ascending"), ("piece", "ascending")])
        lengths = rows.column("n").to_numpy()
        places, kept = best_fit(lengths.tolist(), sizes)
        bins, offsets = np.array(places, dtype=np.int64).reshape(-1, 2).T
        fills = np.bincount(bins, weights=lengths, minlength=len(kept)).astype(np.int32)
        new = [(key[0].as_py() << 32) + bins, offsets.astype(np.int32), fills[bins], np.array(kept, dtype=np.int32)[bins]]
        columns = [*(rows.column(c) for c in ("id", "th", "piece", "start", "n")), *map(pa.array, new)]
        return pa.Table.from_arrays(columns, names=schema.names)

    placed = dealt.groupBy("shard").applyInArrow(pack_shard, schema)
    return placed.select(
        F.col("id").alias(id_col), F.col("th").alias("text_hash"), "piece", "start", F.col("n").alias("n_tokens"),
        "bin_id", "bin_offset", "bin_fill", "capacity",
    )
