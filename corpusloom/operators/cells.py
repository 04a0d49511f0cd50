"""Vectors stored by cell, and exact nearest neighbours that leave most cells unread.

Directions are dealt to the nearest of some centres; of each cell its centre and
its radius, the greatest angle between the centre and a row, are kept. Angles
obey the triangle inequality: no row of a cell is nearer to a query than the
angle to the centre less the radius. So a query first looks into the cells
around it that hold ``k`` rows; with the ``k``-th score found there it needs
only such other cells whose bound reaches that score. The result is the one a
scan of all rows gives.

Queries are a table like the rows: they meet the rows of a cell in blocks, and
are never collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import MERGE_PARTS, SCORE_DIGITS, _best, _directions, _ids, _matrix, _neighbour_table

CELLS = 256
SAMPLE = 1 << 14  # rows that the centres are found from
ROUNDS = 12
# Rows of a cell, and queries, that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 1 << 14, 1 << 11
# Angles are taken from rounded numbers: a bound gives way by so much.
SLACK = 1e-5


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Directions in the middle of parts of the sample: some rounds of averages."""
    distinct = np.unique(sample, axis=0)
    picked = np.random.default_rng(1).permutation(len(distinct))[:cells]
    centres = distinct[np.sort(picked)]
    for _ in range(ROUNDS):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        moved = _directions(sums)
        centres = np.where(moved.any(axis=1, keepdims=True), moved, centres)
    return centres


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _row_schema(id_type: str) -> str:
    return f"id {id_type}, v array<double>, cell int, angle double"


class VectorCells:
    """Vectors of a table, in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        meta = spark.read.parquet(f"{self.path}/cells").orderBy("cell").toArrow()
        self.id_type = spark.read.parquet(f"{self.path}/kind").first()["kind"]
        self.numbers, self.rows = meta.column("cell").to_pylist(), meta.column("n").to_numpy()
        #: the cells that the last call of ``nearest`` has read rows of
        self.cells_read: set[int] = set()
        self.centres, self.radius = _matrix(meta.column("centre")), meta.column("radius").to_numpy()

    @classmethod
    def build(cls, table: DataFrame, id_col: str, vec_col: str, path: str, cells: int = CELLS, sample: int = SAMPLE) -> VectorCells:
        """Store ``id_col`` and the direction of ``vec_col``; rows without a direction, or with a null id, stay out.

        The centres come from a sample of at most ``sample`` rows. They only
        decide how many cells a query needs, not what it finds.
        """
        spark, path = table.sparkSession, path.rstrip("/")
        vector = F.col(f"`{vec_col}`").cast("array<double>")
        rows = table.select(F.col(f"`{id_col}`").alias("id"), vector.alias("v"))
        # Not null, not all zero, all finite.
        usable = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
        rows = rows.where(F.col("id").isNotNull() & F.coalesce(usable, F.lit(False)))
        some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
        centres = _centres(_directions(_matrix(some.column("v"))), cells) if len(some) else np.zeros((0, 0))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = _directions(_matrix(batch.column("v")))
                    near = (found @ centres.T).argmax(axis=1)
                    angle = np.arccos(np.clip((found * centres[near]).sum(axis=1), -1.0, 1.0))
                    columns = [batch.column("id"), pa.array(list(found)), pa.array(near.astype(np.int32)), pa.array(angle)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "cell", "angle"])

        kind = rows.schema["id"].dataType.simpleString()
        placed = rows.mapInArrow(place, _row_schema(kind))
        placed.hint("rebalance", F.col("cell")).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/rows")
        stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        ends = stored.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
        held = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        ends.join(F.broadcast(held), "cell").write.mode("overwrite").parquet(f"{path}/cells")
        spark.createDataFrame([(kind,)], "kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")
        return cls(spark, path)

    def nearest(self, queries: DataFrame, k: int, query_id: str, query_vec: str, id_col: str = "id") -> DataFrame:
        """Like :func:`~corpusloom.operators.vectors.nearest_neighbours`: query id, ``id_col``, ``score`` and ``rank`` from 1."""
        vector = F.col(f"`{query_vec}`").cast("array<double>")
        asked = queries.select(F.col(f"`{query_id}`").alias("q"), vector.alias("v"))
        asked = asked.where(F.exists("v", lambda x: x != 0))
        q_type = asked.schema["q"].dataType.simpleString()
        self.cells_read = set()
        first = self._scanned(self._probes(asked.withColumn("kth", F.lit(None).cast("double")), k, q_type), k, q_type)
        first = self._kept(first, k, f"{self.path}/found")
        # The score to reach, null where there are less than k.
        kth = first.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("kth"))
        more = self._scanned(self._probes(asked.join(kth, "q"), k, q_type), k, q_type)
        found = self._ranked(first.drop("rank").union(more), k)
        return found.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")

    def _probes(self, asked: DataFrame, k: int, q_type: str) -> DataFrame:
        """``q, v, cell``: without ``kth`` the nearest cells that hold ``k`` rows, with it all others that may hold a better row."""
        numbers, centres, radius, rows = np.array(self.numbers, dtype=np.int32), self.centres, self.radius, self.rows

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(numbers):
                    continue
                found = _directions(_matrix(batch.column("v")))
                angles = _angles(found, centres)
                order = np.argsort(angles, axis=1, kind="stable")
                before = np.cumsum(rows[order], axis=1) - rows[order]
                needed = np.zeros(angles.shape, dtype=bool)
                np.put_along_axis(needed, order, before < k, axis=1)
                kth = batch.column("kth").to_numpy(zero_copy_only=False)
                if not np.isnan(kth).all():
                    reach = np.cos(np.maximum(0.0, angles - radius - SLACK)) + SLACK >= kth[:, None]
                    needed = reach & ~needed
                q, cell = np.nonzero(needed)
                ids = batch.column("q").take(pa.array(q))
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(found[q]), pa.list_(pa.float64())), pa.array(numbers[cell])], names=["q", "v", "cell"])

        return asked.select("q", "v", "kth").mapInArrow(look, f"q {q_type}, v array<double>, cell int")

    def _kept(self, df: DataFrame, k: int, path: str) -> DataFrame:
        """Written, since it is used twice."""
        folder = f"{path}-{uuid.uuid4().hex}"
        self._ranked(df, k).write.parquet(folder)
        return self.spark.read.parquet(folder)

    def _scanned(self, probes: DataFrame, k: int, q_type: str) -> DataFrame:
        """``q, id, score``: of each block of rows the best ``k`` for each query that needs its cell."""
        # As many rows as cells.
        asked = {r["cell"]: r["n"] for r in probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.cells_read |= asked.keys()
        out = f"q {q_type}, id {self.id_type}, score double"
        if not asked:
            return self.spark.createDataFrame([], out)
        # Only the folders of these cells are listed and read.
        folders = [f"{self.path}/rows/cell={c}" for c in sorted(asked)]
        stored = self.spark.read.schema(_row_schema(self.id_type)).option("basePath", f"{self.path}/rows").parquet(*folders).drop("angle")
        sizes = dict(zip(self.numbers, self.rows.tolist()))
        blocks = [(c, -(-sizes[c] // BLOCK_ROWS), -(-n // BLOCK_QUERIES)) for c, n in asked.items()]

        def dealt(side: DataFrame, key: str, own: int, names: tuple[str, str, str]) -> DataFrame:
            """Its own block of each row, and every block of the other side."""
            cell, *numbers = names
            there = F.broadcast(self.spark.createDataFrame(blocks, f"{cell} int, {numbers[0]} long, {numbers[1]} long"))
            out = side.join(there, F.col("cell") == F.col(cell))
            one = F.pmod(F.xxhash64(key), F.col(numbers[own]))
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(numbers[1 - own]) - 1))
            a, b = (one, every) if own == 0 else (every, one)
            return out.select(*side.columns, a.alias(f"{cell}_a"), b.alias(f"{cell}_b"))

        rows = dealt(stored, "id", 0, ("row", "row_blocks", "row_others"))
        sides = dealt(probes, "q", 1, ("side", "side_others", "side_blocks"))

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            q_type, id_type = right.schema.field("q").type, left.schema.field("id").type
            q_ids, tops = right.column("q").to_pylist(), []
            if len(left) and len(right):
                ids, directions, asking = _ids(left.column("id")), _matrix(left.column("v")), _matrix(right.column("v"))
                for first in range(0, len(asking), 64):
                    scores = np.round(asking[first : first + 64] @ directions.T, SCORE_DIGITS)
                    tops += [_best(s, ids, k) for s in scores]
            return pa.table(_neighbour_table(q_ids if tops else [], tops, q_type, id_type))

        rows, sides = rows.groupBy("cell", "row_a", "row_b"), sides.groupBy("cell", "side_a", "side_b")
        return rows.cogroup(sides).applyInArrow(score, out)

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        best = found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(MERGE_PARTS)))
        order = [F.desc("score"), "id"]
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order))).where(F.col("rank") <= k)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
        return best.select("q", "id", "score", "rank")
