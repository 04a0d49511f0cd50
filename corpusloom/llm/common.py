"""What several operators share: document keys, and folders for cut lineage.

A document is told apart by its id and a hash of its text, so null ids, ids
that occur twice and repeated rows need no row number: rows alike in both are
one document, and each of them gets that document's result.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage, shared_folder

__all__ = ["bitmap_of", "cut_lineage", "in_bitmap", "keyed", "small_batches", "text_hash", "unpacked", "without", "written"]


def text_hash(text: Column | str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All columns packed into ``row``, beside ``id``, ``text`` and ``th``: no name of the input can clash."""
    return docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        text_hash(text_col).alias("th"),
    )


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: they survive lost executors, and the planner knows their size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Plans made meanwhile send at most so many rows at a time to Python: a row is a whole document, and each batch is
    held in the JVM and in the worker at once. A smaller setting of the session stays."""
    given = spark.conf.get(_BATCH_ROWS)
    try:
        if not 0 < int(given) <= rows:
            spark.conf.set(_BATCH_ROWS, str(rows))
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, given)


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are not among the documents (``id, th``) of ``dropped``.

    Few documents are dropped as a rule. Their table is written first, so its
    size decides whether it is broadcast or the rows are shuffled.
    """
    gone = written(dropped.select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")), "dropped")
    base = keyed(docs, id_col, text_col)
    kept = base.join(gone, base["id"].eqNullSafe(F.col("gone_id")) & (base["th"] == F.col("gone_th")), "left_anti")
    return unpacked(kept)


def unpacked(df: DataFrame, **new: Column) -> DataFrame:
    """The packed columns again, with ``new`` ones in place of or after them."""
    names = [f.name for f in df.schema["row"].dataType.fields]
    kept = [new.pop(n).alias(n) if n in new else F.col("row").getField(n).alias(n) for n in names]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


BITMAP_BITS = 24  # 2 MB, whatever the number of hashes


def bitmap_of(df: DataFrame, column: str):
    """A broadcast of fixed size with one bit for the first bits of each hash (a long) in ``column``."""
    slot = F.shiftrightunsigned(column, 64 - BITMAP_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    words = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    for row in df.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toLocalIterator():
        words[row["word"]] = row["bits"]
    return df.sparkSession.sparkContext.broadcast(words.tobytes())


def in_bitmap(hashes: np.ndarray, bitmap: bytes) -> np.ndarray:
    """Where a hash (unsigned) may be one of those in the bitmap: all that are, and few others while it is not full."""
    words = np.frombuffer(bitmap, dtype=np.uint64)
    slot = hashes >> np.uint64(64 - BITMAP_BITS)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
