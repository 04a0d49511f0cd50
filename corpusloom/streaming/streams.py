"""Streams of texts: enrichment, live date histograms, live top terms.

State and results live in files below given folders, which on a cluster are
shared ones; a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.panels import _seconds
from ..plans.pipeline import Pipeline
from ..sources.index import prepared
from ..sources.versions import Files


def stream_table(spark: SparkSession, path: str, schema=None, format: str = "parquet", **options) -> DataFrame:
    """A stream over the files of a table folder, present and to come, or over one file."""
    if schema is None:
        schema = spark.read.format(format).load(path).schema
    reader = spark.readStream.format(format).schema(schema).options(**options)
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(location).isFile():
        # A stream watches folders: watch the file's own, for this name only.
        return reader.option("pathGlobFilter", location.getName()).load(location.getParent().toString())
    return reader.load(path)


def enrich_stream(
    pipeline: Pipeline, stream: DataFrame, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Run a pipeline on a stream and append to an index folder.

    ``once`` takes what is there and stops; otherwise the query keeps running.
    """
    rows = prepared(pipeline.transform(stream), pipeline.roles)
    writer = rows.writeStream.format(pipeline.format).option("checkpointLocation", checkpoint).outputMode("append")
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def live_date_histogram(stream: DataFrame, ts: str, step: str = "2 hours", late: str = "1 hour", by: list[str] = ()):
    """Rows by time window, updated as they come; windows older than ``late`` are closed."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counted = timed.groupBy(F.window("_ts", step).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("key"), *by, "n")


def live_terms(stream: DataFrame, ts: str, values: Column, step: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows by time window and term; see :func:`top_terms` for the ranking."""
    timed = stream.select(
        F.col(ts).cast("timestamp").alias("_ts"), F.explode(F.array_distinct(values)).alias("term")
    ).withWatermark("_ts", late)
    counted = timed.groupBy(F.window("_ts", step).alias("w"), "term").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("key"), "term", "n")


def top_terms(counts: DataFrame, size: int = 20) -> DataFrame:
    """The most frequent terms of every window."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= size)


class Epochs:
    """Small results of micro-batches, a folder for each; a repeated batch writes its folder again.

    When there are more than ``most`` folders they are merged into one. A
    reader takes the last merged folder and what came after it, so nothing is
    lost or counted twice if the merge stops half way.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 20):
        self.files, self.spark, self.path, self.most = Files(spark, path), spark, path, most

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(m[1]) for n in self.files.names() if (m := re.fullmatch(rf"{kind}=(\d+)", n)))

    def folders(self) -> list[str]:
        merged = max(self._numbers("merged"), default=-1)
        return ([f"merged={merged}"] if merged >= 0 else []) + [f"epoch={e}" for e in self._numbers("epoch") if e > merged]

    def add(self, epoch: int, rows: DataFrame) -> DataFrame:
        """Store the rows of a batch, and give them back as stored."""
        folder = f"{self.path}/epoch={epoch}"
        rows.withColumn("at", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder)

    def read(self) -> DataFrame:
        """All rows, with the epoch they come from (``at``)."""
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in self.folders()])

    def merge(self, merged: Callable[[DataFrame], DataFrame]) -> None:
        """Where there are too many folders, one of what ``merged`` makes of their rows in place of all."""
        old = self.folders()
        if len(old) <= self.most:
            return
        last = old[-1].rpartition("=")[2]
        merged(self.read()).write.mode("overwrite").parquet(f"{self.path}/merged={last}")
        for kind in ("merged", "epoch"):
            for n in self._numbers(kind):
                if n < int(last) or kind == "epoch" and n == int(last):
                    self.files.delete(f"{kind}={n}")


def _newest(changes: DataFrame) -> DataFrame:
    keys = [c for c in changes.columns if c not in ("n", "at")]
    newest = F.max(F.struct("at", "n")).alias("_newest")
    return changes.groupBy(*keys).agg(newest).select(*keys, "_newest.n", "_newest.at")


def write_live(counts: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the current state of a windowed count as a table of changes.

    Each micro-batch writes the counts it changed to a folder of its own, so a
    repeated batch changes nothing; :func:`read_live` puts them together, and
    from time to time they are merged.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        epochs = Epochs(batch.sparkSession, path)
        epochs.add(epoch, batch)
        epochs.merge(_newest)

    return _started(counts.writeStream.outputMode("update"), store, checkpoint, once)


def _started(writer, store: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every key stored by :func:`write_live`."""
    return _newest(Epochs(spark, path).read()).drop("at")


def write_windows(
    stream: DataFrame, ts: str, path: str, checkpoint: str, step: str = "2 hours", late: str = "1 hour",
    by: Sequence[str] = (), once: bool = True, most_folders: int = 20,
) -> StreamingQuery:
    """Count rows by time window; windows close, and what comes after that is counted apart.

    The watermark of a micro-batch is the latest instant of the batches before
    it less ``late``. A row whose window ended by then is late. Each batch
    leaves only counts and its latest instant, so nothing is kept in a state
    store and a repeated batch changes nothing. ``step`` and ``late`` are fixed
    steps as date histograms have them. Rows without a time are not counted.
    """
    size, delay = _seconds(step), _seconds(late)

    def store(batch: DataFrame, epoch: int) -> None:
        epochs = Epochs(batch.sparkSession, path, most_folders)
        before = epochs.read().where(F.col("at") < epoch) if epochs.folders() else None
        last = None if before is None else before.agg(F.max("last")).first()[0]
        timed = batch.select(F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias("last"), *by).where("last IS NOT NULL")
        start = F.floor(F.col("last") / 1_000_000).cast("long")
        start = start - F.pmod(start, F.lit(size))
        closed = F.lit(False) if last is None else (start + size) * 1_000_000 <= F.lit(last - delay * 1_000_000)
        counted = timed.groupBy(start.alias("start"), *by, closed.alias("late")).agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last"))
        epochs.add(epoch, counted)
        epochs.merge(lambda rows: _summed(rows, by))

    return _started(stream.writeStream, store, checkpoint, once)


def _summed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy("start", *by, "late").agg(*[f(c).alias(c) for f, c in ((F.sum, "n"), (F.max, "last"), (F.max, "at"))])


def read_windows(spark: SparkSession, path: str, step: str = "2 hours", late: str = "1 hour", closed: bool = True) -> DataFrame:
    """``key`` (start of the window), the columns counted by, ``n`` and ``n_late``, of closed windows or of all.

    A window is closed when the watermark has passed its end: its ``n`` does
    not change any more.
    """
    rows = Epochs(spark, path).read()
    by = [c for c in rows.columns if c not in ("start", "late", "n", "last", "at")]
    counts = rows.groupBy("start", *by).agg(
        F.coalesce(F.sum(F.when(~F.col("late"), F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("late"), F.col("n"))), F.lit(0)).alias("n_late"),
    )
    if closed:
        mark = rows.agg((F.max("last") - _seconds(late) * 1_000_000).alias("mark")).scalar()
        counts = counts.where((F.col("start") + _seconds(step)) * 1_000_000 <= mark)
    return counts.select(F.timestamp_seconds("start").alias("key"), *by, "n", "n_late")


def upsert_stream(
    pipeline: Pipeline, stream: DataFrame, checkpoint: str, version: str | Sequence[str] = (), once: bool = True
) -> StreamingQuery:
    """Run a pipeline on a stream and write its rows by id: of each id the index has the row of the greatest ``version``.

    It does not matter in which batch a row comes, nor that a batch is
    repeated. Nothing is kept but the index itself; one with buckets
    (``Pipeline(buckets=…)``) has only those rewritten that a batch touches.
    """
    if pipeline.roles.id is None:
        raise ValueError("to replace rows by id, declare id_col")

    def store(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            index = pipeline.index(batch.sparkSession)
            index.upsert(pipeline.transform(batch), pipeline.roles, pipeline.partition_by, version, keep_newer=True)

    return _started(stream.writeStream, store, checkpoint, once)
