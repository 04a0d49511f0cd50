"""Reading corpora."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F


def dealt(df: DataFrame, partitions: int | None) -> DataFrame:
    """The rows dealt evenly over so many tasks; as they come with None.

    For tables of few large pieces: a file of one row group is one task,
    however many cores there are. It shuffles whole rows, so the caller says
    whether it is worth that; nothing in the library does it by itself.
    """
    if partitions is not None and partitions < 1:
        raise ValueError("rows are dealt over one task at least")
    return df if partitions is None else df.repartition(partitions)


def read_texts(
    spark: SparkSession, path: str, format: str | None = None, schema=None, partitions: int | None = None, **options
) -> DataFrame:
    """A table of texts from files (format by suffix, Parquet by default) or the catalog.

    ``path`` without a slash and without a known suffix is a catalog table.
    With ``partitions`` its rows are dealt over so many tasks (:func:`dealt`).
    """
    return dealt(_read(spark, path, format, schema, options), partitions)


def _read(spark: SparkSession, path: str, format: str | None, schema, options: dict) -> DataFrame:
    if format is None:
        suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
        known = {"json": "json", "jsonl": "json", "csv": "csv", "orc": "orc", "parquet": "parquet", "txt": "text"}
        if suffix not in known and "/" not in path:
            return spark.table(path)
        format = known.get(suffix, "parquet")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def head(df: DataFrame, n: int, order_by: str | list[str]) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(order_by).limit(n)


def first_paths(spark: SparkSession, pattern: str, n: int) -> list[str]:
    """The first ``n`` files of a glob by path; no content is read, and folders after the last of them are not listed."""
    found = _walked(spark, pattern, n) if isinstance(pattern, str) and not set(pattern) & set("{}\\^") else None
    return found or _listed(spark, pattern, n)


def _listed(spark: SparkSession, pattern: str, n: int) -> list[str]:
    listed = spark.read.format("binaryFile").load(pattern).select("path")
    return [r["path"] for r in listed.orderBy("path").limit(n).collect()]


def _walked(spark: SparkSession, pattern: str, n: int) -> list[str] | None:
    """The same folder by folder in the order of paths; None where Spark's own listing is needed (or has the error to raise)."""
    jvm = spark._jvm
    at, steps = jvm.org.apache.hadoop.fs.Path(pattern), []
    while at is not None and set(at.toString()) & set("*?["):
        steps.insert(0, at.getName())
        at = at.getParent()
    if at is None or not steps:
        return None
    out: list[str] = []
    try:
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())

        def walk(folder, level: int) -> None:
            within = re.sub(r"([*?\[\]{}\\])", r"\\\1", folder.toString())
            # They come sorted by name.
            matching = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{within}/{steps[level]}"))
            for name, is_folder, path in _by_path(matching or ()):
                if len(out) >= n:
                    return
                if level + 1 < len(steps):
                    if is_folder:
                        walk(path, level + 1)
                elif is_folder:
                    if set(path.toString()) & set("*?[{\\"):
                        raise _OtherOrder
                    out.extend(_listed(spark, path.toString(), n - len(out)))
                elif not _hidden(name):
                    out.append(path.toString())

        walk(at, 0)
    except (Py4JJavaError, _OtherOrder):
        return None
    return out


class _OtherOrder(Exception):
    """Java orders a name otherwise than Spark does."""


def _by_path(matching) -> Iterator[tuple]:
    """``(name, is a folder, path)`` of files sorted by name, in the order of the paths in them: a folder ``a`` stands after
    a file or folder ``a-b``, as ``a/`` does. Of an array of any size only the rows asked for come out of the JVM."""
    held: list[tuple] = []
    for status in matching:
        path, is_folder = status.getPath(), status.isDirectory()
        name = path.getName()
        if max(name) > "\uffff":
            raise _OtherOrder
        while held and not name.startswith(held[0][1]):
            yield heappop(held)[1:4]
        heappush(held, (name + "/" if is_folder else name, name, is_folder, path))
    while held:
        yield heappop(held)[1:4]


def _hidden(name: str) -> bool:
    """Whether Spark leaves a file out for its name."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")


def html_files(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """Files matching a glob, or those listed, one row per file: ``path`` and ``html``."""
    if not pattern:
        return spark.createDataFrame([], "path string, html string")
    files = spark.read.text(pattern, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def union_by_name(*tables: DataFrame) -> DataFrame:
    """Corpora under one another by column name; columns a table lacks are null."""
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t, allowMissingColumns=True)
    return merged
