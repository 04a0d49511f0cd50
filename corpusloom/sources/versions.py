"""Versions of an index: which folders hold its rows, under which columns.

Rows are written to folders that never change. A version names the columns of
the index and the folders that count; it is written last, in one rename, and
read first. So a job that fails, wherever it does, leaves the version before
it, and readers of that one go on reading their folders.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession, types as T


class ConcurrentWrite(RuntimeError):
    """Somebody else has written the version that this writer was about to write."""


@dataclass(frozen=True)
class Part:
    """What one write has left: ``paths`` below the index folder, and the columns as they were written."""

    paths: tuple[str, ...]
    columns: T.StructType
    partition_by: tuple[str, ...] = ()
    #: ``{column: (least, greatest)}`` and number of rows, where the writer has told them and all of its rows are still there
    spans: dict = field(default_factory=dict)
    rows: int | None = None

    def to_json(self) -> dict:
        return {
            "paths": list(self.paths), "columns": json.loads(self.columns.json()), "partition_by": list(self.partition_by),
            "spans": self.spans, "rows": self.rows,
        }

    @classmethod
    def from_json(cls, found: dict) -> Part:
        columns = T.StructType.fromJson(found["columns"])
        return cls(tuple(found["paths"]), columns, tuple(found["partition_by"]), found["spans"], found["rows"])


@dataclass(frozen=True)
class Version:
    number: int
    columns: T.StructType
    parts: tuple[Part, ...] = ()
    buckets: int = 0

    def to_json(self) -> str:
        return json.dumps(
            {"columns": json.loads(self.columns.json()), "buckets": self.buckets, "parts": [p.to_json() for p in self.parts]}
        )

    @classmethod
    def from_json(cls, number: int, text: str) -> Version:
        found = json.loads(text)
        return cls(number, T.StructType.fromJson(found["columns"]), tuple(map(Part.from_json, found["parts"])), found["buckets"])


class Files:
    """The few things done to files, by Hadoop's file systems, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    @property
    def fs(self):
        return self.path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return bool(self.fs.exists(self.path(name)))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name)))

    def delete(self, name: str = "") -> bool:
        return bool(self.exists(name) and self.fs.delete(self.path(name), True))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A file that is there as a whole or not at all; never in place of another."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.path(aside), False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        # Some stores answer false instead of raising.
        if self.exists(name) or not self.fs.rename(self.path(aside), self.path(name)):
            self.delete(aside)
            raise ConcurrentWrite(f"{self.root}/{name} is there already or could not be put in place")


class VersionLog:
    """The versions of one index, in ``_versions`` beside its folders."""

    FOLDER = "_versions"

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def numbers(self) -> list[int]:
        return [int(m[1]) for n in self.files.names(self.FOLDER) if (m := re.fullmatch(r"(\d+)\.json", n))]

    def get(self, number: int | None = None) -> Version | None:
        """A version, by default the last one; None if there is none."""
        numbers = self.numbers()
        if not numbers:
            return None
        number = max(numbers) if number is None else number
        if number not in numbers:
            raise ValueError(f"there is no version {number}; there are {numbers}")
        return Version.from_json(number, self.files.read(self._name(number)))

    def commit(self, version: Version) -> None:
        self.files.put(self._name(version.number), version.to_json())

    def vacuum(self, keep: int) -> None:
        """Delete all versions but the last ``keep``, and the folders that none of those names."""
        numbers = sorted(self.numbers())
        kept = [self.get(n) for n in numbers[-keep:]]
        named = {p.split("/")[0] for v in kept for part in v.parts for p in part.paths}
        before = {p.split("/")[0] for n in numbers[:-keep] for part in self.get(n).parts for p in part.paths}
        for n in numbers[:-keep]:
            self.files.delete(self._name(n))
        # Only folders that a version has named: those of a writer at work are not touched.
        for folder in before - named:
            self.files.delete(folder)

    def _name(self, number: int) -> str:
        return f"{self.FOLDER}/{number:010d}.json"


#: Each type holds the values of those before it.
NUMBERS = ["tinyint", "smallint", "int", "bigint", "double", "string"]


def widened(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The least type for values of both; None if there is none."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = widened(a.elementType, b.elementType)
        return None if inner is None else T.ArrayType(inner, a.containsNull or b.containsNull)
    names = ["double" if x.simpleString() == "float" else x.simpleString() for x in (a, b)]
    if all(n in NUMBERS for n in names):
        return T.DataType.fromDDL(max(names, key=NUMBERS.index))
    # Structs may differ in what may be null.
    return a if names[0] == names[1] else None


def merged_columns(before: T.StructType, new: T.StructType, widen: bool = True) -> T.StructType:
    """The columns of an index after rows with other columns come in: new ones are added, types widen.

    Raises where two types have no common one, or with ``widen=False`` where
    the index would have to change its type.
    """
    out, added = [], {f.name: f for f in new}
    for f in before:
        other = added.pop(f.name, None)
        kind = f.dataType if other is None else widened(f.dataType, other.dataType)
        if kind is None or not widen and kind.simpleString() != f.dataType.simpleString():
            raise ValueError(
                f"column {f.name!r} holds {f.dataType.simpleString()}, the new rows {other.dataType.simpleString()}"
            )
        out.append(T.StructField(f.name, kind, True, f.metadata or (other.metadata if other else None)))
    return T.StructType([*out, *[T.StructField(f.name, f.dataType, True, f.metadata) for f in added.values()]])
