"""Named indexes: typed table folders under one root, with a write policy."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.nulls import documents, prune
from ..roles import Roles
from .versions import Part, Version, VersionLog, merged_columns

POLICIES = {"error": "errorifexists", "overwrite": "overwrite", "append": "append"}


def write_mode(if_exists: str | None) -> str:
    """The Spark write mode of an existing-index policy; any case, ``None`` is ``error``."""
    mode = POLICIES.get((if_exists or "error").lower())
    if mode is None:
        raise ValueError(f"if_exists must be one of {sorted(POLICIES)}, not {if_exists!r}")
    return mode


class Index:
    """One named index.

    ``format`` is ``parquet`` (default), ``orc`` or ``json``; with ``json`` rows
    are written as documents without nulls and NaNs.

    Every write adds a version (:mod:`.versions`): reading infers nothing, and a
    job that fails leaves the index as it was. The last ``keep`` versions and
    their rows stay readable.

    With ``buckets`` rows lie by a hash of their id, so writing ids again
    rewrites only the buckets that hold one of them. The number is fixed when
    the index is made; choose it so that a bucket fits a task.
    """

    BUCKET, WRITE = "_bucket", "_write"

    def __init__(
        self, spark: SparkSession, root: str, name: str, format: str = "parquet", buckets: int = 0, keep: int = 2
    ):
        if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", name):
            raise ValueError(f"not a usable index name: {name!r}")
        if keep < 1:
            raise ValueError("the last version is always kept")
        self.spark, self.root, self.name, self.format = spark, root.rstrip("/"), name, format
        self.path = f"{self.root}/{name}"
        self.buckets, self.keep = buckets, keep
        self.log = VersionLog(spark, self.path)

    # -- life cycle

    def exists(self) -> bool:
        return self.log.files.exists()

    def check(self, if_exists: str | None = "error") -> str:
        """The write mode, or an error before any work is done."""
        mode = write_mode(if_exists)
        if mode == "errorifexists" and self.exists():
            raise FileExistsError(
                f"index {self.name!r} exists: choose another name, or if_exists='append' or 'overwrite'"
            )
        return mode

    def create(self, df: DataFrame, roles: Roles | None = None, if_exists: str | None = "error") -> None:
        """An empty index with the columns of ``df``, typed by role."""
        self.check(if_exists)
        self._commit(self._current(), prepared(df, roles).schema, (), self.buckets)

    def drop(self) -> bool:
        """Delete the index folder, which lies directly below the root."""
        return self.log.files.delete()

    def truncate(self) -> None:
        """Delete all rows, keep the columns."""
        now = self._current()
        self._commit(now, self.read().schema, (), now.buckets if now else self.buckets)

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, the last one last."""
        return sorted(self.log.numbers())

    # -- rows

    def write(
        self,
        df: DataFrame,
        roles: Roles | None = None,
        if_exists: str | None = "error",
        partition_by: Sequence[str] = (),
        widen: bool = True,
        spans: Callable[[], dict] | None = None,
    ) -> None:
        """Write rows: role columns get their types, transient columns stay out.

        With ``append`` columns may differ: rows without one have nulls there,
        and a type becomes the least that holds both, in the order of
        :data:`.versions.NUMBERS`. Types without a common one are refused
        before anything is written, with ``widen=False`` all changes of a type.
        ``spans`` is asked after the rows are written for their number
        (``rows``) and for ``{column}_min`` and ``{column}_max``.
        """
        mode = self.check(if_exists)
        df = prepared(df, roles)
        now = self._current()
        before = now if mode == "append" else None
        columns, buckets = df.schema, self.buckets
        if before is not None:
            columns, buckets = merged_columns(before.columns, df.schema, widen), before.buckets
            self._check_id(before, columns, roles)
        part = self._save(df, roles, buckets, partition_by)
        if spans is not None:
            part = replace(part, **_told(spans()))
        self._commit(now, columns, (*(before.parts if before else ()), part), buckets)

    def upsert(
        self, df: DataFrame, roles: Roles, partition_by: Sequence[str] = (), version: str | Sequence[str] = (), keep_newer: bool = False
    ) -> None:
        """Write rows by id: those that are there with an id of ``df`` are replaced, all others stay.

        An id that occurs more than once in ``df`` is written once, with the
        row of the greatest ``version`` (ties, and without one all: the
        greatest row). With ``keep_newer`` a row that is there counts among
        them, so a row that comes late does not replace a newer one. Rows
        without an id are refused, since nothing could replace them: the index
        stays as it was.

        The new rows are written once, to their place. Of the buckets (an index
        without buckets is one) only those that hold one of the ids are
        written again, without the rows replaced.
        """
        if roles.id is None:
            raise ValueError("to replace rows by id, name the id column")
        df = prepared(df, roles)
        now = self._current()
        columns = df.schema if now is None else merged_columns(now.columns, df.schema)
        buckets = self.buckets if now is None else now.buckets
        if now is not None:
            self._check_id(now, columns, roles)
        nulls = Observation(f"ids of {self.name} {uuid.uuid4().hex}")
        watched = df.observe(nulls, F.count_if(F.col(f"`{roles.id}`").isNull()).alias("n"))
        part = self._save(latest_by_id(watched, roles.id, version), roles, buckets, partition_by)
        if nulls.get["n"]:
            for path in part.paths:
                self.log.files.delete(path)
            raise ValueError(f"{nulls.get['n']} rows have no {roles.id!r}")
        if keep_newer and now is not None:
            also = [self.BUCKET] if now.buckets else []
            fresh, there = (self._load(p, columns, *also) for p in ([part], self._near(now, part)))
            ids = fresh.select(F.col(f"`{roles.id}`").alias(roles.id), *also)
            met = fresh.union(there.join(ids, [roles.id, *also], "left_semi").select(fresh.columns)).drop(self.BUCKET)
            aside, part = part, self._save(latest_by_id(met, roles.id, version), roles, buckets, partition_by)
            for path in aside.paths:
                self.log.files.delete(path)
        parts = () if now is None else self._without(now, part, columns, roles.id)
        self._commit(now, columns, (*parts, part), buckets)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the last one."""
        found = self.log.get(version)
        if found is not None:
            return self._load(found.parts, found.columns)
        if not self.exists():
            raise FileNotFoundError(f"there is no index {self.name!r}")
        return self._foreign()

    def spans(self, columns: Sequence[str]) -> dict[str, tuple]:
        """``{column: (least, greatest)}`` for those of ``columns`` that all writes have told, without reading a row."""
        now = self.log.get()
        parts = () if now is None else [p for p in now.parts if p.rows != 0]
        out = {}
        for c in columns if parts else ():
            told = [p.spans.get(c) for p in parts]
            if all(told):
                ends = [[_value(v) for v in t] for t in told]
                least, greatest = ([e[k] for e in ends if e[k] is not None] for k in (0, 1))
                if len({"number" if isinstance(v, (int, float)) else type(v) for v in least}) <= 1:  # else its type has changed
                    out[c] = (min(least, default=None), max(greatest, default=None))
        return out

    # -- folders

    def _current(self) -> Version | None:
        """The last version; of a folder that something else has written, all that is in it."""
        found = self.log.get()
        names = [] if found is not None else self.log.files.names()
        if "_spark_metadata" in names:
            raise ValueError(f"a stream writes to the folder of {self.name!r}: only the stream adds to it")
        if shown := [n for n in names if n[0] not in "._"]:
            columns = self._foreign().schema
            return Version(0, columns, (Part(tuple(shown), columns),))
        return found

    def _foreign(self) -> DataFrame:
        """A folder that something else has written, a stream perhaps, as Spark reads it."""
        return self.spark.read.format(self.format).option("mergeSchema", "true").load(self.path)

    def _commit(self, now: Version | None, columns: T.StructType, parts: Sequence[Part], buckets: int) -> None:
        number = 1 + (now.number if now else 0)
        self.log.commit(Version(number, columns, tuple(p for p in parts if p.paths), buckets))
        self.log.vacuum(self.keep)

    @staticmethod
    def _check_id(before: Version, columns: T.StructType, roles: Roles | None) -> None:
        """A bucket is told from the id as text, which depends on its type."""
        if before.buckets and (roles is None or roles.id is None):
            raise ValueError("an index with buckets is written by id: name the id column")
        if before.buckets and roles.id in before.columns.names and before.columns[roles.id].dataType != columns[roles.id].dataType:
            raise ValueError(f"the id column {roles.id!r} of an index with buckets keeps its type")

    def _bucketed(self, df: DataFrame, id_col: str, buckets: int) -> DataFrame:
        key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
        return df.withColumn(self.BUCKET, F.pmod(F.xxhash64(key), F.lit(max(1, buckets))).cast("int"))

    def _save(self, df: DataFrame, roles: Roles | None, buckets: int, partition_by: Sequence[str]) -> Part:
        """Write rows to a folder of their own. It counts when a version names it."""
        if clash := {self.BUCKET, self.WRITE} & set(df.columns):
            raise ValueError(f"columns of an index cannot be named {sorted(clash)}")
        rows, keys = prune(df) if self.format == "json" else df, list(partition_by)
        if buckets:
            if roles is None or roles.id is None:
                raise ValueError("an index with buckets is written by id: name the id column")
            # Large buckets are split over tasks, small ones share one.
            rows = self._bucketed(rows, roles.id, buckets).hint("rebalance", F.col(self.BUCKET))
            keys = [self.BUCKET, *keys]
        folder = f"{self.WRITE}={uuid.uuid4().hex}"
        rows.write.format(self.format).mode("errorifexists").partitionBy(*keys).save(f"{self.path}/{folder}")
        paths = [folder]
        if buckets:
            paths = [f"{folder}/{n}" for n in self.log.files.names(folder) if n.startswith(f"{self.BUCKET}=")]
        return Part(tuple(paths), df.schema, tuple(keys))

    def _load(self, parts: Sequence[Part], columns: T.StructType, *also: str) -> DataFrame:
        """The rows of ``parts`` under ``columns``, and the columns ``also`` by which folders are named.

        Folders written under the same columns are one scan; another scan's
        columns are cast.
        """
        groups: dict[tuple, list[Part]] = {}
        for p in parts:
            groups.setdefault((p.columns.json(), p.partition_by), []).append(p)
        kept = [*columns, *[T.StructField(c, T.IntegerType()) for c in also]]
        scans = []
        for (_, keys), members in groups.items():
            paths = sorted(f"{self.path}/{x}" for p in members for x in p.paths)
            schema = T.StructType(list(members[0].columns))
            if paths and any(x.startswith(f"{self.WRITE}=") for x in members[0].paths):
                schema = schema.add(self.WRITE, T.StringType())
            if self.BUCKET in keys:
                schema = schema.add(self.BUCKET, T.IntegerType())
            rows = self.spark.read.format(self.format).schema(schema).option("basePath", self.path).load(paths)
            scans.append(rows.select([_as(f, schema) for f in kept]))
        if not scans:
            return self.spark.createDataFrame([], T.StructType(kept))
        rows = reduce(DataFrame.union, scans)
        return rows if len(scans) == 1 else rows.select([F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata or {}) for f in kept])

    @staticmethod
    def _near(now: Version, new: Part) -> list[Part]:
        """What a version has in the buckets of ``new``."""
        buckets = {x.rpartition("=")[2] for x in new.paths} if now.buckets else None
        near = [replace(p, paths=tuple(x for x in p.paths if _in(x, buckets))) for p in now.parts]
        return [p for p in near if p.paths]

    def _without(self, now: Version, new: Part, columns: T.StructType, id_col: str) -> list[Part]:
        """The parts of a version, with those buckets written again that hold an id of ``new``."""
        near = self._near(now, new)
        buckets = {x.rpartition("=")[2] for x in new.paths} if now.buckets else None
        also = [self.BUCKET] if now.buckets else []
        ids = self._load([new], columns, *also).select(F.col(f"`{id_col}`").alias(id_col), *also)
        hit = self._load(near, columns, *also).join(ids, [id_col, *also], "left_semi")
        if now.buckets:  # as many rows as there are buckets at most
            buckets = {str(r[0]) for r in hit.select(self.BUCKET).distinct().collect()}
        elif hit.isEmpty():
            buckets = set()
        old = [replace(p, paths=tuple(x for x in p.paths if _in(x, buckets))) for p in near]
        old = [p for p in old if p.paths]
        if not old:
            return list(now.parts)
        left = self._load(old, columns, *also).join(ids, [id_col, *also], "left_anti").drop(self.BUCKET)
        again = self._save(left, Roles(id=id_col), now.buckets, [c for c in new.partition_by if c != self.BUCKET])
        # Of a part whose rows are not all where they were, what its writer has told holds no more.
        untouched = [(p, tuple(x for x in p.paths if not _in(x, buckets))) for p in now.parts]
        return [p if paths == p.paths else replace(p, paths=paths, spans={}, rows=None) for p, paths in untouched] + [again]


def _in(path: str, buckets: set[str] | None) -> bool:
    """Whether a folder is of one of the buckets (None: all)."""
    return buckets is None or path.rpartition("=")[2] in buckets if "/" in path else buckets is None


def _as(f: T.StructField, schema: T.StructType) -> Column:
    """A column of a scan as the index has it."""
    if f.name not in schema.names:
        return F.lit(None).cast(f.dataType).alias(f.name, metadata=f.metadata or {})
    col = F.col(f"`{f.name}`")
    same = schema[f.name].dataType.simpleString() == f.dataType.simpleString()
    return col if same else col.cast(f.dataType).alias(f.name, metadata=f.metadata or {})


def _told(values: dict) -> dict:
    """Ends as JSON has them, each with its type where JSON has none."""
    plain = lambda v: v if v is None or isinstance(v, (int, float, str)) else {type(v).__name__: v.isoformat() if hasattr(v, "isoformat") else str(v)}
    columns = [k.removesuffix("_min") for k in values if k.endswith("_min")]
    return {"rows": values["rows"], "spans": {c: [plain(values[f"{c}_min"]), plain(values[f"{c}_max"])] for c in columns}}


def _value(told):
    if not isinstance(told, dict):
        return told
    (kind, text), = told.items()
    return {"datetime": datetime.fromisoformat, "date": date.fromisoformat, "Decimal": Decimal}[kind](text)


def prepared(df: DataFrame, roles: Roles | None) -> DataFrame:
    """The table as it goes into an index."""
    if roles is None:
        return df
    df = roles.typed(df.drop(*roles.transient))
    return df.withColumn("suggest", F.col(roles.suggest)) if roles.suggest else df


def with_document_id(df: DataFrame, id_col: str | None = None, out_col: str = "_id") -> DataFrame:
    """A document id: the id column as text, or a hash of the row's content.

    A content hash is the same on every run and every retry of a task.
    """
    if id_col:
        return df.withColumn(out_col, F.col(id_col).cast("string"))
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.withColumn(out_col, F.sha2(content, 256))


def latest_by_id(df: DataFrame, id_cols: str | Sequence[str], version: str | Sequence[str]) -> DataFrame:
    """One row per id, the one of the greatest version: writing an id again replaces it.

    An aggregation, not a window: each task first reduces its own rows, so an
    id with very many versions does not end up in one place.
    """
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    version = [version] if isinstance(version, str) else list(version)
    rest = [c for c in df.columns if c not in id_cols]
    # All columns break ties, so the choice never depends on row order.
    maps = {f.name for f in df.schema.fields if "map<" in f.dataType.simpleString()}
    ties = [F.to_json(F.struct(c)) if c in maps else F.col(c) for c in rest if c not in version]
    order = F.struct(*version, *[t.alias(f"_{i}") for i, t in enumerate(ties)])
    last = df.groupBy(*id_cols).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return last.select(*[F.col(c) if c in id_cols else F.col("_row")[c].alias(c) for c in df.columns])


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    if_exists: str = "overwrite",
    batch_rows: int = 1000,
    connections: int = 8,
    **options: str,
) -> None:
    """Load rows into a database table in batches: replace it first, or append.

    ``connections`` bounds how many tasks write to the database at a time; the
    work before is not bound by it.
    """
    (
        df.repartition(connections)
        .write.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("batchsize", str(batch_rows))
        .options(**options)
        .mode(write_mode(if_exists))
        .save()
    )


__all__ = ["Index", "documents", "latest_by_id", "prepared", "with_document_id", "write_jdbc", "write_mode"]
