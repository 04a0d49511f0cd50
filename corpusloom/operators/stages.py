"""Stages: row-wise steps that add columns to a table of texts.

A stage is a lazy ``DataFrame -> DataFrame`` step. Whenever possible it is a
column expression, so that a chain of stages becomes a single projection. User
code that needs Python values runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx
from ..roles import Roles


class Stage:
    """Base of all stages."""

    def __init__(self, name: str | None = None):
        self.name = name or type(self).__name__

    def output_roles(self) -> dict[str, list[str]]:
        """Columns the stage adds, by role: ``tag``, ``num``, ``vec``, ``transient``."""
        return {}

    def transform(self, df: DataFrame, roles: Roles | None = None) -> DataFrame:
        raise NotImplementedError


class TableStage(Stage):
    """Wrap a plain function ``DataFrame -> DataFrame`` as a stage."""

    def __init__(self, fn: Callable[[DataFrame], DataFrame], name: str | None = None, **outputs: list[str]):
        super().__init__(name or getattr(fn, "__name__", None))
        self._fn = fn
        self._outputs = outputs

    def output_roles(self):
        return self._outputs

    def transform(self, df, roles=None):
        return self._fn(df)


def as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _overrides(stage: Stage, base: type, method: str) -> bool:
    return getattr(type(stage), method) is not getattr(base, method)


class MapToSingle(Stage):
    """One value to one value.

    Give a column expression as ``fn``, or subclass and override either
    ``expression(column)`` or, for Python code, ``doprocess(value)``. The value
    arrives as text; a null stays null.
    """

    return_type: str = "string"

    def __init__(
        self,
        col: str | Sequence[str],
        out_col: str,
        fn: Callable[[Column], Column] | None = None,
        return_type: str | None = None,
        role: str | None = None,
    ):
        super().__init__()
        self.col = as_list(col)[0]
        self.out_col = out_col
        self._fn = fn
        self.return_type = return_type or self.return_type
        self._role = role

    def output_roles(self):
        return {self._role: [self.out_col]} if self._role else {}

    def expression(self, value: Column) -> Column:
        if self._fn is not None:
            return self._fn(value)
        return _python_map(self.doprocess, self.return_type)(value)

    def doprocess(self, value: str) -> Any:
        raise NotImplementedError

    def transform(self, df, roles=None):
        return df.withColumn(self.out_col, self.expression(F.col(self.col).cast("string")))


class MapToTags(Stage):
    """Values of one or more columns to one list of tags, joined in column order."""

    def __init__(self, cols: str | Sequence[str], out_col: str, fn: Callable[[Column], Column] | None = None):
        super().__init__()
        self.cols = as_list(cols)
        self.out_col = out_col
        self._fn = fn

    def output_roles(self):
        return {"tag": [self.out_col]}

    def tags(self, value: Column) -> Column:
        if self._fn is not None:
            return self._fn(value)
        return _python_map(self.doprocess, "array<string>")(value)

    def doprocess(self, value: str) -> list[str]:
        raise NotImplementedError

    def transform(self, df, roles=None):
        parts = [self.tags(F.col(c).cast("string")) for c in self.cols]
        if len(parts) > 1:
            parts = [F.coalesce(p, F.array()) for p in parts]
            return df.withColumn(self.out_col, F.concat(*parts))
        return df.withColumn(self.out_col, F.coalesce(parts[0], F.array()))


def _python_map(fn: Callable[[str], Any], return_type: str):
    """A per-value Python function over Arrow batches; nulls are not passed in."""

    @F.pandas_udf(return_type)
    def mapped(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(v) for v in values], dtype=object)

    return mapped


class RegexTag(MapToTags):
    """All matches of a regular expression (Python syntax by default) as tags.

    With several groups the output is an array of structs and the tag role
    belongs to nobody, since such values are not single strings.
    """

    def __init__(self, regex: str = "doi:[^ ]+", cols: str | Sequence[str] = (), out_col: str = "tags", dialect="python"):
        super().__init__(cols, out_col)
        self.regex = regex
        self.dialect = dialect

    def output_roles(self):
        return {"tag": [self.out_col]} if tx.group_count(self.regex) <= 1 else {}

    def tags(self, value):
        return tx.find_all(value, self.regex, self.dialect)

    def transform(self, df, roles=None):
        parts = [self.tags(F.col(c)) for c in self.cols]
        return df.withColumn(self.out_col, F.concat(*parts) if len(parts) > 1 else parts[0])


class Split(MapToTags):
    """Pieces of a delimited text as tags: ``"a, b"`` gives ``a`` and ``b``."""

    def __init__(self, separator: str, cols: str | Sequence[str], out_col: str | None = None):
        super().__init__(cols, out_col or as_list(cols)[0] + "_tags")
        self.separator = separator

    def tags(self, value):
        return tx.split_clean(value, self.separator)


class SynonymTags(MapToTags):
    """Words of a text that are seed words or lie near one in a word-vector table.

    The seeds' ``topn`` nearest words are looked up once, when the stage is
    built (at most ``len(seeds) * (topn + 1)`` words); tagging is row-wise.
    """

    def __init__(self, seeds: Iterable[str], word_vectors: DataFrame, cols, out_col, topn: int = 10):
        super().__init__(cols, out_col)
        self.vocabulary = expanded_words([s.lower() for s in seeds], word_vectors, topn)

    def tags(self, value):
        return F.filter(tx.words(value), lambda t: t.isin(self.vocabulary))


def expanded_words(seeds: list[str], word_vectors: DataFrame, topn: int) -> list[str]:
    """Seeds plus their nearest words by cosine; table columns ``term`` and ``vec``."""
    from .vectors import nearest_neighbours

    known = word_vectors.where(F.col("term").isin(seeds))
    near = nearest_neighbours(
        known.select(F.col("term").alias("seed"), "vec"),
        word_vectors,
        k=topn + 1,  # a seed finds itself first
        query_id="seed",
        query_vec="vec",
        id_col="term",
        vec_col="vec",
    )
    found = [r["term"] for r in near.select("term").distinct().collect()]
    return sorted(set(seeds) | set(found))


class MapToNamedTags(Stage):
    """One column to several, named ``{column}_{key}``.

    Override ``expressions(column)`` to return ``{key: Column}``, or, for
    Python code, set ``schema`` (DDL of a struct) and override
    ``doprocess(series)``, which gets a batch of texts and returns one dict per
    text. Null texts arrive as a single blank unless ``coerce`` is off.
    """

    schema: str | None = None

    def __init__(
        self,
        cols: str | Sequence[str],
        tags: Sequence[str] = (),
        ignore_upload_cols: Sequence[str] = (),
        coerce: bool = True,
    ):
        super().__init__()
        self.cols = as_list(cols)
        self.keys = list(tags)
        self.ignored = list(ignore_upload_cols)
        self.coerce = coerce

    def output_roles(self):
        names = lambda keys: [f"{c}_{k}" for c in self.cols for k in keys]
        shown = [k for k in self.keys if k not in self.ignored]
        return {"tag": names(shown), "transient": names(self.ignored)}

    def coerced(self, col: str) -> Column:
        value = F.col(f"`{col}`")
        return F.coalesce(value.cast("string"), F.lit(" ")) if self.coerce else value

    def expressions(self, value: Column) -> dict[str, Column]:
        raise NotImplementedError

    def doprocess(self, values: pd.Series) -> list[dict]:
        raise NotImplementedError

    def transform(self, df, roles=None):
        for c in self.cols:
            if _overrides(self, MapToNamedTags, "doprocess"):
                df = self._python_columns(df, c)
            else:
                parts = self.expressions(self.coerced(c))
                df = df.withColumns({f"{c}_{k}": v for k, v in parts.items()})
        return df

    def _python_columns(self, df: DataFrame, col: str) -> DataFrame:
        if self.schema is None:
            raise ValueError(f"{self.name} needs a schema for the values its Python code returns")
        fields = T.StructType.fromDDL(self.schema).names
        doprocess = self.doprocess

        @F.pandas_udf(self.schema)
        def batch(values: pd.Series) -> pd.DataFrame:
            rows = doprocess(values)
            data = {f: pd.Series([r.get(f) for r in rows], dtype=object) for f in fields}
            return pd.DataFrame(data)

        packed = f"_{col}_named"
        df = df.withColumn(packed, batch(self.coerced(col)))
        return df.withColumns({f"{col}_{f}": F.col(packed)[f] for f in fields}).drop(packed)
