"""Dropping nulls and NaNs, at every depth, before a row becomes a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def pruned(col: Column, data_type: T.DataType) -> Column:
    """NaN becomes null; nulls leave lists; nested values are treated alike."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    if isinstance(data_type, T.ArrayType):
        item = data_type.elementType
        if _may_hold_nan(item):
            col = F.transform(col, lambda x: pruned(x, item))
        return F.filter(col, lambda x: x.isNotNull())
    if isinstance(data_type, T.MapType):
        value = data_type.valueType
        if _may_hold_nan(value):
            col = F.transform_values(col, lambda _, v: pruned(v, value))
        return F.map_filter(col, lambda _, v: v.isNotNull())
    if isinstance(data_type, T.StructType):
        parts = [pruned(col[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    return col


def _may_hold_nan(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType, T.ArrayType, T.MapType, T.StructType))


def without_nan(col: Column) -> Column:
    """A number column as double with NaN turned into null."""
    number = col.cast("double")
    return F.when(~F.isnan(number), number)


def prune(df: DataFrame) -> DataFrame:
    return df.select(*[pruned(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def documents(df: DataFrame, suggest: str | None = None, out_col: str = "doc") -> DataFrame:
    """One JSON document per row, without nulls and NaNs, with the suggest field copied."""
    clean = prune(df)
    if suggest and suggest in df.columns:
        clean = clean.withColumn("suggest", F.col(suggest))
    names = [F.col(f"`{c}`") for c in clean.columns]
    return clean.select(F.to_json(F.struct(*names), {"ignoreNullFields": "true"}).alias(out_col))
