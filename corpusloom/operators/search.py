"""Simple searches over an enriched table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import highlight
from .analysis import Analyzer


def saved_search(df: DataFrame, columns: Sequence[str], sort: Sequence[str | Column] = ()) -> DataFrame:
    """All rows, chosen columns, in a chosen order."""
    out = df.select(*columns)
    return out.orderBy(*sort) if sort else out


def time_range(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """Rows between two instants, both included; reaches the scan as a filter.

    Bounds are literals of the column's own type: a cast on the column would
    keep the filter from the scan.
    """
    kind = df.schema[col].dataType.simpleString()
    if start is not None:
        df = df.where(F.col(col) >= F.lit(str(start)).cast(kind))
    if end is not None:
        df = df.where(F.col(col) <= F.lit(str(end)).cast(kind))
    return df


def relative_range(df: DataFrame, col: str, back: str = "15 minutes", now=None) -> DataFrame:
    """Rows of the time ``back`` before ``now`` (by default the clock of the job)."""
    kind = df.schema[col].dataType.simpleString()
    end = F.current_timestamp().cast(kind) if now is None else F.lit(str(now)).cast(kind)
    return df.where((F.col(col) >= end - F.expr(f"INTERVAL {back}")) & (F.col(col) <= end))


def suggest_prefix(df: DataFrame, col: str, prefix: str, size: int = 10) -> DataFrame:
    """The most frequent values that begin with ``prefix``, ignoring case."""
    hits = df.where(F.startswith(F.lower(col), F.lit(prefix.lower())))
    counted = hits.groupBy(F.col(col).alias("suggestion")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "suggestion").limit(size)


def write_completions(df: DataFrame, col: str, path: str) -> None:
    """Store the values of a column with their counts, sorted by their lowercase form, for :func:`stored_completions`.

    Values are counted before they are shuffled, then dealt by range: what
    begins alike lies together, in few files and few row groups.
    """
    value = F.col(f"`{col}`").cast("string")
    counted = df.select(value.alias("suggestion")).where("suggestion IS NOT NULL").groupBy("suggestion").agg(F.count(F.lit(1)).alias("n"))
    keyed = counted.withColumn("key", F.lower("suggestion"))
    keyed.repartitionByRange("key", "suggestion").sortWithinPartitions("key", "suggestion").write.mode("overwrite").parquet(path)


def stored_completions(spark: SparkSession, path: str, prefix: str, size: int = 10) -> DataFrame:
    """What :func:`suggest_prefix` gives, from stored values: a range of keys that is pushed down to the scan."""
    stored, low = spark.read.parquet(path), prefix.lower()
    hits = stored.where(F.col("key") >= low) if low else stored
    # The first text after all that begin with the prefix: its last sign that has a next one counted up.
    while low:
        after = ord(low[-1]) + 1
        after = 0xE000 if 0xD800 <= after < 0xE000 else after
        if after <= 0x10FFFF:
            hits = hits.where(F.col("key") < low[:-1] + chr(after))
            break
        low = low[:-1]
    return hits.orderBy(F.desc("n"), "suggestion").limit(size).select("suggestion", "n")


def match_terms(
    df: DataFrame,
    col: str,
    query: Sequence[str],
    operator: str = "or",
    analyzer: Analyzer | None = None,
    id_col: str | None = None,
    mark: str | None = None,
) -> DataFrame:
    """Rows whose analyzed text has any (``or``) or all (``and``) of the terms.

    ``query`` are analyzed terms, see :meth:`Analyzer.query_terms`. ``mark``
    names a column to add with the matches highlighted.
    """
    if operator not in ("or", "and"):
        raise ValueError("operator is 'or' or 'and'")
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(query)])
    out = (analyzer or Analyzer()).add_terms(df, col, "_terms", id_col)
    hit = F.arrays_overlap("_terms", wanted) if operator == "or" else F.size(F.array_except(wanted, F.col("_terms"))) == 0
    out = out.where(hit).drop("_terms")
    return out.withColumn(mark, highlight(F.col(col), list(query))) if mark else out


def postings(df: DataFrame, id_col: str, col: str, analyzer: Analyzer | None = None) -> DataFrame:
    """One row per term and document with the term's frequency there.

    A document is one row, so its terms are counted inside the row: sorted,
    then measured run by run. Nothing is shuffled.
    """
    out = (analyzer or Analyzer()).add_terms(df.select(id_col, col), col, "_terms", id_col)
    out = out.select(id_col, F.sort_array("_terms").alias("_terms"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("_terms"))
    first = F.zip_with("_terms", F.slice(before, F.lit(1), F.size("_terms")), lambda t, b: b.isNull() | (t != b))
    places = F.filter(F.transform(first, lambda new, i: F.when(new, i)), lambda i: i.isNotNull())
    out = out.withColumn("_starts", places)
    ends = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.size("_terms")))
    # The size test keeps both arrays columns of their own.
    runs = F.when(
        (F.size("_terms") > 0) & (F.size("_starts") > 0),
        F.zip_with(
            "_starts",
            ends,
            lambda a, b: F.struct(F.get(F.col("_terms"), a).alias("term"), (b - a).cast("long").alias("tf")),
        ),
    )
    return out.select(id_col, F.inline(runs))
