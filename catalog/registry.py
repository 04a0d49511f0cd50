"""Where queries and their SQL are kept, and SQL fragments several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.tables import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` its rows are tested on fixtures only."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Tasks that texts are dealt over. Whoever runs the queries may set it; the test tables are one row group each.
PARTITIONS: int | None = None


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, in the pieces it is stored in unless ``PARTITIONS`` is set."""
    return dealt(table(spark, sf_dir, name), PARTITIONS)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def sql_values(rows, columns: str) -> str:
    cell = lambda v: quoted(v) if isinstance(v, str) else "NULL" if v is None else repr(v)
    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({columns})"


SPACE = r"[ \t\r\n\f]"
WORD = quoted(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*")
TOKEN = quoted(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*|[^ \t\r\n\f\p{L}\p{N}]|[ \t\r\n\f]+")
SENTENCE = quoted(r"(?s).+?(?:[.!?]+(?:[ \t\r\n\f]+|\z)|\z)")


def sql_words(text: str = "text") -> str:
    return f"regexp_extract_all(lower({text}), {WORD})"


def sql_sentences(text: str = "text") -> str:
    return f"regexp_extract_all({text}, {SENTENCE})"


def sql_tokens(text: str = "text") -> str:
    """Tokens of all sentences in order."""
    one = f"list_filter(regexp_extract_all(s, {TOKEN}), lambda t, i: t <> ' ' OR i = 1)"
    return f"flatten(list_transform({sql_sentences(text)}, lambda s: {one}))"
