"""Searches: saved search, time ranges, completion, term match."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpusloom as cl
from corpusloom.operators import search

from .aggregates import SQL_STAMP, stamp
from .registry import query, sql_words, table, texts
from .tables import scratch
from .texts import sql_terms


@query("saved_search", "SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn")
def saved_search(spark, sf):
    return search.saved_search(table(spark, sf, "conversations"), ["conv_id", "turn", "role", "text"], ["conv_id", "turn"])


@query(
    "time_range",
    f"""
    SELECT event_id, strftime(ts, {SQL_STAMP}) AS ts FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-05 12:00:00' AND TIMESTAMP '2024-01-09 00:00:00'
    """,
)
def time_range(spark, sf):
    hits = search.time_range(table(spark, sf, "events"), "ts", "2024-01-05 12:00:00", "2024-01-09 00:00:00")
    return hits.select("event_id", stamp("ts").alias("ts"))


@query(
    "time_range_relative",
    """
    SELECT event_id FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-09 00:00:00' - INTERVAL 15 MINUTES AND TIMESTAMP '2024-01-09 00:00:00'
    """,
)
def time_range_relative(spark, sf):
    return search.relative_range(table(spark, sf, "events"), "ts", "15 minutes", "2024-01-09 00:00:00").select("event_id")


@query(
    "suggest_prefix",
    """
    SELECT p_name AS suggestion, count(*) AS n FROM part WHERE starts_with(lower(p_name), 're') GROUP BY p_name
    ORDER BY n DESC, suggestion LIMIT 10
    """,
)
def suggest_prefix(spark, sf):
    return search.suggest_prefix(table(spark, sf, "part"), "p_name", "Re", 10)


@query(
    "suggest_stored",
    """
    SELECT p_name AS suggestion, count(*) AS n FROM part WHERE starts_with(lower(p_name), 're') GROUP BY p_name
    ORDER BY n DESC, suggestion LIMIT 10
    """,
)
def suggest_stored(spark, sf):
    """The same from stored values, by a range of keys."""
    folder = scratch(spark, "completions")
    search.write_completions(table(spark, sf, "part"), "p_name", folder)
    return search.stored_completions(spark, folder, "Re", 10)


@query(
    "term_match",
    f"""
    WITH t AS (SELECT doc_id, text, {sql_terms(sql_words())} AS terms FROM documents)
    SELECT doc_id, text AS marked FROM t WHERE list_has_all(terms, ['der', 'und'])
    """,
)
def term_match(spark, sf):
    """All of the terms; taking the marks off again gives the text back."""
    docs = texts(spark, sf)
    hits = search.match_terms(docs, "text", ["der", "und"], "and", mark="marked")
    plain = F.replace(F.replace("marked", F.lit("<em>")), F.lit("</em>"))
    return hits.select("doc_id", plain.alias("marked"))


@query(
    "term_match_any",
    f"""
    WITH t AS (SELECT doc_id, {sql_terms(sql_words())} AS terms FROM documents)
    SELECT doc_id FROM t WHERE list_has_any(terms, ['thon', 'los'])
    """,
)
def term_match_any(spark, sf):
    return search.match_terms(texts(spark, sf), "text", ["thon", "los"]).select("doc_id")


@query(
    "term_highlight",
    r"""
    SELECT doc_id, regexp_replace(text, '(?i)\b(der|und)\b', '<em>\1</em>', 'g') AS marked
    FROM (SELECT doc_id, translate(text, 'éèêçñóíáüäößÉÈÊÇÑÓÍÁÜÄÖ’', 'eeecnoiauaosEEECNOIAUAO ') AS text FROM documents)
    """,
)
def term_highlight(spark, sf):
    """Marks on texts reduced to plain letters, where SQL knows word boundaries too."""
    plain = F.translate("text", "éèêçñóíáüäößÉÈÊÇÑÓÍÁÜÄÖ’", "eeecnoiauaosEEECNOIAUAO ")
    docs = texts(spark, sf).select("doc_id", plain.alias("text"))
    return docs.select("doc_id", search.highlight(F.col("text"), ["der", "und"]).alias("marked"))


@query(
    "term_postings",
    f"""
    SELECT doc_id, term, count(*) AS tf FROM (
      SELECT doc_id, unnest({sql_terms(sql_words())}) AS term FROM documents) GROUP BY doc_id, term
    """,
)
def term_postings(spark, sf):
    return search.postings(texts(spark, sf), "doc_id", "text").select("doc_id", "term", "tf")


@query("head_rows", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def head_rows(spark, sf):
    docs = texts(spark, sf).select("doc_id", "n_chars")
    return cl.head(docs, 50, [F.desc("n_chars"), "doc_id"])
