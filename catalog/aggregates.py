"""Panels: bars, clouds, histograms, ranges, whole dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpusloom as cl
from corpusloom.plans import panels as pn

from .registry import query, sql_words, table, texts
from .texts import LONG_WORD, SCORED, corpus_sentiment, sql_terms

STAMP = "yyyy-MM-dd HH:mm:ss"
SQL_STAMP = "'%Y-%m-%d %H:%M:%S'"


def stamp(col):
    return F.date_format(col, STAMP)


SQL_CLOUD = f"""
    SELECT key, count(*) AS n FROM (
      SELECT unnest(list_distinct({sql_terms(sql_words())})) AS key FROM documents)
    GROUP BY key ORDER BY n DESC, key LIMIT 20
"""


@query("tag_cloud_top20", SQL_CLOUD)
def tag_cloud_top20(spark, sf):
    return pn.tag_cloud(texts(spark, sf), cl.TagCloud("text"))


@query(
    "terms_bar_scalar",
    """
    SELECT * FROM (SELECT 'event_type' AS field, event_type AS key, count(*) AS n FROM events
      GROUP BY event_type ORDER BY n DESC, key LIMIT 20)
    UNION ALL
    SELECT * FROM (SELECT 'source' AS field, source AS key, count(*) AS n FROM documents
      GROUP BY source ORDER BY n DESC, key LIMIT 20)
    """,
)
def terms_bar_scalar(spark, sf):
    bars = [("events", "event_type"), ("documents", "source")]
    tables = [
        pn.terms(table(spark, sf, t), cl.HorizontalBar(c)).select(F.lit(c).alias("field"), "key", "n") for t, c in bars
    ]
    return tables[0].unionByName(tables[1])


@query(
    "terms_bar_array",
    f"""
    SELECT key, count(*) AS n FROM (
      SELECT unnest(list_distinct(regexp_extract_all(text, '{LONG_WORD}'))) AS key FROM documents)
    GROUP BY key ORDER BY n DESC, key LIMIT 20
    """,
)
def terms_bar_array(spark, sf):
    tagged = cl.RegexTag(LONG_WORD, "text", "long_words", dialect="java").transform(texts(spark, sf))
    return pn.terms(tagged, cl.HorizontalBar("long_words"))


@query(
    "histogram_fixed",
    "SELECT round(floor(value / 0.1) * 0.1, 6) AS key, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
)
def histogram_fixed(spark, sf):
    out = pn.histogram(table(spark, sf, "events"), cl.Histogram("value", interval=0.1))
    return out.select(F.round("key", 6).alias("key"), "n")


@query(
    "histogram_auto",
    """
    WITH r AS (SELECT (max(o_totalprice) - min(o_totalprice)) / 100 AS i FROM orders)
    SELECT round(floor(o_totalprice / i) * i, 4) AS key, count(*) AS n FROM orders, r GROUP BY 1
    """,
)
def histogram_auto(spark, sf):
    orders = table(spark, sf, "orders")
    interval = pn.histogram_interval(*pn.ranges(orders, ["o_totalprice"])["o_totalprice"])
    out = pn.histogram(orders, cl.Histogram("o_totalprice"), interval)
    return out.select(F.round("key", 4).alias("key"), "n")


@query(
    "histogram_decimal",
    """
    WITH o AS (SELECT CAST(o_totalprice AS DECIMAL(12, 2)) AS price FROM orders),
    r AS (SELECT (CAST(max(price) AS DOUBLE) - CAST(min(price) AS DOUBLE)) / 100 AS i FROM o)
    SELECT round(floor(CAST(price AS DOUBLE) / i) * i, 4) AS key, count(*) AS n FROM o, r GROUP BY 1
    """,
)
def histogram_decimal(spark, sf):
    """An automatic interval from the range of a decimal column."""
    orders = table(spark, sf, "orders").select(F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    interval = pn.histogram_interval(*pn.ranges(orders, ["price"])["price"])
    return pn.histogram(orders, cl.Histogram("price"), interval).select(F.round("key", 4).alias("key"), "n")


@query(
    "histogram_gap_filled",
    """
    WITH c AS (SELECT CAST(floor(p_size / 0.25) AS BIGINT) AS k, count(*) AS n FROM part GROUP BY 1),
    g AS (SELECT unnest(generate_series((SELECT min(k) FROM c), (SELECT max(k) FROM c))) AS k)
    SELECT k * 0.25::DOUBLE AS key, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (k)
    """,
)
def histogram_gap_filled(spark, sf):
    return pn.histogram(table(spark, sf, "part"), cl.Histogram("p_size", interval=0.25), fill=True).select("key", "n")


@query(
    "histogram_negative",
    "SELECT floor(s_acctbal / 500) * 500.0::DOUBLE AS key, count(*) AS n FROM supplier GROUP BY 1",
)
def histogram_negative(spark, sf):
    return pn.histogram(table(spark, sf, "supplier"), cl.Histogram("s_acctbal", interval=500)).select("key", "n")


@query(
    "date_histogram_2h",
    f"""
    SELECT strftime(time_bucket(INTERVAL 2 hours, ts), {SQL_STAMP}) AS key, count(*) AS n FROM events GROUP BY 1
    """,
)
def date_histogram_2h(spark, sf):
    out = pn.date_histogram(table(spark, sf, "events"), cl.DateHistogram("ts", "2 hours"))
    return out.select(stamp("key").alias("key"), "n")


@query(
    "date_histogram_auto",
    f"""
    WITH r AS (SELECT date_diff('month', min(o_orderdate), max(o_orderdate)) + 1 AS months FROM orders)
    SELECT strftime(CASE WHEN months <= 100 THEN date_trunc('month', o_orderdate)
      ELSE date_trunc('year', o_orderdate) END, {SQL_STAMP}) AS key, count(*) AS n
    FROM orders, r GROUP BY 1
    """,
)
def date_histogram_auto(spark, sf):
    out = pn.date_histogram(table(spark, sf, "orders"), cl.DateHistogram("o_orderdate"))
    return out.select(stamp("key").alias("key"), "n")


@query(
    "column_ranges",
    f"""
    SELECT (SELECT min(value) FROM events) AS value_min, (SELECT max(value) FROM events) AS value_max,
      (SELECT strftime(min(ts), {SQL_STAMP}) FROM events) AS ts_min,
      (SELECT strftime(max(ts), {SQL_STAMP}) FROM events) AS ts_max
    """,
)
def column_ranges(spark, sf):
    out = pn.column_ranges(table(spark, sf, "events"), ["value", "ts"])
    return out.select("value_min", "value_max", stamp("ts_min").alias("ts_min"), stamp("ts_max").alias("ts_max"))


@query(
    "panel_metric",
    """
    SELECT event_type AS key, count(*) AS n, round(avg(value), 6) AS avg FROM events
    WHERE event_type IS NOT NULL GROUP BY event_type
    """,
)
def panel_metric(spark, sf):
    out = pn.metric_by(table(spark, sf, "events"), "event_type", "avg", "value")
    return out.select("key", "n", F.round("avg", 6).alias("avg"))


def _flat(table):
    """A dashboard table with printable columns."""
    return table.select("panel", "key", F.round("value", 4).alias("value"), stamp("ts").alias("ts"), "n")


SQL_DAYS = "date_diff('second', TIMESTAMP '1970-01-01', ts)"


@query(
    "dashboard_metrics",
    """
    SELECT 'event_type' AS panel, event_type AS key, count(*) AS n, round(avg(value), 6) AS metric FROM events GROUP BY event_type
    UNION ALL
    SELECT * FROM (SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) AS n, round(max(value), 6) FROM events
      GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5)
    """,
)
def dashboard_metrics(spark, sf):
    """Bars with a metric of another column beside the count."""
    bars = [
        cl.HorizontalBar("event_type", metric="avg", metric_col="value"),
        cl.HorizontalBar("user_id", 5, metric="max", metric_col="value"),
    ]
    panels = cl.dashboard(table(spark, sf, "events"), cl.Roles(), extra=bars)
    rows = [
        panels[p.field].select(
            F.lit(p.field).alias("panel"), F.col("key").cast("string").alias("key"), "n", F.round(p.metric, 6).alias("metric")
        )
        for p in bars
    ]
    return rows[0].unionByName(rows[1])


@query(
    "dashboard_time_range",
    f"""
    WITH e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 00:00:00'),
    r AS (SELECT (max(value) - min(value)) / 100 AS i,
      CASE WHEN epoch(max(ts)) // 3600 - epoch(min(ts)) // 3600 + 1 <= 100 THEN 3600 ELSE 7200 END AS s FROM e)
    SELECT 'value' AS panel, NULL::VARCHAR AS key, round(floor(value / i) * i, 4) AS value, NULL::VARCHAR AS ts, count(*) AS n
      FROM e, r GROUP BY 3
    UNION ALL
    SELECT 'ts', NULL, NULL, strftime(to_timestamp({SQL_DAYS} - {SQL_DAYS} % s) AT TIME ZONE 'UTC', {SQL_STAMP}), count(*) FROM e, r GROUP BY 4
    UNION ALL SELECT 'event_type', event_type, NULL, NULL, count(*) FROM e GROUP BY event_type
    """,
)
def dashboard_time_range(spark, sf):
    """The panels of four days; their buckets follow from these days, and the filter reaches the scan."""
    roles = cl.Roles(tag=["event_type"], num=["value"], date="ts")
    return _flat(
        cl.dashboard_table(
            table(spark, sf, "events"), roles, time_from="2024-01-05 00:00:00", time_to="2024-01-09 00:00:00"
        )
    )




@query(
    "dashboard_events",
    f"""
    WITH r AS (SELECT (max(value) - min(value)) / 100 AS i,
      CASE WHEN epoch(max(ts)) // 7200 - epoch(min(ts)) // 7200 + 1 <= 100 THEN 7200 ELSE 43200 END AS s FROM events)
    SELECT 'value' AS panel, NULL::VARCHAR AS key, round(floor(value / i) * i, 4) AS value, NULL::VARCHAR AS ts, count(*) AS n
      FROM events, r GROUP BY 3
    UNION ALL
    SELECT 'ts', NULL, NULL, strftime(to_timestamp({SQL_DAYS} - {SQL_DAYS} % s) AT TIME ZONE 'UTC', {SQL_STAMP}), count(*)
      FROM events, r GROUP BY 4
    UNION ALL
    SELECT * FROM (SELECT 'event_type', event_type, NULL, NULL, count(*) AS n FROM events GROUP BY event_type
      ORDER BY n DESC, event_type LIMIT 20)
    """,
)
def dashboard_events(spark, sf):
    roles = cl.Roles(tag=["event_type"], num=["value"], date="ts")
    return _flat(cl.dashboard_table(table(spark, sf, "events"), roles))


@query(
    "dashboard_corpus",
    SCORED
    + f""", s AS (SELECT doc_id, sum(CAST(v AS DOUBLE)) AS s FROM scored GROUP BY doc_id),
    d AS (SELECT doc_id, coalesce(s / sqrt(s * s + 15), 0.0) AS sentiment FROM documents LEFT JOIN s USING (doc_id)),
    r AS (SELECT (max(sentiment) - min(sentiment)) / 100 AS i FROM d)
    SELECT 'sentiment' AS panel, NULL::VARCHAR AS key, round(floor(sentiment / i) * i, 4) AS value, count(*) AS n
      FROM d, r GROUP BY 3
    UNION ALL SELECT * FROM (SELECT 'lang', lang, NULL, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 20)
    UNION ALL SELECT 'text', key, NULL, n FROM ({SQL_CLOUD})
    UNION ALL SELECT * FROM (SELECT 'long', unnest(list_distinct(regexp_extract_all(text, '{LONG_WORD}'))) AS key, NULL, count(*) AS n
      FROM documents GROUP BY key ORDER BY n DESC, key LIMIT 20)
    """,
)
def dashboard_corpus(spark, sf):
    """Stages and default panels together: tags, cloud, sentiment histogram, from one pass."""
    p = cl.Pipeline("corpus", text_cols=["text"], tag_cols=["lang"], id_col="doc_id")
    p += cl.RegexTag(LONG_WORD, "text", "long", dialect="java")
    p += corpus_sentiment()
    return _flat(p.dashboard_table(p.transform(texts(spark, sf)))).drop("ts")


@query(
    "dashboard_extra_panels",
    """
    SELECT 'c_mktsegment' AS panel, c_mktsegment AS key, count(*) AS n FROM customer GROUP BY c_mktsegment
    UNION ALL
    SELECT * FROM (SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) AS k, count(*) AS n FROM customer
      GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 20)
    """,
)
def dashboard_extra_panels(spark, sf):
    """One lazy table per panel; a bare column name is a bar panel."""
    customers = table(spark, sf, "customer")
    panels = cl.dashboard(customers, cl.Roles(tag=["c_mktsegment"]), extra=["c_nationkey"])
    parts = [d.select(F.lit(name).alias("panel"), F.col("key").cast("string").alias("key"), "n") for name, d in panels.items()]
    return parts[0].unionByName(parts[1])
