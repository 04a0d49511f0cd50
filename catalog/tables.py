"""Indexes, documents, roles, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import corpusloom as cl
from corpusloom.functions.nulls import documents
from corpusloom.session import shared_folder
from corpusloom.sources.index import latest_by_id, with_document_id
from corpusloom.streaming import streams

from .aggregates import SQL_STAMP, stamp
from .registry import query, table
from .texts import SCORED, corpus_sentiment


def scratch(spark, name: str) -> str:
    """A folder of its own for one run of a query, where all executors can write."""
    return f"{shared_folder(spark)}/queries/{name}-{uuid.uuid4().hex[:12]}"


@query(
    "json_docs",
    """
    SELECT event_id, event_type, CASE WHEN user_id > 40 THEN value END AS value,
      CAST(len(list_filter([CASE WHEN user_id > 40 THEN value END, value], lambda x: x IS NOT NULL)) AS BIGINT) AS n_values,
      user_id <= 40 AS pruned, event_type AS suggest
    FROM events
    """,
)
def json_docs(spark, sf):
    """Documents without the nulls and NaNs put in, read back field by field."""
    value = F.when(F.col("user_id") > 40, F.col("value")).when(F.col("user_id") > 20, F.lit(float("nan")))
    events = table(spark, sf, "events").select(
        "event_id", "event_type", value.alias("value"), F.array(value, F.col("value")).alias("both")
    )
    docs = documents(events, suggest="event_type")
    schema = "event_id long, event_type string, value double, both array<double>, suggest string"
    back = docs.select("doc", F.from_json("doc", schema).alias("d"))
    has_value = F.instr("doc", '"value":') > 0
    return back.select(
        "d.event_id", "d.event_type", "d.value", F.size("d.both").cast("long").alias("n_values"),
        (~has_value).alias("pruned"), "d.suggest",
    )


@query(
    "upsert_latest",
    """
    SELECT conv_id, turn, role, text FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1
    """,
)
def upsert_latest(spark, sf):
    return latest_by_id(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query(
    "document_ids",
    """
    SELECT CAST(doc_id AS VARCHAR) AS _id, doc_id,
      (SELECT count(DISTINCT (doc_id, text, lang, source, n_chars)) FROM documents) AS n_hashes FROM documents
    """,
)
def document_ids(spark, sf):
    """Ids from a column; and as many content hashes as there are different rows."""
    docs = table(spark, sf, "documents")
    hashes = with_document_id(docs).agg(F.countDistinct("_id").alias("n_hashes"))
    return with_document_id(docs, "doc_id").select("_id", "doc_id", hashes.scalar().alias("n_hashes"))


@query(
    "index_roundtrip",
    f"""
    SELECT event_id, event_type, strftime(ts, {SQL_STAMP}) AS ts, NULL::DOUBLE AS value FROM events
    UNION ALL SELECT event_id, event_type, strftime(ts, {SQL_STAMP}), value FROM events
    """,
)
def index_roundtrip(spark, sf):
    """Created, written, emptied, written again, appended to with a new column, read back."""
    roles = cl.Roles(tag=["event_type"], timestamp=["ts"], id="event_id")
    events = table(spark, sf, "events")
    index = cl.Index(spark, scratch(spark, "index"), "events")
    narrow = events.select("event_id", "event_type", "ts")
    index.create(narrow, roles)
    index.write(narrow, roles, "append")
    index.truncate()
    index.write(narrow, roles, "overwrite")
    index.write(events.select("event_id", "event_type", "ts", "value"), roles, "append")
    return index.read().select("event_id", "event_type", stamp("ts").alias("ts"), "value")


@query(
    "index_upsert",
    """
    SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 2 = 0 THEN reverse(text) ELSE text END AS text,
      CASE WHEN turn % 2 = 0 THEN role END AS role
    FROM conversations
    UNION ALL SELECT -conv_id - 1, 'new', NULL FROM conversations WHERE turn = 0
    """,
)
def index_upsert(spark, sf):
    """Rows written again by id, with a new column and new ids among them; a transient column stays out; one index dropped."""
    roles = cl.Roles(id="id", text=["text"], transient=["scratch"])
    talk = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    index = cl.Index(spark, scratch(spark, "upsert"), "talk")
    index.write(talk.select("id", "text", F.lit(1).alias("scratch")), roles)
    even = talk.where("turn % 2 = 0").select("id", F.reverse("text").alias("text"), "role")
    first = talk.where("turn = 0").select((-F.col("conv_id") - 1).alias("id"), F.lit("new").alias("text"))
    index.upsert(even, roles)
    index.upsert(first, roles)
    other = cl.Index(spark, index.root, "other")
    other.create(first, roles)
    other.drop()
    if other.exists() or "scratch" in index.read().columns:
        raise AssertionError("an index that was dropped, or a transient column, is there")
    return index.read().select("id", "text", "role")


@query(
    "index_bucket_upsert",
    """
    SELECT event_id, event_type, value * CASE WHEN event_id % 100 = 7 THEN -2 ELSE 1 END AS value,
      CASE WHEN event_id % 100 = 7 THEN 'again' END AS note
    FROM events
    UNION ALL SELECT -event_id - 1, 'new', value, 'again' FROM events WHERE event_id % 100 = 8
    """,
)
def index_bucket_upsert(spark, sf):
    """One in a hundred rows written again, each twice, and as many new ones, into an index of 16 buckets."""
    roles = cl.Roles(tag=["event_type"], id="event_id")
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    index = cl.Index(spark, scratch(spark, "buckets"), "events", buckets=16)
    index.write(events, roles)
    noted = lambda df, value: df.select("event_id", "event_type", value.alias("value"), F.lit("again").alias("note"))
    again = events.where("event_id % 100 = 7")
    new = events.where("event_id % 100 = 8").select((-F.col("event_id") - 1).alias("event_id"), F.lit("new").alias("event_type"), "value")
    batch = noted(again, F.col("value") * -1).withColumn("at", F.lit(1)).union(noted(again, F.col("value") * -2).withColumn("at", F.lit(2)))
    index.upsert(batch.union(noted(new, F.col("value")).withColumn("at", F.lit(1))), roles, version="at")
    return index.read().select("event_id", "event_type", "value", "note")


@query(
    "index_append_widened",
    """
    SELECT event_id AS id, CAST(user_id AS VARCHAR) AS code, CAST(user_id AS DOUBLE) AS size,
      [CAST(user_id AS BIGINT)] AS both, 'old' AS note FROM events
    UNION ALL SELECT o_orderkey, CAST(o_totalprice AS VARCHAR), o_totalprice, [CAST(o_orderkey AS BIGINT)], NULL FROM orders
    UNION ALL SELECT c_custkey, c_name, NULL, NULL, NULL FROM customer
    """,
)
def index_append_widened(spark, sf):
    """Three tables whose columns drift apart: whole numbers, then doubles, then texts, and a column that goes."""
    index = cl.Index(spark, scratch(spark, "widened"), "all")
    user = F.col("user_id").cast("int")
    index.write(table(spark, sf, "events").select(
        F.col("event_id").cast("int").alias("id"), user.alias("code"), user.alias("size"), F.array(user).alias("both"), F.lit("old").alias("note")
    ))
    index.write(table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("long").alias("id"), F.col("o_totalprice").alias("code"), F.col("o_totalprice").alias("size"),
        F.array(F.col("o_orderkey").cast("long")).alias("both"),
    ), if_exists="append")
    index.write(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("code")), if_exists="append")
    return index.read()


@query(
    "index_json_typed",
    f"SELECT event_id, strftime(ts, {SQL_STAMP}) AS ts, value, 'timestamp_ntz' AS kind, NULL::BIGINT AS nothing FROM events",
)
def index_json_typed(spark, sf):
    """A JSON index gives back types and columns as they were written, one that is null throughout too."""
    index = cl.Index(spark, scratch(spark, "json"), "events", "json")
    index.write(table(spark, sf, "events").select("event_id", "ts", "value", F.lit(None).cast("long").alias("nothing")))
    out = index.read()
    kind = out.schema["ts"].dataType.simpleString()
    return out.select("event_id", stamp("ts").alias("ts"), "value", F.lit(kind).alias("kind"), "nothing")


@query(
    "union_by_name",
    """
    SELECT event_id AS id, event_type AS kind, value, NULL::VARCHAR AS priority FROM events
    UNION ALL SELECT o_orderkey, NULL, o_totalprice, o_orderpriority FROM orders
    """,
)
def union_by_name(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("priority")
    )
    return cl.union_by_name(events, orders).select("id", "kind", "value", "priority")


@query(
    "typed_columns",
    f"""
    SELECT c_custkey, CASE WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 THEN lat END AS lat,
      CASE WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 THEN lon END AS lon,
      CASE WHEN c_nationkey > 3 THEN strftime(TIMESTAMP '2020-01-01' + to_days(c_nationkey), {SQL_STAMP}) END AS seen
    FROM (SELECT c_custkey, c_nationkey, CAST(c_nationkey * 5 AS DOUBLE) AS lat, CAST(c_custkey % 400 - 200 AS DOUBLE) AS lon
      FROM customer)
    """,
)
def typed_columns(spark, sf):
    """Texts turned into points and instants by their roles; bad ones become null."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("c_nationkey")).cast("string")
    customers = table(spark, sf, "customer").select(
        "c_custkey",
        F.concat_ws(",", F.col("c_nationkey") * 5, F.col("c_custkey") % 400 - 200).alias("point"),
        F.when(F.col("c_nationkey") > 3, day).otherwise("unknown").alias("seen"),
    )
    typed = cl.Roles(geopoint=["point"], timestamp=["seen"]).typed(customers)
    return typed.select("c_custkey", "point.lat", "point.lon", stamp("seen").alias("seen"))


@query(
    "stream_date_histogram",
    f"SELECT strftime(time_bucket(INTERVAL 2 hours, ts), {SQL_STAMP}) AS key, count(*) AS n FROM events GROUP BY 1",
)
def stream_date_histogram(spark, sf):
    folder = scratch(spark, "live")
    # The replayed table may hold its rows in any order: nothing is too late.
    counts = streams.live_date_histogram(
        streams.stream_table(spark, f"{sf.rstrip('/')}/events.parquet"), "ts", late="10000 days"
    )
    streams.write_live(counts, folder + "/out", folder + "/checkpoint").awaitTermination()
    return streams.read_live(spark, folder + "/out").select(stamp("key").alias("key"), "n")


@query(
    "stream_top_terms",
    f"""
    WITH c AS (SELECT date_trunc('day', ts) AS day, event_type AS term, count(*) AS n FROM events GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, term) AS rank FROM c)
    SELECT strftime(day, {SQL_STAMP}) AS key, term, n, rank FROM r WHERE rank <= 3
    """,
)
def stream_top_terms(spark, sf):
    folder = scratch(spark, "terms")
    events = streams.stream_table(spark, f"{sf.rstrip('/')}/events.parquet")
    counts = streams.live_terms(events, "ts", F.array("event_type"), late="10000 days")
    streams.write_live(counts, folder + "/out", folder + "/checkpoint").awaitTermination()
    top = streams.top_terms(streams.read_live(spark, folder + "/out"), 3)
    return top.select(stamp("key").alias("key"), "term", "n", F.col("rank").cast("long").alias("rank"))


@query(
    "stream_enrich",
    SCORED.replace("FROM documents", "FROM (SELECT *, conv_id * 1000 + turn AS doc_id FROM conversations)")
    + """, s AS (SELECT doc_id, sum(CAST(v AS DOUBLE)) AS s FROM scored GROUP BY doc_id)
    SELECT conv_id, turn, round(coalesce(s / sqrt(s * s + 15), 0.0), 6) AS sentiment,
      array_to_string(regexp_extract_all(text, '[A-Z][a-z]+'), '|') AS names
    FROM conversations LEFT JOIN s ON doc_id = conv_id * 1000 + turn
    """,
)
def stream_enrich(spark, sf):
    """The stages of a batch, on a stream, into an index folder."""
    folder = scratch(spark, "enrich")
    p = cl.Pipeline("talk", text_cols=["text"], tag_cols=["role"])
    p += cl.RegexTag(r"[A-Z][a-z]+", "text", "names")
    p += corpus_sentiment()
    talk = streams.stream_table(spark, f"{sf.rstrip('/')}/conversations.parquet")
    streams.enrich_stream(p, talk, folder + "/out", folder + "/checkpoint").awaitTermination()
    out = spark.read.parquet(folder + "/out")
    return out.select("conv_id", "turn", F.round("sentiment", 6).alias("sentiment"), F.array_join("names", "|").alias("names"))


def _in_files(spark, folder: str, df, file):
    """The rows in files of their own, to be taken one by one in the order of ``file``."""
    numbers = sorted(r[0] for r in df.select(file.alias("f")).distinct().collect())
    for n in numbers:
        df.where(file == n).coalesce(1).write.mode("append").parquet(folder)
    return streams.stream_table(spark, folder, maxFilesPerTrigger=1)


# Events come in four files by time, but of one in seven the time is older by as many days as the number of its file.
_FILES_SQL = """
    WITH ends AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
    place AS (SELECT event_id, event_type, ts, 1 + 4 * (epoch_us(ts) - lo) // (hi - lo + 1) AS f FROM events, ends),
    e AS (SELECT event_type, f, CASE WHEN event_id % 7 = 3 THEN ts - to_days(CAST(f AS INTEGER)) ELSE ts END AS ts FROM place)
"""


@query(
    "stream_windows_close",
    _FILES_SQL
    + f""",
    last AS (SELECT f, max(ts) AS last FROM e GROUP BY f),
    mark AS (SELECT a.f, max(b.last) - INTERVAL 1 hour AS mark FROM last a LEFT JOIN last b ON b.f < a.f GROUP BY a.f),
    w AS (
      SELECT time_bucket(INTERVAL 2 hours, ts) AS key, event_type, coalesce(time_bucket(INTERVAL 2 hours, ts) + INTERVAL 2 hours <= mark, false) AS late
      FROM e JOIN mark USING (f)
    )
    SELECT strftime(key, {SQL_STAMP}) AS key, event_type, count(*) FILTER (WHERE NOT late) AS n, count(*) FILTER (WHERE late) AS n_late
    FROM w WHERE key + INTERVAL 2 hours <= (SELECT max(last) - INTERVAL 1 hour FROM last) GROUP BY 1, 2
    """,
)
def stream_windows_close(spark, sf):
    """Four triggers, rows of days ago in each: windows close after an hour, what comes later is counted apart."""
    folder = scratch(spark, "windows")
    events = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    lo, hi = (events.agg(f("us")).scalar() for f in (F.min, F.max))
    events = events.withColumn("f", (1 + F.floor(4 * (F.col("us") - lo) / (hi - lo + 1))).cast("int"))
    older = F.when(F.col("event_id") % 7 == 3, F.col("ts") - F.make_dt_interval(days=F.col("f"))).otherwise(F.col("ts"))
    stream = _in_files(spark, folder + "/in", events.select("event_type", "f", older.alias("ts")), F.col("f"))
    streams.write_windows(stream, "ts", folder + "/out", folder + "/checkpoint", by=["event_type"], most_folders=2).awaitTermination()
    out = streams.read_windows(spark, folder + "/out")
    return out.select(stamp("key").alias("key"), "event_type", "n", "n_late")


@query(
    "stream_upsert",
    """
    SELECT conv_id, turn, role, array_to_string(regexp_extract_all(text, '[A-Z][a-z]+'), '|') AS names FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1
    """,
)
def stream_upsert(spark, sf):
    """Turns come in any order, in three triggers; of each conversation the index has the last one."""
    folder = scratch(spark, "stream_upsert")
    talk = table(spark, sf, "conversations")
    stream = _in_files(spark, folder + "/in", talk, F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)))
    p = cl.Pipeline("talk", text_cols=["text"], id_col="conv_id", root=folder, buckets=4)
    p += cl.RegexTag(r"[A-Z][a-z]+", "text", "names")
    streams.upsert_stream(p, stream, folder + "/checkpoint", version="turn").awaitTermination()
    return p.index(spark).read().select("conv_id", "turn", "role", F.array_join("names", "|").alias("names"))
