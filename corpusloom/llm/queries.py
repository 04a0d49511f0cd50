"""The registered queries ``opN_<name>`` over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- 1: line dedup -----------------------------------------------------------

LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM {docs}
), shown AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line FROM lines
), win AS (
  SELECT doc_id, pos AS start, lead(pos, 2) OVER w AS stop,
         line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM shown WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, start, stop, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, start) AS nth
  FROM win WHERE stop IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS pos FROM ranked WHERE nth > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL) AS text,
         count(c.pos) AS n_lines_removed
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos
  GROUP BY l.doc_id
)
"""


@query(
    "op1_line_dedup",
    LINE_DEDUP_SQL.format(docs="documents")
    + """
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
           CAST(coalesce(k.n_lines_removed, 0) AS INTEGER) AS n_lines_removed
    FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
)
def op1_line_dedup(spark, sf):
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))


# --- 2: secret scans ---------------------------------------------------------


def _secret_sql() -> str:
    from . import secret_scan as s

    quote = lambda p: "'" + p.replace("'", "''") + "'"
    holds = {
        "assign": f"length(regexp_extract(m, {quote(s.PATTERNS['assign'])}, 1)) >= {s.ASSIGN_LEAST}",
        "opaque": " AND ".join(f"regexp_matches(m, '{p}')" for p in s.OPAQUE_HAS),
    }
    kinds = " UNION ALL ".join(
        f"""
        SELECT doc_id, {n} AS kind, s_end - length(m) AS s_start, s_end FROM (
          SELECT doc_id, i, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS s_end FROM (
            SELECT doc_id, unnest(string_split_regex(text, {quote(s.PATTERNS[k])})) AS g,
                   unnest(regexp_extract_all(text, {quote(s.PATTERNS[k])})) AS m,
                   generate_subscripts(string_split_regex(text, {quote(s.PATTERNS[k])}), 1) AS i
            FROM t) WHERE m IS NOT NULL) WHERE {holds.get(k, 'true')}"""
        for n, k in enumerate(s.KINDS)
    )
    n = {k: i for i, k in enumerate(s.KINDS)}

    def beside(*kinds: str) -> str:
        role = "kind IN (" + ", ".join(str(n[k]) for k in kinds) + ")"
        return f"""(coalesce(max(CASE WHEN {role} THEN s_end END) OVER before >= s_start - 200, false)
               OR coalesce(min(CASE WHEN {role} THEN s_start END) OVER after <= s_end + 200, false))"""

    name = "[" + ", ".join(f"'{k}'" for k in s.KINDS) + "]"
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    placed AS ({kinds}),
    linked AS (
      SELECT *, {beside('access', 'ident')} AS by_identifier, {beside('assign', 'hex', 'opaque')} AS by_secret,
             coalesce(max(CASE WHEN kind < {s.BASE} THEN s_end END) OVER before, 0) AS covered_to
      FROM placed
      WINDOW after AS (PARTITION BY doc_id ORDER BY s_start RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
             before AS (PARTITION BY doc_id ORDER BY s_start RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ), reported AS (
      SELECT *, {name}[kind + 1] || ':' || s_start || ':' || s_end AS span FROM linked
      WHERE kind < {s.BASE} OR covered_to <= s_start AND CASE kind
        WHEN {n['ident']} THEN by_secret WHEN {n['opaque']} THEN by_identifier ELSE by_secret AND by_identifier END
    ), per_doc AS (
      SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
             count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE kind >= {s.BASE}) AS n_weak,
             string_agg(span, ',' ORDER BY s_start, kind) FILTER (WHERE kind < {s.BASE}) AS base,
             string_agg(span, ',' ORDER BY s_start, kind) AS spans
      FROM reported GROUP BY doc_id
    )
    SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_weak, 0) AS n_weak
    FROM t LEFT JOIN per_doc p ON t.doc_id = p.doc_id
    """


@query("op2_secret_scan", _secret_sql())
def op2_secret_scan(spark, sf):
    from pyspark.sql import functions as F

    from .secret_scan import BASE, KINDS, find_secrets

    found = find_secrets(table(spark, sf, "documents"))
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(list(kinds)))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda *kinds: F.size(of(*kinds)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(of(*KINDS[:BASE])), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        count(*KINDS[BASE:]).alias("n_weak"),
    )


# --- 6: SimHash near-dedup ---------------------------------------------------


@query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark, sf):
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf, "documents")).drop("text_hash")


# --- 5: benchmark decontamination --------------------------------------------

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

CONTAMINATION_SQL = f"""
d_words AS (SELECT doc_id, {_WORDS} AS w FROM {{docs}}),
i_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i_size AS (SELECT item_id, w, least(len(w), 13) AS n FROM i_words WHERE len(w) > 0),
i_win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM i_size)
),
d_win AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d_words, (SELECT DISTINCT n FROM i_win) WHERE len(w) >= n)
),
hits AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM d_win d JOIN i_win b ON d.n = b.n AND d.gram = b.gram),
n_hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
),
n_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
),
judged AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
         sha256(coalesce(i.items, '')) AS items_sha256,
         coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
  FROM d_words d LEFT JOIN n_hits h ON d.doc_id = h.doc_id LEFT JOIN n_items i ON d.doc_id = i.doc_id
)
"""


@query("op5_benchmark_decontamination", "WITH " + CONTAMINATION_SQL.format(docs="documents") + " SELECT * FROM judged")
def op5_benchmark_decontamination(spark, sf):
    from pyspark.sql import functions as F

    from .decontaminate import contamination

    found = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        "contaminated",
    )


# --- 7: best-fit packing -----------------------------------------------------


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf):
    from .packing import pack

    return pack(table(spark, sf, "documents")).drop("text_hash")


# --- 10: exact top-k search --------------------------------------------------


@query(
    "op10_exact_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    ), ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op10_exact_top_k(spark, sf):
    from .topk import top_k

    vectors = table(spark, sf, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


# --- 8: chat formatting ------------------------------------------------------

# A conversation of the contract: both its turns hold what the template uses as marks.
MARKED_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

# A backslash for each backslash, each </turn> and each # in runs of three or more.
_ESCAPED_CHARS = r"""2 * length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
  + list_sum(list_concat([0], list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x))))"""


@query(
    "op8_chat_format",
    rf"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS nth FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length(role) + 14 + {_ESCAPED_CHARS}) AS BIGINT) AS formatted_chars
    FROM ordered GROUP BY conv_id
    """,
)
def op8_chat_format(spark, sf):
    """The digests are taken from the formatted text alone: its turns read back, and what the loss mask covers."""
    import hashlib

    from .chat_format import format_conversations, read_back, unescape

    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame(MARKED_CONVERSATION, "conv_id long, turn long, role string, text string")
    formatted = format_conversations(given.unionByName(marked))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out = []
            for text, mask in zip(batch.column("text").to_pylist(), batch.column("loss").to_pylist()):
                read = read_back(text)
                loss = "".join(unescape(text[span["start"] : span["end"]]) for span in mask)
                out.append((len(read), sha("".join(f"{r}\n{t}\n" for r, t in read)), len(loss), sha(loss), len(text)))
            columns = [pa.array(c) for c in zip(*out)] if out else [pa.array([], t) for t in (pa.int64(), pa.string()) * 2 + (pa.int64(),)]
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", *names])

    return formatted.select("conv_id", "text", "loss").mapInArrow(
        digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


# --- 3: language identification ----------------------------------------------


@query("op3_language_id")
def op3_language_id(spark, sf):
    from .language_id import held_out, identify, learn_profiles

    docs = table(spark, sf, "documents")
    profiles = learn_profiles(docs.where(~held_out() & docs["doc_id"].isNotNull()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).drop("text")


# --- 9: token ids in binary shards -------------------------------------------


@query("op9_token_shards")
def op9_token_shards(spark, sf):
    """The index of the shards, and a digest of each sequence as read back from them."""
    import hashlib

    from .token_output import read_index, write_shards

    made, index = write_shards(table(spark, sf, "documents"))
    read = read_index(made, index, "tokens_sha256", "string", lambda ids: hashlib.sha256(ids.tobytes()).hexdigest())
    return read.withColumnRenamed("ids", "doc_ids")


# --- 4: HTML extraction ------------------------------------------------------


@query("op4_html_extraction")
def op4_html_extraction(spark, sf):
    from pyspark.sql import functions as F

    from .html_extract import extract_text

    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# --- 12: fill in the middle --------------------------------------------------


@query(
    "op12_fill_in_middle",
    r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
    u AS (
      SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w,
             list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS h
      FROM t
    ), v AS (
      SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a,
             greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90
                  THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
      FROM u
    ), p AS (
      SELECT doc_id, text, n, form, array_to_string(list_slice(w, 1, a), '') AS prefix,
             array_to_string(list_slice(w, a + 1, b), '') AS middle, array_to_string(list_slice(w, b + 1, n), '') AS suffix
      FROM v
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p
    """,
)
def op12_fill_in_middle(spark, sf):
    from pyspark.sql import functions as F

    from .fill_middle import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf, "documents"), keep=["doc_id"])
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored("output", "form"), 256).alias("restored_sha256"),
    )


# --- 13: periodic runs -------------------------------------------------------

# CRC-32 of a text of ASCII characters, bit by bit: 3988292384 is its polynomial, 4294967295 its first value and last mask.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''),
    lambda c: list_concat([ord(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""


@query(
    "op13_periodic_runs",
    rf"""
    WITH given AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    h AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, {_CRC32.format("CAST(doc_id AS VARCHAR)")} AS h FROM given),
    a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, h // 10 % 8 AS g FROM h),
    p AS (SELECT *, 1 + (n - a) // (3 + g) AS p FROM a),
    doc AS (
      SELECT doc_id, n, CASE WHEN a IS NULL THEN w
             ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w
      FROM p
    ),
    -- Six words that occur again q words later, and stretches of such places.
    gram AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 6), ' ') AS g FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM doc WHERE n >= 12)),
    pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
    isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair),
    stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + 5 + q AS l FROM isle GROUP BY doc_id, q, k),
    long AS (SELECT * FROM stretch WHERE l >= greatest(12, 2 * q)),
    run AS (
      SELECT * FROM long x WHERE NOT EXISTS (
        SELECT 1 FROM stretch y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)
    ),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
    listed AS (
      SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs,
             min({{'l': -l, 's': s, 'q': q}}) AS best
      FROM run GROUP BY doc_id
    ),
    kept AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS short FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM doc) x
      ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.q AS period,
           1000 * -best.l // best.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(short, '')) AS collapsed_sha256
    FROM doc d LEFT JOIN listed ON d.doc_id = listed.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
)
def op13_periodic_runs(spark, sf):
    from pyspark.sql import functions as F

    from .periodic_runs import longest, periodic_runs

    # A tenth of the documents get a periodic end, as the contract has it.
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    let = lambda value, make: F.get(F.transform(F.array(value), make), F.lit(0))

    def ended(words):
        n = F.size(words)
        a = F.when(n > 0, g % n)
        cut = F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p"))
        again = lambda c: lambda x, i: F.when(i < c["a"], x).otherwise(F.get(words, (c["a"] + (i - c["a"]) % c["p"]).cast("int")))
        return let(cut, lambda c: F.array_join(F.transform(words, again(c)), " "))

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when(h % 10 == 0, let(words, ended)).otherwise(F.col("text"))
    docs = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    found = periodic_runs(docs, keep=["doc_id"]).withColumn("best", longest("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# --- 11: quality -------------------------------------------------------------


@query("op11_quality_classifier")
def op11_quality_classifier(spark, sf):
    from pyspark.sql import functions as F

    from .quality import fit, held_out, score

    docs = table(spark, sf, "documents").select("doc_id", "text", held_out().alias("held_out"))
    model = fit(docs.where("NOT held_out"), table(spark, sf, "labels").select("doc_id", "quality"))
    return score(docs, model, keep=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
