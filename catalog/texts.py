"""Stages on text columns: tags, maps, analysis, sentiment, linguistics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpusloom as cl
from corpusloom.functions import text as tx
from corpusloom.functions.languages import stop_words
from corpusloom.session import cut_lineage
from corpusloom.operators.linguistics import EXCLUDED_LABELS, POS_TAGS, pos_value_counts, widen

from .registry import query, quoted, sql_list, sql_sentences, sql_tokens, sql_values, sql_words, table, texts

MATH = r"\$([^$]+)\$"
EMAIL = r"[\w.+-]+@[\w-]+\.\w+"
LONG_WORD = r"[\p{L}]{9,}"


def joined(col, sep="|"):
    return F.array_join(col, sep)


# --- tags ------------------------------------------------------------------


@query(
    "regex_tags_math",
    rf"""
    WITH t AS (SELECT doc_id, regexp_extract_all(text, '{MATH}', 1) AS m FROM documents)
    SELECT doc_id, array_to_string(m, '|') AS math, CAST(len(m) AS BIGINT) AS n FROM t
    """,
)
def regex_tags_math(spark, sf):
    docs = cl.RegexTag(MATH, ["text"], "m").transform(texts(spark, sf))
    return docs.select("doc_id", joined("m").alias("math"), F.size("m").cast("long").alias("n"))


@query(
    "regex_tags_email",
    r"""
    SELECT doc_id,
      array_to_string(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_.+-]+@[\p{L}\p{M}\p{N}_-]+\.[\p{L}\p{M}\p{N}_]+'), '|') AS email
    FROM documents
    """,
)
def regex_tags_email(spark, sf):
    docs = cl.RegexTag(EMAIL, "text", "m").transform(texts(spark, sf))
    return docs.select("doc_id", joined("m").alias("email"))


@query(
    "regex_tags_multi_col",
    rf"""
    SELECT conv_id, turn,
      array_to_string(list_concat(regexp_extract_all(role, '{LONG_WORD}'), regexp_extract_all(text, '{LONG_WORD}')), '|') AS tags
    FROM conversations
    """,
)
def regex_tags_multi_col(spark, sf):
    tagged = cl.RegexTag(LONG_WORD, ["role", "text"], "m", dialect="java").transform(table(spark, sf, "conversations"))
    return tagged.select("conv_id", "turn", joined("m").alias("tags"))


@query(
    "map_to_tags_columns",
    r"""
    SELECT conv_id, turn, array_to_string(list_concat(regexp_extract_all(role, '[aeiou]'),
      regexp_extract_all(text, '[aeiou]{3}')), '|') AS tags FROM conversations
    """,
)
def map_to_tags_columns(spark, sf):
    """One stage over two columns: vowels of the role (short) and vowel runs of the text."""
    runs = lambda v: F.when(F.length(v) < 20, tx.find_all(v, "[aeiou]")).otherwise(tx.find_all(v, "[aeiou]{3}"))
    conv = table(spark, sf, "conversations")
    # The role is always short; pad the text so that it never is.
    conv = conv.withColumn("padded", F.concat(F.col("text"), F.lit(" " * 20)))
    tagged = cl.MapToTags(["role", "padded"], "m", runs).transform(conv)
    return tagged.select("conv_id", "turn", joined("m").alias("tags"))


@query(
    "regex_tags_groups",
    r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(text, '([A-Z][a-z]+) ([a-z]{9,})', 1) AS a,
                      regexp_extract_all(text, '([A-Z][a-z]+) ([a-z]{9,})', 2) AS b FROM documents)
    SELECT doc_id, unnest(a) AS g1, unnest(b) AS g2 FROM t
    """,
)
def regex_tags_groups(spark, sf):
    docs = cl.RegexTag(r"([A-Z][a-z]+) ([a-z]{9,})", "text", "m").transform(texts(spark, sf))
    return docs.select("doc_id", F.inline("m"))


@query(
    "split_tags",
    """
    SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)),
      lambda x: x <> ''), '|') AS words FROM part
    """,
)
def split_tags(spark, sf):
    parts = cl.Split(" ", "p_name", "w").transform(table(spark, sf, "part"))
    return parts.select("p_partkey", joined("w").alias("words"))


@query("value_map", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM documents")
def value_map(spark, sf):
    stage = cl.MapToSingle("text", "chars", lambda v: F.length(v).cast("long"), role="num")
    return stage.transform(table(spark, sf, "documents")).select("doc_id", "chars")


class DistinctSigns(cl.MapToSingle):
    """A user's own stage in plain Python."""

    return_type = "long"

    def doprocess(self, value):
        return len(set(value))


@query(
    "custom_stage",
    "SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '(?s).'))) AS BIGINT) AS signs FROM documents",
)
def custom_stage(spark, sf):
    docs = texts(spark, sf).select("doc_id", "text")
    return DistinctSigns("text", "signs").transform(docs).select("doc_id", "signs")


class Sizes(cl.MapToNamedTags):
    def __init__(self, cols):
        super().__init__(cols, ["chars", "words"])

    def expressions(self, value):
        return {"chars": F.length(value).cast("long"), "words": F.size(tx.words(value)).cast("long")}


@query(
    "null_coercion",
    f"""
    WITH t AS (SELECT doc_id, coalesce(CASE WHEN lang <> 'en' THEN text END, ' ') AS text FROM documents)
    SELECT doc_id, CAST(length(text) AS BIGINT) AS text_chars, CAST(len({sql_words()}) AS BIGINT) AS text_words FROM t
    """,
)
def null_coercion(spark, sf):
    docs = texts(spark, sf).withColumn("text", F.when(F.col("lang") != "en", F.col("text")))
    return Sizes("text").transform(docs).select("doc_id", "text_chars", "text_words")


@query(
    "filter_with_vector",
    "SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL AND label > 4",
)
def filter_with_vector(spark, sf):
    emb = table(spark, sf, "embeddings")
    return emb.where(F.col("embedding").isNotNull() & (F.col("label") > 4)).select("vec_id", "label")


# --- analysis --------------------------------------------------------------

ENGLISH = sql_list(stop_words("english"))
SUFFIX = "CASE WHEN right(t, 2) IN ('''s', '’s') THEN left(t, len(t) - 2) ELSE t END"


def sql_terms(words: str) -> str:
    """The English chain."""
    return f"list_filter(list_transform({words}, lambda t: {SUFFIX}), lambda t: NOT list_contains({ENGLISH}, t))"


@query(
    "analyzed_terms",
    f"""
    WITH t AS (SELECT doc_id, {sql_terms(sql_words())} AS terms FROM documents)
    SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, array_to_string(terms, ' ') AS terms FROM t
    """,
)
def analyzed_terms(spark, sf):
    docs = cl.AnalyzeText("text", "t").transform(texts(spark, sf))
    return docs.select("doc_id", F.size("t").cast("long").alias("n"), joined("t", " ").alias("terms"))


@query(
    "possessive_terms",
    f"""
    WITH d AS (SELECT doc_id, replace(text, ' of ', '''s of ') AS text FROM documents),
    t AS (SELECT doc_id, {sql_terms(sql_words())} AS terms FROM d)
    SELECT doc_id, array_to_string(terms, ' ') AS terms FROM t
    """,
)
def possessive_terms(spark, sf):
    docs = texts(spark, sf).withColumn("text", F.replace("text", F.lit(" of "), F.lit("'s of ")))
    return cl.AnalyzeText("text", "t").transform(docs).select("doc_id", joined("t", " ").alias("terms"))


CORPUS_LANGUAGES = [("fr", "french"), ("de", "german"), ("es", "spanish")]


@query(
    "stop_by_language",
    f"""
    WITH d AS (SELECT doc_id, lang, {sql_words()} AS words FROM documents),
    stop AS ({" UNION ALL ".join(f"SELECT '{c}' AS lang, {sql_list(stop_words(a))} AS stop" for c, a in CORPUS_LANGUAGES)}),
    t AS (
      SELECT doc_id, CASE WHEN d.lang = 'en' THEN {sql_terms('words')}
        ELSE list_filter(words, lambda t: NOT list_contains(coalesce(stop, []), t)) END AS terms
      FROM d LEFT JOIN stop USING (lang))
    SELECT doc_id, array_to_string(terms, ' ') AS terms FROM t
    """,
)
def stop_by_language(spark, sf):
    stage = cl.AnalyzeText("text", "t", cl.Analyzer(lang_col="lang"))
    return stage.transform(texts(spark, sf)).select("doc_id", joined("t", " ").alias("terms"))


class LongWords(cl.MapToTags):
    """Tags by a user's own Python: words of nine letters or more, in lower case."""

    def doprocess(self, value):
        return [w.lower() for w in re.findall(r"[A-Za-z]+", value) if len(w) >= 9]


@query(
    "custom_tags",
    """
    SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]{9,}'), lambda w: lower(w)), '|') AS tags
    FROM conversations
    """,
)
def custom_tags(spark, sf):
    tagged = LongWords("text", "tags").transform(table(spark, sf, "conversations"))
    return tagged.select("conv_id", "turn", joined("tags").alias("tags"))


class Shape(cl.MapToNamedTags):
    """Named values by a user's own Python, a batch at a time."""

    schema = "lines int, first string"

    def doprocess(self, values):
        return [{"lines": v.count("\n") + 1, "first": v[:1]} for v in values]


@query(
    "custom_named_tags",
    """
    SELECT conv_id, turn, CAST(len(string_split(text, chr(10))) AS INTEGER) AS text_lines, text[:1] AS text_first FROM conversations
    """,
)
def custom_named_tags(spark, sf):
    shaped = Shape("text", ["lines", "first"]).transform(table(spark, sf, "conversations"))
    return shaped.select("conv_id", "turn", "text_lines", "text_first")


def splitter():
    """A model of a user: words between blanks, those that begin with a capital are names."""

    def run(values):
        for value in values:
            words = (value or "").split(" ")
            yield {
                "tokens": [{"text": w, "pos": "PROPN" if w[:1].isupper() else "X"} for w in words],
                "ents": [{"text": w, "label": "NAME", "start": i, "end": i + 1} for i, w in enumerate(words) if w[:1].isupper()],
            }

    return run


@query(
    "custom_annotator",
    r"""
    WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)
    SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS words,
      nullif(array_to_string(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}')), '|'), '') AS names,
      nullif(CAST(len(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}'))) AS BIGINT), 0) AS proper
    FROM w
    """,
)
def custom_annotator(spark, sf):
    stage = cl.LinguisticEnrichment(splitter, "text", tags=["ents"], pos_stats=["PROPN"])
    out = stage.transform(table(spark, sf, "conversations"))
    return out.select(
        "conv_id", "turn", F.col("text_wc").cast("long").alias("words"), joined("text_ents").alias("names"),
        F.col("text_num_PROPN").cast("long").alias("proper"),
    )


@query(
    "languages_of_corpus",
    """
    SELECT analyzer, CAST(count(*) AS BIGINT) AS n FROM documents LEFT JOIN
      (VALUES ('DE', 'german'), ('EN', 'english'), ('ES', 'spanish'), ('FR', 'french'), ('IT', 'italian'),
              ('EL', 'greek'), ('NL', 'dutch'), ('PT', 'portuguese')) AS v(code, analyzer) ON code = upper(lang)
    GROUP BY analyzer
    """,
)
def languages_of_corpus(spark, sf):
    """Documents by analyzer; those of an unknown language count too. The registry has nine fixed rows."""
    known = F.broadcast(cl.languages(spark).withColumnRenamed("code", "lang"))
    docs = table(spark, sf, "documents").select(F.upper("lang").alias("lang"))
    return docs.join(known, "lang", "left").groupBy("analyzer").agg(F.count("*").alias("n"))


SYNONYMS = {"thon": "then", "er": "he", "tion": "motion", "anan": "ananas", "der": "die", "la": "le"}


@query(
    "synonym_terms",
    f"""
    WITH t AS (SELECT doc_id, {sql_terms(sql_words())} AS terms FROM documents),
    s AS (SELECT MAP({sql_list(SYNONYMS)}, {sql_list(SYNONYMS.values())}) AS m)
    SELECT doc_id, array_to_string(list_transform(terms, lambda t: coalesce(m[t], t)), ' ') AS terms FROM t, s
    """,
)
def synonym_terms(spark, sf):
    stage = cl.AnalyzeText("text", "t", cl.Analyzer(synonyms=SYNONYMS))
    return stage.transform(texts(spark, sf)).select("doc_id", joined("t", " ").alias("terms"))


RULES = [
    "the and attion, anea eriner thanea => opening words",
    "the of, the and, of the, de la",
    "and attion to thanedble => never longer than",
    "der die => die",
    "los de => los",
]


def _synonym_phrases_sql() -> str:
    """Words between two blanks of their own, so phrases may touch; the longest alternative first."""
    rules = cl.synonym_rules(RULES)
    wide = lambda p: " " + "  ".join(p.split(" ")) + " "
    pattern = quoted("|".join(wide(p) for p in sorted(rules, key=lambda p: (-len(p.split(" ")), p))))
    return f"""
    WITH t AS (SELECT doc_id, ' ' || array_to_string({sql_words()}, '  ') || ' ' AS s FROM documents),
    p AS (SELECT doc_id, string_split_regex(s, {pattern}) AS g, regexp_extract_all(s, {pattern}) AS m FROM t),
    r AS (SELECT MAP({sql_list(map(wide, rules))}, {sql_list(map(wide, rules.values()))}) AS r)
    SELECT doc_id, trim(replace(array_to_string(list_transform(g, lambda x, i: x || coalesce(r[m[i]], '')), ''), '  ', ' ')) AS terms
    FROM p, r
    """


@query("synonym_phrases", _synonym_phrases_sql())
def synonym_phrases(spark, sf):
    """Rules of phrases, the longest from left to right."""
    stage = cl.AnalyzeText("text", "t", cl.Analyzer(lang=None, synonyms=RULES))
    return stage.transform(texts(spark, sf)).select("doc_id", joined("t", " ").alias("terms"))


def cut_ending(term):
    """A stemmer SQL can repeat."""
    return re.sub("(ing|ed|s)$", "", term)


@query(
    "stem_terms_simple",
    f"""
    SELECT doc_id, array_to_string(list_transform({sql_terms(sql_words())}, lambda t: regexp_replace(t, '(ing|ed|s)$', '')), ' ') AS terms
    FROM documents
    """,
)
def stem_terms_simple(spark, sf):
    stage = cl.AnalyzeText("text", "t", cl.Analyzer(stem=True, stemmer=cut_ending))
    return stage.transform(texts(spark, sf)).select("doc_id", joined("t", " ").alias("terms"))


@query("stem_terms")
def stem_terms(spark, sf):
    stage = cl.AnalyzeText("text", "t", cl.Analyzer(stem=True))
    return stage.transform(texts(spark, sf)).select("doc_id", joined("t", " ").alias("terms"))


@query("stem_by_language")
def stem_by_language(spark, sf):
    """Every document by the stemmer of its own language."""
    stage = cl.AnalyzeText("text", "t", cl.Analyzer(lang_col="lang", stop=False, stem=True))
    return stage.transform(texts(spark, sf)).select("doc_id", joined("t", " ").alias("terms"))


# --- sentiment -------------------------------------------------------------

LEXICON = {
    "the": 1.2, "of": -0.8, "is": 0.5, "that": -1.7, "with": 2.1, "from": -2.6, "la": 1.9, "des": -1.1,
    "der": -2.1, "ist": 1.4, "los": 0.7, "que": -0.4, "thon": 3.1, "erin": -3.3,
}
BOOSTERS = {"and": 0.293, "et": 0.293, "und": 0.293, "an": -0.293}
NEGATIONS = ["in", "not", "ne", "nicht", "en"]
SIGN = "CASE WHEN valence > 0 THEN 1 WHEN valence < 0 THEN -1 ELSE 0 END"

SCORED = f"""
    WITH tok AS (
      SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i
      FROM (SELECT doc_id, {sql_words()} AS w FROM documents)),
    lags AS (
      SELECT doc_id, w, lag(w, 1) OVER p AS w1, lag(w, 2) OVER p AS w2, lag(w, 3) OVER p AS w3
      FROM tok WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
    lex AS (SELECT * FROM {sql_values(LEXICON.items(), "term, valence")}),
    boost AS (SELECT * FROM {sql_values(BOOSTERS.items(), "term, weight")}),
    scored AS (
      SELECT doc_id,
        (valence + ({SIGN}) * (coalesce(b1.weight, 0) + 0.95 * coalesce(b2.weight, 0) + 0.9 * coalesce(b3.weight, 0)))
        * CASE WHEN w1 IN {tuple(NEGATIONS)} OR w2 IN {tuple(NEGATIONS)} OR w3 IN {tuple(NEGATIONS)}
               THEN -0.74 ELSE 1 END AS v
      FROM lags JOIN lex ON lags.w = lex.term
      LEFT JOIN boost b1 ON w1 = b1.term LEFT JOIN boost b2 ON w2 = b2.term LEFT JOIN boost b3 ON w3 = b3.term)
"""


def corpus_sentiment(**options):
    return cl.LexiconSentiment("text", "sentiment", LEXICON, BOOSTERS, NEGATIONS, **options)


COMPOUND_SQL = (
    SCORED
    + """, s AS (SELECT doc_id, sum(CAST(v AS DOUBLE)) AS s FROM scored GROUP BY doc_id)
    SELECT d.doc_id, round(coalesce(s / sqrt(s * s + 15), 0.0), 6) AS sentiment FROM documents d LEFT JOIN s USING (doc_id)
    """
)


@query("sentiment_compound", COMPOUND_SQL)
def sentiment_compound(spark, sf):
    docs = corpus_sentiment().transform(texts(spark, sf))
    return docs.select("doc_id", F.round("sentiment", 6).alias("sentiment"))


@query("sentiment_broadcast_lexicon", COMPOUND_SQL)
def sentiment_broadcast_lexicon(spark, sf):
    """The same with a lexicon that is broadcast, among 100,000 words that do not occur."""
    others = spark.range(100_000).select(F.concat(F.lit("no such word "), "id").alias("term"), F.lit(1.0).alias("value"))
    lexicon = cl.dictionary(others.union(cl.functions.dictionary.mapping_table(LEXICON, "double")), value_type="double")
    stage = cl.LexiconSentiment("text", "sentiment", lexicon, BOOSTERS, NEGATIONS)
    return stage.transform(texts(spark, sf)).select("doc_id", F.round("sentiment", 6).alias("sentiment"))


@query("sentiment_table_lexicon", COMPOUND_SQL)
def sentiment_table_lexicon(spark, sf):
    """The same with a lexicon that is joined, as a large one is."""
    lexicon = cl.dictionary(LEXICON, value_type="double", form="joined")
    stage = cl.LexiconSentiment("text", "sentiment", lexicon, BOOSTERS, NEGATIONS)
    return stage.transform(texts(spark, sf)).select("doc_id", F.round("sentiment", 6).alias("sentiment"))


@query(
    "sentiment_shares",
    SCORED
    + f""", n AS (SELECT doc_id, len({sql_words()}) AS n FROM documents),
    s AS (
      SELECT doc_id, sum(CASE WHEN v > 0 THEN CAST(v AS DOUBLE) + 1 ELSE 0 END) AS pos,
             sum(CASE WHEN v < 0 THEN 1 - CAST(v AS DOUBLE) ELSE 0 END) AS neg, count(*) FILTER (v <> 0) AS hits
      FROM scored GROUP BY doc_id),
    a AS (SELECT doc_id, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, n - coalesce(hits, 0) AS neu
      FROM n LEFT JOIN s USING (doc_id))
    SELECT doc_id, round(CASE WHEN pos + neg + neu > 0 THEN pos / (pos + neg + neu) ELSE 0.0 END, 6) AS pos,
      round(CASE WHEN pos + neg + neu > 0 THEN neg / (pos + neg + neu) ELSE 0.0 END, 6) AS neg,
      round(CASE WHEN pos + neg + neu > 0 THEN neu / (pos + neg + neu) ELSE 0.0 END, 6) AS neu
    FROM a
    """,
)
def sentiment_shares(spark, sf):
    docs = corpus_sentiment(shares=True).transform(texts(spark, sf))
    share = lambda s: F.round(f"sentiment_{s}", 6).alias(s)
    return docs.select("doc_id", share("pos"), share("neg"), share("neu"))


# --- linguistics -----------------------------------------------------------

WORDS = [
    # term, lemma, pos, dep
    ("the", "the", "DET", None), ("le", "le", "DET", None), ("la", "le", "DET", None), ("der", "der", "DET", None),
    ("is", "be", "VERB", None), ("are", "be", "VERB", None), ("was", "be", "VERB", None), ("ist", "sein", "VERB", None),
    ("that", "that", "PRON", "nsubj"), ("it", "it", "PRON", "nsubj"), ("er", "er", "PRON", "sb"),
    ("and", "and", "CCONJ", None), ("und", "und", "CCONJ", None), ("et", "et", "CCONJ", None),
    ("of", "of", "ADP", None), ("in", "in", "ADP", None), ("to", "to", "ADP", None), ("de", "de", "ADP", None),
]
PHRASES = {
    "the that": "ORG", "that the": "ORG", "of the": "GPE", "in the": "GPE", "de la": "LOC", "and": "DATE",
    "the": "WORK", "thon": "PERSON", "der": "PERSON", "el de los": "LAW", "is": "ORDINAL",
    "and attion to thanedble the": "ORG",
}
EXCLUDED = EXCLUDED_LABELS
WORD_TABLE = {t: {"lemma": lemma, "pos": pos, "dep": dep} for t, lemma, pos, dep in WORDS}


def corpus_annotator():
    return cl.DictionaryAnnotator(words=WORD_TABLE, phrases=PHRASES)


def enriched(spark, sf, **options):
    docs = texts(spark, sf).select("doc_id", "text")
    return cl.LinguisticEnrichment(corpus_annotator(), "text", **options).transform(docs)


@query(
    "nlp_counts",
    f"""
    WITH d AS (
      SELECT doc_id, coalesce(CASE WHEN lang <> 'fr' THEN text WHEN doc_id > 100 THEN '' END, ' ') AS text FROM documents)
    SELECT doc_id, CAST(len({sql_tokens()}) AS BIGINT) AS text_wc, CAST(len({sql_sentences()}) AS BIGINT) AS text_sentence_count
    FROM d
    """,
)
def nlp_counts(spark, sf):
    """With null texts (one blank token) and empty ones (no token) among them."""
    text = F.when(F.col("lang") != "fr", F.col("text")).when(F.col("doc_id") > 100, F.lit(""))
    docs = texts(spark, sf).select("doc_id", text.alias("text"))
    out = cl.LinguisticEnrichment(None, "text", tags=[], pos_stats=False).transform(docs)
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("text_wc", "text_sentence_count")))


def sql_grams(longest: int) -> str:
    """Runs of 1 to ``longest`` tokens from each token on, in lower case, the longest phrase first."""
    runs = [" || ' ' || ".join(f"lead(t, {k}) OVER p" for k in range(n)) for n in range(1, longest + 1)]
    columns = ", ".join(f"{run} AS t{n}" for n, run in enumerate(runs, 1))
    joins = " ".join(f"LEFT JOIN ph p{n} ON lower(t{n}) = p{n}.phrase" for n in range(1, longest + 1))
    cases = " ".join(
        f"WHEN p{n}.label IS NOT NULL THEN {{'s': i, 'e': i + {n}, 'k': [{{'label': p{n}.label, 'text': t{n}}}]}}"
        for n in range(longest, 0, -1)
    )
    some = ", ".join(f"p{n}.label" for n in range(1, longest + 1))
    return f"""
    g AS (SELECT doc_id, i, {columns} FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
    ph AS (SELECT * FROM {sql_values(PHRASES.items(), "phrase, label")}),
    cand AS (SELECT doc_id, i, CASE {cases} END AS c FROM g {joins} WHERE coalesce({some}) IS NOT NULL)"""


ENTITY_SQL = f"""
    WITH t AS (
      SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i
      FROM (SELECT doc_id, {sql_tokens()} AS w FROM documents)),
    {sql_grams(max(len(x.split(" ")) for x in PHRASES))},
    lists AS (SELECT doc_id, list(c ORDER BY i) AS c FROM cand GROUP BY doc_id),
    ents AS (
      SELECT doc_id, list_reduce(c, lambda a, x:
        CASE WHEN x.s >= a.e THEN {{'s': x.s, 'e': x.e, 'k': a.k || x.k}} ELSE a END).k AS ents
      FROM documents LEFT JOIN lists USING (doc_id))
"""


def sql_entities(condition: str) -> str:
    return f"nullif(array_to_string(list_transform(list_filter(ents, lambda e: {condition}), lambda e: e.text), '|'), '')"


NLP_ENTITIES_SQL = (
    ENTITY_SQL
    + f"""
    SELECT doc_id, {sql_entities(f"NOT list_contains({sql_list(EXCLUDED)}, e.label)")} AS ents,
      {sql_entities("e.label = 'ORG'")} AS entity_org, {sql_entities("e.label = 'DATE'")} AS entity_date,
      {sql_entities("e.label = 'LAW'")} AS entity_law
    FROM ents
    """
)


def entities(docs, annotator):
    stage = cl.LinguisticEnrichment(annotator, "text", tags=["ents"], pos_stats=False, entity_labels=["ORG", "DATE", "LAW"])
    return stage.transform(docs).select(
        "doc_id",
        joined("text_ents").alias("ents"),
        *(joined(f"text_entity_{x}").alias(f"entity_{x.lower()}") for x in ("ORG", "DATE", "LAW")),
    )


@query("nlp_entities", NLP_ENTITIES_SQL)
def nlp_entities(spark, sf):
    return entities(texts(spark, sf).select("doc_id", "text"), corpus_annotator())


@query("nlp_entities_table", NLP_ENTITIES_SQL)
def nlp_entities_table(spark, sf):
    """The same by dictionaries that are joined, as large ones are."""
    annotator = cl.DictionaryAnnotator(words=WORD_TABLE, phrases=PHRASES, form="joined")
    return entities(texts(spark, sf).select("doc_id", "text"), annotator)


@query("nlp_entities_broadcast", NLP_ENTITIES_SQL)
def nlp_entities_broadcast(spark, sf):
    """The same by dictionaries that are broadcast, phrases by an automaton over words."""
    annotator = cl.DictionaryAnnotator(words=WORD_TABLE, phrases=PHRASES, form="broadcast")
    return entities(texts(spark, sf).select("doc_id", "text"), annotator)


@query(
    "nlp_open_labels",
    ENTITY_SQL
    + """, each AS (SELECT doc_id, unnest(ents) AS e, generate_subscripts(ents, 1) AS i FROM ents)
    SELECT doc_id, 'e_' || e.label AS label, string_agg(e.text, '|' ORDER BY i) AS found FROM each GROUP BY doc_id, e.label
    """,
)
def nlp_open_labels(spark, sf):
    """Labels nobody declared: a map column, widened to all labels that occur, and brought into rows again."""
    out = enriched(spark, sf, tags=["ents"], pos_stats=False)
    wide = widen(out.select("doc_id", "text_entities"), "text_entities", "e_")
    labels = [c for c in wide.columns if c != "doc_id"]
    rows = F.array(*[F.struct(F.lit(c).alias("label"), joined(c).alias("found")) for c in labels])
    return wide.select("doc_id", F.inline(rows)).where("found IS NOT NULL")


SQL_POS = f"""
    WITH t AS (
      SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i
      FROM (SELECT doc_id, {sql_tokens()} AS w FROM documents)),
    dict AS (SELECT * FROM {sql_values(WORDS, "term, lemma, pos, dep")}),
    tok AS (
      SELECT doc_id, i, coalesce(lemma, lower(w)) AS lemma, dep,
        coalesce(pos, CASE WHEN regexp_matches(w, '^\\p{{N}}+$') THEN 'NUM'
          WHEN regexp_matches(w, '^[\\p{{L}}\\p{{N}}]') THEN 'X'
          WHEN regexp_matches(w, '^[ \\t\\r\\n\\f]+$') THEN 'SPACE' ELSE 'PUNCT' END) AS pos
      FROM t LEFT JOIN dict ON lower(w) = term)
"""


@query(
    "nlp_subj_verb",
    SQL_POS
    + """
    SELECT doc_id, coalesce(string_agg(lemma, '|' ORDER BY i) FILTER (dep IN ('nsubj', 'sb')), '') AS subj,
      coalesce(string_agg(lemma, '|' ORDER BY i) FILTER (pos = 'VERB'), '') AS verb
    FROM tok GROUP BY doc_id
    """,
)
def nlp_subj_verb(spark, sf):
    out = enriched(spark, sf, tags=["subj", "verb"], pos_stats=False)
    return out.select("doc_id", joined("text_subj").alias("subj"), joined("text_verb").alias("verb"))


@query(
    "nlp_pos_counts",
    SQL_POS
    + f"""
    SELECT doc_id, {", ".join(f"nullif(count(*) FILTER (pos = '{p}'), 0) AS text_num_{p}" for p in POS_TAGS)}
    FROM tok GROUP BY doc_id
    """,
)
def nlp_pos_counts(spark, sf):
    out = enriched(spark, sf, tags=[])
    return out.select("doc_id", *(F.col(f"text_num_{p}").cast("long").alias(f"text_num_{p}") for p in POS_TAGS))


@query("pos_value_counts", SQL_POS + "SELECT pos, count(*) AS n FROM tok GROUP BY pos")
def pos_counts_of_corpus(spark, sf):
    return pos_value_counts(enriched(spark, sf, tags=[], pos_stats=False, return_doc=True), "text_doc")


# --- document vectors ------------------------------------------------------


def word_vectors(docs):
    """A word's vector: in how many documents of each language it occurs."""
    words = docs.select("lang", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("term"))
    counts = [F.count(F.when(F.col("lang") == x, 1)).cast("float") for x in ("de", "en", "es", "fr")]
    return words.groupBy("term").agg(F.array(*counts).alias("vec"))


SQL_VECTORS = f"""
    WITH tok AS (SELECT doc_id, lang, unnest({sql_words()}) AS w FROM documents),
    vec AS (
      SELECT w, {", ".join(f"count(DISTINCT CASE WHEN lang = '{x}' THEN doc_id END) AS {x}" for x in ("de", "en", "es", "fr"))}
      FROM tok GROUP BY w),
    mean AS (SELECT doc_id, {", ".join(f"avg({x}) AS {x}" for x in ("de", "en", "es", "fr"))}
      FROM tok JOIN vec USING (w) GROUP BY doc_id),
    doc AS (SELECT d.doc_id, {", ".join(f"coalesce({x}, 0.0) AS {x}" for x in ("de", "en", "es", "fr"))}
      FROM documents d LEFT JOIN mean USING (doc_id))
"""


DOC_VECTOR_SQL = (
    SQL_VECTORS
    + """, n AS (SELECT *, sqrt(de * de + en * en + es * es + fr * fr) AS norm FROM doc)
    SELECT doc_id, """
    + ", ".join(f"round({x}, 6) AS v_{x}" for x in ("de", "en", "es", "fr"))
    + ", "
    + ", ".join(f"round(CASE WHEN norm = 0 THEN {x} ELSE {x} / norm END, 6) AS u_{x}" for x in ("de", "en", "es", "fr"))
    + " FROM n"
)


def document_vectors(spark, sf, **options):
    docs = texts(spark, sf)
    vectors = cl.WordVectors(cut_lineage(word_vectors(docs)), **options)
    stage = cl.LinguisticEnrichment(None, "text", tags=[], pos_stats=False, vec=True, word_vectors=vectors)
    out = stage.transform(docs.select("doc_id", "text"))
    part = lambda c, p: [F.round(F.col(c)[i], 6).alias(f"{p}_{x}") for i, x in enumerate(("de", "en", "es", "fr"))]
    return out.select("doc_id", *part("text_vec", "v"), *part("text_vec_normalized", "u"))


@query("doc_vector", DOC_VECTOR_SQL)
def doc_vector(spark, sf):
    return document_vectors(spark, sf)


@query("doc_vector_joined", DOC_VECTOR_SQL)
def doc_vector_joined(spark, sf):
    """The same by a table of vectors that is joined, as a large one is."""
    return document_vectors(spark, sf, max_broadcast_bytes=0)


@query(
    "synonym_tags",
    SQL_VECTORS
    + f""", v AS (SELECT w, [de, en, es, fr]::DOUBLE[] AS v FROM vec),
    s AS (SELECT a.w AS seed, b.w, round(list_cosine_similarity(a.v, b.v), 9) AS score
      FROM v a, v b WHERE a.w IN ('und', 'los')),
    k AS (SELECT w, row_number() OVER (PARTITION BY seed ORDER BY score DESC, w) AS rank FROM s),
    known AS (SELECT list(DISTINCT w) AS known FROM (SELECT w FROM k WHERE rank <= 4 UNION SELECT unnest(['und', 'los'])))
    SELECT doc_id, array_to_string(list_filter({sql_words()}, lambda x: list_contains(known, x)), '|') AS tags
    FROM documents, known
    """,
)
def synonym_tags(spark, sf):
    """Seed words and their neighbours, by vectors of how words spread over the languages."""
    docs = texts(spark, sf)
    stage = cl.SynonymTags(["und", "los"], cut_lineage(word_vectors(docs)), "text", "tags", topn=3)
    tagged = stage.transform(docs)
    return tagged.select("doc_id", joined("tags").alias("tags"))
