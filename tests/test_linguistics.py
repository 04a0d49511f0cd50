import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpusloom as cl
from conftest import rows_by_id
from corpusloom.operators.annotate import ANNOTATION, annotator
from corpusloom.operators.linguistics import labels_seen, pos_value_counts, widen

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = {
    "i": {"lemma": "i", "pos": "PRON", "dep": "nsubj"},
    "saw": {"lemma": "see", "pos": "VERB", "dep": "ROOT"},
    "er": {"lemma": "er", "pos": "PRON", "dep": "sb"},
}
PHRASES = {"new york": "GPE", "new york times": "ORG", "york": "PERSON", "monday": "DATE", "times square": "LOC"}


def one(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "id long, c string")
    nlp = cl.DictionaryAnnotator(WORDS, PHRASES, {"CARDINAL": r"^\p{N}+$"})
    return cl.LinguisticEnrichment(nlp, "c", **options).transform(df).first()


def test_counts_and_words(spark):
    row = one(spark, "I saw er. I  saw 12 cats!", pos_stats=["VERB", "PUNCT", "NUM", "SPACE", "X", "ADJ"])
    assert row["c_wc"] == 10 and row["c_sentence_count"] == 2
    assert row["c_subj"] == ["i", "er", "i"] and row["c_verb"] == ["see", "see"]
    got = {p: row[f"c_num_{p}"] for p in ("VERB", "PUNCT", "NUM", "SPACE", "X", "ADJ")}
    assert got == {"VERB": 2, "PUNCT": 2, "NUM": 1, "SPACE": 1, "X": 1, "ADJ": None}


def test_longest_phrase_wins_and_nothing_overlaps(spark):
    row = one(spark, "New York Times Square, York on Monday 7", pos_stats=False)
    assert row["c_entities"] == {"ORG": ["New York Times"], "PERSON": ["York"], "DATE": ["Monday"], "CARDINAL": ["7"]}
    assert row["c_ents"] == ["New York Times", "York"]  # dates and numbers are left out here


def test_nothing_found(spark):
    row = one(spark, "plain", entity_labels=["GPE"])
    assert row["c_ents"] is None and row["c_entity_GPE"] is None and row["c_subj"] == [] and row["c_verb"] == []
    assert one(spark, "plain")["c_entities"] is None
    assert one(spark, "plain", pos_stats=["VERB"], fill_zero=True)["c_num_VERB"] == 0


def test_empty_and_null_texts(spark):
    empty = one(spark, "", pos_stats=["X"], vec=True, entity_labels=["GPE"]).asDict()
    assert empty.pop("c_wc") == 0 and empty.pop("c_sentence_count") == 0
    assert {v for k, v in empty.items() if k.startswith("c_")} == {None}
    null = one(spark, None)
    assert null["c_wc"] == 1 and null["c_num_SPACE"] == 1 and null["c_subj"] == []


def test_duplicate_entities_stay(spark):
    assert one(spark, "York, York", pos_stats=False)["c_ents"] == ["York", "York"]


def test_annotation_schema_and_corpus_counts(spark):
    df = spark.createDataFrame([(1, "I saw York"), (2, "saw")], "id long, c string")
    out = cl.LinguisticEnrichment(cl.DictionaryAnnotator(WORDS, PHRASES), "c", return_doc=True).transform(df)
    assert out.schema["c_doc"].dataType.simpleString() == ANNOTATION
    counts = {r["pos"]: r["n"] for r in pos_value_counts(out, "c_doc").collect()}
    assert counts == {"PRON": 1, "VERB": 2, "X": 1}


def test_widen(spark):
    df = spark.createDataFrame([(1, {"A": ["x"], "B": ["y"]}), (2, {"A": ["z"]}), (3, None)], "id int, m map<string,array<string>>")
    assert labels_seen(df, "m") == ["A", "B"]
    wide = widen(df, "m", "e_")
    assert rows_by_id(wide, "e_B") == {1: ["y"], 2: None, 3: None} and wide.columns == ["id", "e_A", "e_B"]
    assert widen(df, "m", "e_", ["C"]).columns == ["id", "e_C"]


def test_large_dictionaries_are_joined(spark):
    words = spark.createDataFrame([(t, d["lemma"], d["pos"], d["dep"]) for t, d in WORDS.items()], "term string, lemma string, pos string, dep string")
    filler = spark.range(20_100).select(F.concat(F.lit("zz"), "id").alias("term"), F.lit("zz").alias("lemma"), F.lit("NOUN").alias("pos"), F.lit(None).cast("string").alias("dep"))
    phrases = spark.createDataFrame(list(PHRASES.items()), "phrase string, label string")
    filler_phrases = spark.range(20_100).select(F.concat(F.lit("zz "), "id").alias("phrase"), F.lit("MISC").alias("label"))
    long = "one two three four five six"
    large = cl.DictionaryAnnotator(words.union(filler), phrases.union(filler_phrases).union(spark.createDataFrame([(long, "LONG")])))
    small = cl.DictionaryAnnotator(WORDS, {**PHRASES, long: "LONG"})
    rows = [(1, "I saw New York Times Square"), (2, ""), (3, None), (4, "er saw York"), (None, f"x {long} y"), (4, "York"), (None, "York")]
    df = spark.createDataFrame(rows, "id long, c string")
    out = [sorted(map(str, cl.LinguisticEnrichment(a, "c", return_doc=True).transform(df, cl.Roles(id="id")).collect())) for a in (small, large)]
    assert out[0] == out[1] and "LONG" in str(out[0]) and len(out[0]) == 7


def model_factory():
    def run(texts):
        for t in texts:
            yield {
                "tokens": [{"text": w, "pos": "VERB" if w.endswith("s") else "NOUN", "sent": 0} for w in t.split()],
                "ents": [{"text": w, "label": "NAME"} for w in t.split() if w.istitle()],
                "vector": [float(len(t)), 0.0],
            }

    return run


def test_model_annotator(spark):
    df = spark.createDataFrame([(1, "Ann runs"), (2, "")], "id int, c string").repartition(2)
    stage = cl.LinguisticEnrichment(model_factory, "c", vec="normalized", pos_stats=["VERB", "NOUN"], return_doc=True)
    out = {r["id"]: r for r in stage.transform(df).collect()}
    assert out[1]["c_ents"] == ["Ann"] and out[1]["c_verb"] == ["runs"] and out[1]["c_num_NOUN"] == 1
    assert out[1]["c_vec_normalized"] == [1.0, 0.0] and out[2]["c_vec_normalized"] is None and out[2]["c_wc"] == 0
    assert "c_vec" not in stage.transform(df).columns
    assert out[1]["c_doc"]["tokens"][1]["lemma"] == "runs"


def test_annotator_choice():
    assert isinstance(annotator(None), cl.DictionaryAnnotator)
    assert isinstance(annotator(model_factory), cl.ModelAnnotator)
    with pytest.raises(ValueError):
        cl.LinguisticEnrichment(None, "c", vec="other")


def test_output_roles():
    roles = cl.LinguisticEnrichment(None, "c", pos_stats=["X"], entity_labels=["GPE"]).output_roles()
    assert roles["num"] == ["c_wc", "c_sentence_count", "c_num_X"]
    assert roles["tag"] == ["c_ents", "c_subj", "c_verb", "c_entity_GPE"]
    assert roles["transient"] == ["c_doc", "c_vec", "c_vec_normalized"]


def test_runs_of_tokens_are_not_cut_from_a_copy_of_the_list(spark):
    """slice() copies all tokens of a text for each run, which is the square of the text's length."""
    text = "New York, x. " * 30 + "the end of new york times square"
    long = " ".join(f"w{k}" for k in range(12))
    rows = [(1, text), (2, f"a {long} b"), (3, " new york"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "id long, c string")
    nlp = cl.DictionaryAnnotator(WORDS, PHRASES | {long: "LONG"})
    out = cl.LinguisticEnrichment(nlp, "c", entity_labels=["GPE", "LONG"]).transform(df)
    assert "slice(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["c_ents"] == ["New York"] * 30 + ["new york times"] and got[1]["c_sentence_count"] == 31
    assert got[1]["c_num_PUNCT"] == 60 and got[1]["c_num_X"] == 30 * 3 + 7 and got[1]["c_wc"] == 157
    assert got[2]["c_entity_LONG"] == [long] and got[2]["c_num_X"] == 14 and got[2]["c_num_PUNCT"] is None
    assert got[3]["c_wc"] == 3 and got[3]["c_num_SPACE"] == 1 and got[3]["c_entity_GPE"] == ["new york"]
    assert (got[4]["c_wc"], got[4]["c_sentence_count"], got[5]["c_wc"], got[5]["c_sentence_count"]) == (1, 1, 0, 0)


def test_tokens_of_a_text_are_those_of_its_sentences(spark):
    texts = ["", " ", "  ", " a", "a ", "a  b", "\n a", ". a", ".. a. ", "a!? b", "a!?b .c", "..", "x.\n\ny", ".a ..", "a. b.  c"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, c string")
    plain = cl.LinguisticEnrichment(None, "c", tags=[]).transform(df).drop("c")
    whole = cl.LinguisticEnrichment(None, "c", tags=[], return_doc=True).transform(df).drop("c")
    assert sorted(plain.collect()) == sorted(whole.drop("c_doc").collect())
    for row in whole.collect():
        assert row["c_sentence_count"] == max([t["sent"] for t in row["c_doc"]["tokens"]], default=-1) + 1
