"""What keeps queries from growing faster than their input."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpusloom as cl
from corpusloom.functions.batches import in_pieces, pieces
from corpusloom.functions.dictionary import TableDictionary, dictionary
from corpusloom.functions.phrases import _Automaton
from corpusloom.functions.stemming import stemmed_by_key
from corpusloom.operators.annotate import _phrase_ends
from corpusloom.operators.linguistics import pos_value_counts, widen


def plan_of(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def test_joined_dictionaries_do_not_write_tokens_out_in_filters(spark):
    docs = spark.createDataFrame([(1, "the cat of the house"), (2, None)], "id long, text string")
    annotator = cl.DictionaryAnnotator(words={"cat": {"pos": "NOUN"}}, phrases={"the cat": "ANIMAL", "the": "X"}, form="joined")
    stage = cl.LinguisticEnrichment(annotator, "text", tags=["ents"], pos_stats=False)
    out = stage.transform(docs)
    assert not [line for line in plan_of(out) if "Filter" in line and "regexp_extract_all" in line]
    assert {r["id"]: r["text_ents"] for r in out.collect()} == {1: ["the cat", "the"], 2: None}


def test_joined_dictionary_sends_only_words_it_may_hold(spark):
    table = dictionary({"red": "1", "blue sky": "2"}, form="joined")
    assert isinstance(table, TableDictionary)
    words = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("w")).union(spark.sql("SELECT explode(array('red', 'blue sky'))"))
    held = {r["w"] for r in words.where(table.may_hold(F.col("w"))).collect()}
    assert {"red", "blue sky"} <= held and len(held) < 20
    opening = {r["w"] for r in spark.sql("SELECT explode(array('red', 'blue', 'sky')) AS w").where(table.may_open(F.col("w"))).collect()}
    assert opening == {"red", "blue"}


def test_word_classes_of_a_corpus_are_counted_once_a_token(spark):
    docs = spark.createDataFrame([(1, "the cat. 7"), (2, ""), (3, None)], "id long, text string")
    out = cl.LinguisticEnrichment(None, "text", tags=[], pos_stats=False, return_doc=True).transform(docs)
    counts = pos_value_counts(out, "text_doc")
    assert not [line for line in plan_of(counts) if "Filter" in line and "regexp_extract_all" in line]
    assert {r["pos"]: r["n"] for r in counts.collect()} == {"X": 2, "PUNCT": 1, "NUM": 1, "SPACE": 1}


def test_joined_word_vectors_shuffle_counted_words_once(spark):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 4.0])], "term string, vec array<float>")
    vectors = cl.WordVectors(table, max_broadcast_bytes=0)
    docs = spark.createDataFrame([(1, "a a b x"), (2, "a a b x"), (3, ""), (4, None)], "id long, t string")
    out = vectors.add_document_vector(docs, F.split("t", " "), "v")
    assert not [line for line in plan_of(out) if "Aggregate" in line and "term" in line and "count" in line]
    found = {r["id"]: r["v"] for r in out.collect()}
    assert found[1] == found[2] == pytest.approx([2 / 3, 4 / 3]) and found[3] == found[4] == [0.0, 0.0]


def test_pages_and_lists_are_worked_on_in_pieces():
    texts = pa.array(["x" * 10, None, "", "y" * 30, "z" * 5])
    assert list(pieces(texts, 20)) == [(0, 3), (3, 4), (4, 5)]
    lists = pa.array([["a"] * 3, None, [], ["b"] * 9, ["c"]])
    assert list(pieces(lists, 4)) == [(0, 3), (3, 4), (4, 5)]
    assert list(pieces(texts.slice(0, 0))) == []
    seen = []
    big = pa.array(["p" * (1 << 18)] * 10)
    got = list(in_pieces([big], lambda a: seen.append(len(a)) or a))
    assert max(seen) <= 4 and sum(len(a) for a in got) == 10


def test_stemming_by_language_is_one_python_step(spark):
    docs = spark.createDataFrame([(1, "en", ["cats"]), (2, "de", ["katzen"]), (3, None, ["cats"]), (4, "xx", ["cats"]), (5, "EN", [])],
                                 "id long, lang string, w array<string>")
    out = docs.select("id", stemmed_by_key(F.col("w"), F.upper("lang"), {"EN": lambda w: w[:-1], "DE": lambda w: w.upper()}).alias("w"))
    assert {r["id"]: r["w"] for r in out.collect()} == {1: ["cat"], 2: ["KATZEN"], 3: ["cats"], 4: ["cats"], 5: []}
    stage = cl.AnalyzeText("text", "t", cl.Analyzer(lang_col="lang", stop=False, stem=True))
    plan = plan_of(stage.transform(spark.createDataFrame([("a", "en")], "text string, lang string")))
    assert sum("ArrowEvalPython" in line for line in plan) == 1


def test_open_labels_are_read_off_rows_made_once(spark):
    docs = spark.createDataFrame([(1, "the cat of the house"), (2, "a dog"), (3, None)], "id long, text string")
    annotator = cl.DictionaryAnnotator(phrases={"the cat": "ANIMAL", "dog": "ANIMAL", "the house": "PLACE"})
    out = cl.LinguisticEnrichment(annotator, "text", tags=["ents"], pos_stats=False).transform(docs)
    wide = widen(out.select("id", "text_entities"), "text_entities", "e_")
    assert not [line for line in plan_of(wide) if "regexp_extract_all" in line]
    assert {r["id"]: (r["e_ANIMAL"], r["e_PLACE"]) for r in wide.collect()} == {1: (["the cat"], ["the house"]), 2: (["dog"], None), 3: (None, None)}


def test_phrases_are_joined_and_looked_up_only_where_their_ends_fit():
    ends = _phrase_ends(["the cat", "the", "a b c", "the \n cat"], 3)
    assert ends[2] == ({"the", "a"} - {"a"}, None) and ends[3] == ({"a", "the"}, None) and ends[1][0] == {"the"}
    assert _phrase_ends(["the cat", "a dog"], 2) == {1: (set(), set()), 2: ({"the", "a"}, {"cat", "dog"})}


def test_entities_of_inline_dictionaries(spark):
    phrases = {"the cat": "A", "cat sat on": "B", "on": "C", "the cat sat": "D", "x \n y": "E", "on the  mat": "F", "sat on the cat": "G"}
    texts = ["the cat sat on the cat sat", "The cat. sat on, on the  mat on", "x \n y x\ny", "the", "", " ", None, "cat sat on the cat sat on on " * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {}
    for form in ("inline", "broadcast"):
        annotator = cl.DictionaryAnnotator(words={"cat": {"pos": "NOUN"}, "sat": {"lemma": "sit"}}, phrases=phrases, form=form)
        out = cl.LinguisticEnrichment(annotator, "text", ents_exclude=(), return_doc=True).transform(docs)
        found[form] = {r["id"]: r for r in out.drop("text").collect()}
    assert found["inline"] == found["broadcast"]
    assert found["inline"][0]["text_ents"] == ["the cat sat", "on", "the cat sat"] and len(found["inline"][7]["text_ents"]) > 150
    # The list of entities is not carried from candidate to candidate.
    carried = [line for line in plan_of(out) if "aggregate(" in line]
    assert carried and not [line for line in carried if "kept" in line]


def test_phrases_in_many_lists_are_those_of_each_list():
    automaton = _Automaton(["a b", "a", "b c a", "c", "a b c a b"])
    lists = [["a", "b", "c", "a", "b", "x"], None, [], ["a"], ["b", None, "a", "b"], ["x", "y"], ["c", "a", "b", "c", "a", "b", "c"]]
    rows, starts, sizes, phrases = automaton.in_lists(pa.array([["a"], *lists], pa.list_(pa.string())).slice(1))
    found = [[] for _ in lists]
    for row, *match in zip(rows.tolist(), starts, sizes, phrases):
        found[row].append(tuple(match))
    assert found == [automaton.at_each_start(words or ()) for words in lists]
    assert [len(x) for x in automaton.in_lists(pa.array([["x"], None], pa.list_(pa.string())))] == [0] * 4
    assert [len(x) for x in _Automaton([]).in_lists(pa.array([["x"]], pa.list_(pa.string())))] == [0] * 4
