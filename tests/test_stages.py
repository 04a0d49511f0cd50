import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpusloom as cl
from conftest import rows_by_id
from corpusloom.operators.stages import as_list


# The stages below run on workers that cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Upper(cl.MapToSingle):
    def doprocess(self, value):
        return value.upper()


class Letters(cl.MapToTags):
    def doprocess(self, value):
        return [c for c in value if c.isalpha()][:2]


class Named(cl.MapToNamedTags):
    schema = "n int, words array<string>"

    def __init__(self, cols):
        super().__init__(cols, ["n", "words"], ["words"])

    def doprocess(self, values: pd.Series):
        return [{"n": len(v), "words": v.split()} for v in values]


def test_map_to_single(edge_texts):
    out = rows_by_id(Upper(["text", "ignored"], "u").transform(edge_texts), "u")
    assert out[1] is None and out[2] == "" and out[4] == "NO MATCH HERE"
    stage = cl.MapToSingle("id", "s", lambda c: F.concat(c, F.lit("!")))
    assert rows_by_id(stage.transform(edge_texts), "s")[4] == "4!"  # the value arrives as text


def test_map_to_tags_joins_columns_in_order(edge_texts):
    df = edge_texts.withColumn("other", F.lit("xyz"))
    out = rows_by_id(Letters(["other", "text"], "t").transform(df), "t")
    assert out[1] == ["x", "y"] and out[4] == ["x", "y", "n", "o"]


def test_map_to_named_tags(edge_texts):
    stage = Named("text")
    out = stage.transform(edge_texts)
    assert out.columns == ["id", "text", "text_n", "text_words"]
    got = rows_by_id(out, "text_n")
    assert got[1] == 1 and got[2] == 0 and got[4] == 13  # null arrives as one blank
    assert stage.output_roles() == {"tag": ["text_n"], "transient": ["text_words"]}


def test_regex_tag_defaults_and_roles(edge_texts):
    stage = cl.RegexTag(cols="text", out_col="doi")
    assert rows_by_id(stage.transform(edge_texts), "doi")[7] == ["doi:10.1/x", "doi:10.1/x"]
    assert stage.output_roles() == {"tag": ["doi"]}
    assert cl.RegexTag("(a)(b)", "text", "p").output_roles() == {}


def test_split_and_as_list(spark):
    df = spark.createDataFrame([(1, "Ann Lee, Bo | Chu"), (2, None)], "id int, author string")
    assert rows_by_id(cl.Split(", ", "author", "authors").transform(df), "authors") == {1: ["Ann Lee", "Bo | Chu"], 2: []}
    assert as_list("a") == ["a"] and as_list(("a", "b")) == ["a", "b"]


def test_synonym_tags(spark):
    vectors = spark.createDataFrame(
        [("cat", [1.0, 0.0]), ("dog", [0.9, 0.1]), ("car", [0.0, 1.0]), ("van", [0.1, 1.0])], "term string, vec array<float>"
    )
    df = spark.createDataFrame([(1, "The Dog, a cat and a van"), (2, None)], "id int, text string")
    stage = cl.SynonymTags(["Cat"], vectors, "text", "pets", topn=1)
    assert stage.vocabulary == ["cat", "dog"]
    assert rows_by_id(stage.transform(df), "pets") == {1: ["dog", "cat"], 2: []}


def test_analyzer_steps(spark):
    df = spark.createDataFrame(
        [(1, "The Cats' cat's cat’s running", "en"), (2, None, "en"), (3, "die Katze und THE", "de"), (4, "the x", "xx")],
        "id long, text string, lang string",
    )
    terms = lambda **o: rows_by_id(cl.AnalyzeText("text", "t", cl.Analyzer(**o)).transform(df), "t")
    assert terms()[1] == ["cats", "cat", "cat", "running"] and terms()[2] == []
    assert terms(stop=False)[1][0] == "the"
    assert terms(stem=True)[1] == ["cat", "cat", "cat", "run"]
    assert terms(synonyms={"cat": "feline"})[1] == ["cats", "feline", "feline", "running"]
    assert terms(lang="german")[3] == ["katze", "the"]
    by_row = terms(lang_col="lang")
    assert by_row[3] == ["katze", "the"] and by_row[4] == ["the", "x"] and by_row[1][0] == "cats"
    assert terms(extra_stop=("cats",))[1] == ["cat", "cat", "running"]
    with pytest.raises(ValueError):
        cl.Analyzer(lang="klingon", stem=True)
    assert cl.Analyzer(lang="dutch", stem=True, stemmer=str.strip).stemmer


def test_stop_words_go_before_synonyms(spark):
    df = spark.createDataFrame([(1, "the a cat")], "id long, text string")
    got = cl.AnalyzeText("text", "t", cl.Analyzer(synonyms={"the": "article", "cat": "the"})).transform(df)
    assert rows_by_id(got, "t") == {1: ["the"]}


def test_large_synonym_table_is_joined(spark):
    table = spark.range(20_500).select(F.concat(F.lit("w"), "id").alias("term"), F.lit("word").alias("canonical"))
    df = spark.createDataFrame([(1, "w7 w20400 other"), (2, None)], "id long, text string")
    stage = cl.AnalyzeText("text", "t", cl.Analyzer(synonyms=table))
    out = stage.transform(df, cl.Roles(id="id"))
    assert rows_by_id(out, "t") == {1: ["word", "word", "other"], 2: []} and out.columns == ["id", "text", "t"]


def test_partitions_do_not_matter(edge_texts):
    stages = [cl.RegexTag(r"\w+", "text", "m"), cl.LexiconSentiment("text"), cl.AnalyzeText("text")]
    results = []
    for n in (1, 8):
        df = edge_texts.repartition(n)
        for s in stages:
            df = s.transform(df)
        results.append(sorted(map(str, df.collect())))
    assert results[0] == results[1] and len(results[0]) == edge_texts.count()


def test_rows_are_stemmed_by_their_own_language(spark):
    df = spark.createDataFrame([(1, "running dogs", "EN"), (2, "running dogs", "DE"), (3, "running dogs", None), (4, "parlons", "fr"), (5, "running dogs", "XX")], "id int, text string, lang string")
    analyzer = cl.Analyzer(lang_col="lang", stem=True, stop=False, stemmer={"french": lambda w: w.removesuffix("ons")})
    got = cl.AnalyzeText("text", "t", analyzer).transform(df)
    assert rows_by_id(got, "t") == {1: ["run", "dog"], 2: ["running", "dog"], 3: ["running", "dogs"], 4: ["parl"], 5: ["running", "dogs"]}
    with pytest.raises(ValueError):
        cl.Analyzer(lang_col="lang", stem=True, stemmer=str.strip)
