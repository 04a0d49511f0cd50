import math

import pytest
from pyspark.sql import functions as F

import corpusloom as cl
from conftest import rows_by_id
from corpusloom.functions import arrays, nulls, stemming, text as tx
from corpusloom.functions.dictionary import MAX_INLINE_ENTRIES, BroadcastDictionary, InlineDictionary, TableDictionary, dictionary
from corpusloom.functions.languages import LANGUAGES, stop_words
from corpusloom.sources.index import documents


def test_find_all_follows_python(edge_texts):
    out = rows_by_id(edge_texts.select("id", tx.find_all(F.col("text"), r"\w+").alias("m")), "m")
    assert out[1] == [] and out[2] == [] and out[3] == []
    assert out[6][:3] == ["Café", "Ünïté", "café"]  # \w knows accents, as in Python


def test_find_all_groups(edge_texts):
    one = rows_by_id(edge_texts.select("id", tx.find_all(F.col("text"), r"(\w)=\d").alias("m")), "m")
    assert one[5] == ["a", "b", "a"]
    two = rows_by_id(edge_texts.select("id", tx.find_all(F.col("text"), r"(?P<k>\w)=(\d)").alias("m")), "m")
    assert [tuple(x) for x in two[5]] == [("a", "1"), ("b", "2"), ("a", "1")]
    assert two[1] == []


@pytest.mark.parametrize(
    "regex,n", [("a", 0), ("(a)", 1), (r"\((a)(?:b)", 1), ("(?P<x>a)(b)", 2), ("(?<x>a)", 1), ("[(](a)(?<y>b)", 2)]
)
def test_group_count(regex, n):
    assert tx.group_count(regex) == n


def test_tokens_and_sentences(spark):
    texts = ["", " ", "Hi  there.\nBye!", "a 3.14 b", "It's", "x... y?! z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    toks = rows_by_id(df.select("id", tx.tokens(F.col("text")).alias("t")), "t")
    assert toks == {
        0: [], 1: [" "], 2: ["Hi", "  ", "there", ".", "\n", "Bye", "!"], 3: ["a", "3", ".", "14", "b"],
        4: ["It's"], 5: ["x", ".", ".", ".", "y", "?", "!", "z"],
    }
    sents = rows_by_id(df.select("id", tx.sentences(F.col("text")).alias("t")), "t")
    assert sents[2] == ["Hi  there.\n", "Bye!"] and sents[3] == ["a 3.14 b"] and len(sents[5]) == 3 and sents[0] == []


def test_split_clean(spark):
    df = spark.createDataFrame([(1, "a, b,,c "), (2, None), (3, "")], "id int, t string")
    assert rows_by_id(df.select("id", tx.split_clean(F.col("t"), ",").alias("x")), "x") == {1: ["a", "b", "c"], 2: [], 3: []}


def test_highlight(spark):
    df = spark.createDataFrame([("The cat, the catalog: CAT é.cat",)], "t string")
    got = df.select(tx.highlight(F.col("t"), ["cat", "catalog"])).first()[0]
    assert got == "The <em>cat</em>, the <em>catalog</em>: <em>CAT</em> é.<em>cat</em>"


# Words and stems given as examples in the paper.
PORTER = (
    "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled "
    "motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall "
    "hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit "
    "rational:ration valenci:valenc digitizer:digit operator:oper feudalism:feudal decisiveness:decis "
    "hopefulness:hope formaliti:formal triplicate:triplic formative:form formalize:formal electrical:electr "
    "hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust "
    "defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt "
    "communism:commun activate:activ effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll"
)


@pytest.mark.parametrize("pair", PORTER.split())
def test_porter(pair):
    word, stem = pair.split(":")
    assert stemming.porter(word) == stem


def test_stemmed_arrays_keep_order_and_nulls(spark):
    df = spark.createDataFrame([(1, ["cats", "sing", "cats"]), (2, []), (3, None), (4, ["ponies"])], "id int, t array<string>")
    out = rows_by_id(df.coalesce(1).select("id", stemming.stemmed(F.col("t")).alias("s")), "s")
    assert out == {1: ["cat", "sing", "cat"], 2: [], 3: None, 4: ["poni"]}


def test_nulls_and_nans_are_pruned_at_each_depth(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, 1.0, [1.0, None, nan], (2.0, None), {"a": nan, "b": 1.0}), (2, nan, [], (nan, "x"), {}), (3, None, None, None, None)],
        "id int, x double, xs array<double>, s struct<y: double, z: string>, m map<string, double>",
    )
    docs = [r["doc"] for r in documents(df, suggest="x").collect()]
    assert sorted(docs) == [
        '{"id":1,"x":1.0,"xs":[1.0],"s":{"y":2.0},"m":{"b":1.0},"suggest":1.0}',
        '{"id":2,"xs":[],"s":{"z":"x"},"m":{}}',
        '{"id":3}',
    ]


def test_unit_vector(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id int, v array<float>")
    out = rows_by_id(df.select("id", arrays.unit(F.col("v")).alias("u")), "u")
    assert out == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None}
    assert math.isclose(df.select(arrays.dot(F.col("v"), F.col("v"))).first()[0], 25.0)


def test_inline_dictionary_is_folded_into_the_plan(spark):
    d = InlineDictionary({f"w{i}": float(i) for i in range(1000)} | {"größe": 7.0, "'": 8.0}, "double")
    df = spark.createDataFrame([("w5",), ("größe",), ("'",), ("none",), (None,)], "t string")
    out = df.select(d.get(F.col("t")).alias("v"))
    assert [r["v"] for r in out.collect()] == [5.0, 7.0, 8.0, None, None]
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_dictionary_forms(spark):
    small = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0)], "term string, value double")
    d = dictionary(small, value_type="double")
    assert isinstance(d, InlineDictionary) and d.entries == {"a": 2.0}
    large = spark.range(MAX_INLINE_ENTRIES + 1).select(F.concat(F.lit("w x"), "id").alias("term"), F.col("id").alias("value"))
    d = dictionary(large, value_type="long")
    assert isinstance(d, BroadcastDictionary) and d.longest_key() == 2
    # The joined form is taken when it is asked for only.
    assert isinstance(dictionary(large, value_type="long", form="joined"), TableDictionary)
    assert isinstance(dictionary({"a": 1}, value_type="long", form="broadcast"), BroadcastDictionary)
    with pytest.raises(ValueError, match="joined"):
        BroadcastDictionary(large, "term", F.col("value"), "long", max_bytes=1000)
    for bad in (dict(form="table"), dict(form="inline")):
        with pytest.raises(ValueError):
            dictionary(large, value_type="long", **bad)
    with pytest.raises(ValueError):
        InlineDictionary({str(i): 1 for i in range(MAX_INLINE_ENTRIES + 1)}, "int")


def test_all_forms_of_a_dictionary_give_the_same(spark):
    entries = {"the": 1.0, "of": 2.0, "zoo": 3.0}
    df = spark.createDataFrame([(i, ["the"] * 3 + ["of", f"w{i}", None]) for i in range(50)] + [(99, [])], "id long, t array<string>")
    want = None
    for form in ("inline", "broadcast", "joined"):
        d = dictionary(entries, value_type="double", form=form)
        bound, get, helpers = d.bind(df, F.col("t"))
        got = rows_by_id(bound.withColumn("v", F.transform("t", get)).drop(*helpers), "v")
        assert want is None or got == want
        want = got
    assert want[3] == [1.0, 1.0, 1.0, 2.0, None, None] and want[99] == []
    # Neither null nor repeated ids matter, and a mapping of any size is taken.
    odd = spark.createDataFrame([(None, ["of"]), (None, ["zoo"]), (1, ["the"]), (1, ["of", "of"]), (2, None)], "id long, t array<string>")
    big = {**entries, **{f"x{i}": float(i) for i in range(MAX_INLINE_ENTRIES)}}
    for form in ("broadcast", "joined"):
        bound, get, helpers = dictionary(big, value_type="double", form=form).bind(odd, F.col("t"))
        rows = bound.withColumn("v", F.transform("t", get)).drop(*helpers).collect()
        assert sorted((r["v"] for r in rows), key=repr) == sorted([[2.0], [3.0], [1.0], [2.0, 2.0], None], key=repr)


def test_broadcast_dictionary_is_a_projection(spark):
    df = spark.createDataFrame([(1, ["a"])], "id int, t array<string>")
    bound, get, helpers = dictionary({"a": {"x": 1, "y": "z"}}, value_type="struct<x:int,y:string>", form="broadcast").bind(df, F.col("t"))
    out = bound.select(get(F.lit("a"))["y"].alias("y"), get(F.lit("b"))["y"].alias("n"))
    assert tuple(out.first()) == ("z", None) and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


# --- phrases


def plain_matches(words, phrases, overlapping):
    out, i = [], 0
    while i < len(words):
        hits = [p for p in phrases if words[i : i + len(p.split())] == p.split()]
        if hits:
            best = max(hits, key=lambda p: len(p.split()))
            out.append((i, len(best.split()), phrases[best]))
        i += 1 if overlapping or not hits else len(best.split())
    return out


def test_phrases_equal_brute_force(spark):
    import random

    random.seed(2)
    phrases = {" ".join(random.choice("abc") for _ in range(random.randrange(1, 11))): f"v{k}" for k in range(40)}
    rows = [(i, [random.choice("abcd") for _ in range(random.randrange(0, 60))]) for i in range(300)] + [(900, None), (901, ["a", None, "b"])]
    df = spark.createDataFrame(rows, "id int, w array<string>").repartition(3)
    found = cl.Phrases(phrases)
    assert found.longest_key() == max(len(p.split()) for p in phrases)
    out = df.select("*", found.matches(F.col("w")).alias("m"), found.matches(F.col("w"), overlapping=True).alias("o")).collect()
    for r in out:
        words = r["w"] or []
        assert [tuple(x) for x in r["m"]] == plain_matches(words, phrases, False)
        assert [tuple(x) for x in r["o"]] == plain_matches(words, phrases, True)
    assert cl.Phrases({}).matches(F.col("w")) is not None
    assert df.select(cl.Phrases({}).matches(F.col("w")).alias("m")).where("size(m) > 0").count() == 0


def test_synonym_rules(spark):
    rules = ["# remark", "", "Big  Apple, new york city => NYC", "usa, united states, u\\,s", "a => b c, d", "x => y"]
    assert cl.synonym_rules(rules) == {
        "big apple": "nyc", "new york city": "nyc", "united states": "usa", "u,s": "usa", "a": "b c d", "x": "y",
    }
    for bad in ("=> x", "x =>", "a => b => c"):
        with pytest.raises(ValueError):
            cl.synonym_rules([bad])
    df = spark.createDataFrame([(1, "The new York City of the United States, x a"), (2, None), (3, "york city")], "id int, t string")
    out = rows_by_id(cl.AnalyzeText("t", "s", cl.Analyzer(synonyms=rules, stop=False)).transform(df), "s")
    assert out == {1: ["the", "nyc", "of", "the", "usa", "y", "b", "c", "d"], 2: [], 3: ["york", "city"]}
    assert cl.Analyzer(synonyms=rules).query_terms("Big apple") == ["nyc"]


def test_languages(spark):
    assert cl.languages(spark).count() == len(LANGUAGES) == 9
    for _, analyzer, _ in LANGUAGES:
        if analyzer:
            words = stop_words(analyzer)
            assert len(words) > 20 and list(words) == sorted(set(words))
    assert "the" in stop_words("english") and "der" in stop_words("german") and "και" in stop_words("greek")
    with pytest.raises(ValueError):
        stop_words("klingon")


def test_prune_keeps_schema_names(spark):
    df = spark.createDataFrame([(1, 2.0)], "`a.b` int, c double")
    assert nulls.prune(df).columns == ["a.b", "c"]


@pytest.mark.parametrize(
    "regex",
    [r"(?i)école", r"(?P<a_b>[a-z])(?P=a_b)", r"end\Z", r"(?m)^\w+$", r"\\Z", r"(?i:ÉCOLE)|x", r"([a-z]+)=(\d+)", r"\bé\w*", r"\s+\S"],
)
def test_python_patterns_mean_what_they_mean_in_python(spark, regex):
    import re

    from corpusloom.functions.text import find_all

    texts = ["École ÉCOLE école x", "aabbcd end", "end\n", "a=1 b=22\u00a0c=3", "\\Z \\z", "één\u2028zwei\ndrei", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [r["m"] for r in df.select("id", find_all(F.col("t"), regex).alias("m")).orderBy("id").collect()]
    assert [[tuple(x) if isinstance(x, tuple) else x for x in m] for m in got] == [re.findall(regex, t) for t in texts]


@pytest.mark.parametrize("regex", [r"(a)?(?(1)b|c)", r"\N{DIGIT ONE}", r"(?a)\w"])
def test_patterns_java_lacks_are_refused(regex):
    from corpusloom.functions.text import python_regex

    with pytest.raises(ValueError):
        python_regex(regex)
