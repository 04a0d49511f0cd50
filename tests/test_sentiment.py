import math

import pytest

import corpusloom as cl
from conftest import rows_by_id

LEX = {"good": 2.0, "bad": -2.0, "meh": 0.0}


def squash(s):
    return s / math.sqrt(s * s + 15)


def scores(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    stage = cl.LexiconSentiment("text", "s", LEX, {"very": 0.3, "barely": -0.3}, ["not"], **options)
    return stage.transform(df)


@pytest.mark.parametrize(
    "text,total",
    [
        ("Good", 2.0),
        ("a good and bad thing", 0.0),
        ("very good", 2.3),
        ("very very good", 2.3 + 0.3 * 0.95),
        ("very x y good", 2.0 + 0.3 * 0.9),
        ("very x y z good", 2.0),
        ("very bad", -2.3),
        ("barely bad", -1.7),
        ("not good", 2.0 * -0.74),
        ("not x x good", 2.0 * -0.74),
        ("not x x x good", 2.0),
        ("not very bad", -2.3 * -0.74),
        ("not not good", 2.0 * -0.74),
    ],
)
def test_rules(spark, text, total):
    assert scores(spark, [text]).first()["s"] == pytest.approx(squash(total))


def test_nothing_scores_zero(spark):
    out = rows_by_id(scores(spark, [None, "", " ", "nothing here", "meh"]), "s")
    assert set(out.values()) == {0.0}


def test_options(spark):
    one = lambda text, **o: scores(spark, [text], **o).first()["s"]
    assert one("this is GOOD", capitals=True) == pytest.approx(squash(2.733))
    assert one("THIS IS GOOD", capitals=True) == pytest.approx(squash(2.0))
    assert one("good!!", exclamation=True) == pytest.approx(squash(2 + 2 * 0.292))
    assert one("bad!!!!!!", exclamation=True) == pytest.approx(squash(-2 - 4 * 0.292))
    assert one("good but bad", but=True) == pytest.approx(squash(2 * 0.5 - 2 * 1.5))
    assert one("good", alpha=0.0) == pytest.approx(1.0)


def test_shares(spark):
    row = scores(spark, ["good bad x meh"], shares=True).first()
    assert (row["s_pos"], row["s_neg"], row["s_neu"]) == pytest.approx((3 / 8, 3 / 8, 2 / 8))
    empty = scores(spark, [""], shares=True).first()
    assert (empty["s_pos"], empty["s_neg"], empty["s_neu"]) == (0.0, 0.0, 0.0)


def test_joined_lexicon_gives_the_same(spark, edge_texts):
    from pyspark.sql import functions as F

    from corpusloom.functions.dictionary import TableDictionary

    lex = {"café": 1.0, "book": -2.0, "here": 0.5, "it's": 3.0}
    table = spark.createDataFrame(list(lex.items()), "term string, valence double")
    large = TableDictionary(table, "term", F.col("valence"), "double")
    inline = rows_by_id(cl.LexiconSentiment("text", "s", lex).transform(edge_texts), "s")
    joined = rows_by_id(cl.LexiconSentiment("text", "s", large, id_col="id").transform(edge_texts), "s")
    assert inline == pytest.approx(joined) and inline[6] != 0
    from_table = rows_by_id(cl.LexiconSentiment("text", "s", table).transform(edge_texts), "s")
    assert from_table == inline


def test_default_lexicon_and_no_shuffle(edge_texts):
    stage = cl.LexiconSentiment("text")
    assert stage.output_roles() == {"num": ["sentiment"]}
    plan = stage.transform(edge_texts)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text and "Python" not in text


def test_a_word_counts_the_nearest_double_of_its_decimal_value(spark):
    rows = [(1, "and the"), (2, "and the x x x of"), (3, "und x x not the"), (4, "odd"), (5, "und odd")]
    df = spark.createDataFrame(rows, "id long, text string")
    lex = {"the": 1.2, "of": -1.493, "odd": 1 / 3}
    stage = cl.LexiconSentiment("text", "s", lex, {"and": 0.293, "und": 0.293}, ["not"])
    out = rows_by_id(stage.transform(df), "s")
    # What cancels out is neutral.
    assert out == {1: squash(1.493), 2: 0.0, 3: squash(-0.888), 4: squash(1 / 3), 5: squash(1 / 3 + 0.293)}


def test_a_joined_lexicon_meets_its_words_only(spark):
    """Rows go to the join with the words that may be in the lexicon and what stands before them, not with all their words."""
    texts = ["very x y Good, not bad", "good but BAD!", None, "", "nothing here", "meh good meh"] * 2
    options = {"shares": True, "capitals": True, "but": True, "exclamation": True}
    lexicon = cl.dictionary(LEX, value_type="double", form="joined")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = cl.LexiconSentiment("text", "s", lexicon, {"very": 0.3, "barely": -0.3}, ["not"], **options).transform(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "_s_tokens" not in plan[: plan.index("Join")]
    assert sorted(out.collect()) == sorted(scores(spark, texts, **options).collect())
