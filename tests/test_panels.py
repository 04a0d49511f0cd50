from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

import corpusloom as cl
from corpusloom.operators import search
from corpusloom.plans import panels as pn


@pytest.fixture(scope="module")
def rows(spark):
    nan = float("nan")
    start = datetime(2024, 1, 1)
    data = [
        (1, ["a", "a", "b"], 0.05, start, "The cat"), (2, ["a", None], 0.15, start + timedelta(hours=30), "the dog and cat"),
        (3, [], nan, None, None), (4, None, None, start + timedelta(hours=31), ""), (5, ["c"], 1.0, start, "cat cat"),
    ]
    return spark.createDataFrame(data, "id long, tags array<string>, x double, ts timestamp, text string").repartition(3)


def test_terms_count_rows_not_repeats(rows):
    got = [(r["key"], r["n"]) for r in pn.terms(rows, cl.HorizontalBar("tags")).collect()]
    assert got == [("a", 2), ("b", 1), ("c", 1)]
    assert [r["key"] for r in pn.terms(rows, cl.HorizontalBar("tags", 1)).collect()] == ["a"]


def test_tag_cloud(rows):
    got = [(r["key"], r["n"]) for r in pn.tag_cloud(rows, cl.TagCloud("text")).collect()]
    assert got == [("cat", 3), ("dog", 1)]


def test_histogram_leaves_nan_and_null_out(rows):
    got = {round(r["key"], 6): r["n"] for r in pn.histogram(rows, cl.Histogram("x", 0.1)).collect()}
    assert got == {0.0: 1, 0.1: 1, 1.0: 1}
    filled = pn.histogram(rows, cl.Histogram("x", 0.1), fill=True).collect()
    assert [r["n"] for r in filled] == [1, 1] + [0] * 8 + [1]


def test_gap_filling_over_several_chunks(rows, monkeypatch):
    monkeypatch.setattr(pn, "FILL_CHUNK", 3)
    filled = pn.histogram(rows, cl.Histogram("x", 0.1), fill=True).collect()
    assert len(filled) == 11 and sum(r["n"] for r in filled) == 3


def test_intervals():
    assert pn.histogram_interval(0, 50) == 0.5 and pn.histogram_interval(3.0, 3.0) == 0.1
    assert pn.histogram_interval(None, 1) == 0.1 and pn.histogram_interval("a", "b") == 0.1


@pytest.mark.parametrize(
    "span,step",
    [
        (timedelta(seconds=50), "1 second"), (timedelta(minutes=10), "10 seconds"), (timedelta(hours=1), "1 minute"),
        (timedelta(hours=10), "10 minutes"), (timedelta(hours=90), "1 hour"), (timedelta(days=8), "2 hours"),
        (timedelta(days=30), "12 hours"), (timedelta(days=90), "1 day"), (timedelta(days=600), "7 days"),
        (timedelta(days=2500), "month"), (timedelta(days=9000), "year"),
    ],
)
def test_date_steps(span, step):
    lo = datetime(2020, 1, 1)
    assert pn.date_step(lo, lo + span) == step


def test_date_step_edges():
    assert pn.date_step(None, None) == "2 hours" and pn.date_step(date(2020, 1, 1), date(2020, 1, 1)) == "1 second"


def test_date_histogram(rows):
    got = [(str(r["key"]), r["n"]) for r in pn.date_histogram(rows, cl.DateHistogram("ts", "1 day")).collect()]
    assert got == [("2024-01-01 00:00:00", 2), ("2024-01-02 00:00:00", 2)]
    assert pn.date_histogram(rows, cl.DateHistogram("ts")).agg(F.sum("n")).first()[0] == 4


def test_ranges_skip_nan(rows):
    assert pn.ranges(rows, ["x"]) == {"x": (0.05, 1.0)} and pn.ranges(rows, []) == {}


def test_metric(rows):
    panel = cl.HorizontalBar("tags", metric="max", metric_col="x")
    got = {r["key"]: (r["n"], r["max"]) for r in pn.terms(rows.fillna({"x": 0.0}), panel).collect()}
    assert got["a"] == (2, 0.15)
    with pytest.raises(ValueError):
        pn.terms(rows, cl.HorizontalBar("tags", metric="median", metric_col="x"))


def test_one_pass_table_equals_single_panels(rows):
    roles = cl.Roles(text=["text"], tag=["tags"], num=["x"], date="ts", id="id")
    extra = ["id", cl.TagCloud("text", 1)]
    single = cl.dashboard(rows, roles, extra=extra)
    assert list(single) == ["ts", "tags", "text", "x", "id", "text_TagCloud"]
    table = cl.dashboard_table(rows, roles, extra=extra).collect()
    for name, panel in single.items():
        want = sorted((str(r["key"]), r["n"]) for r in panel.collect())
        mine = [r for r in table if r["panel"] == name]
        pick = lambda r: r["key"] if r["key"] is not None else r["ts"] if r["ts"] is not None else r["value"]
        assert sorted((str(pick(r)), r["n"]) for r in mine) == want, name


def test_one_pass_plan_has_one_scan(rows, spark, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    roles = cl.Roles(text=["text"], tag=["tags"], num=["x"])
    plan = cl.dashboard_table(df, roles, spans={"x": (0.0, 1.0)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan and "partial_count" in plan
    assert "ts" not in plan.split("ReadSchema")[1]


def looked_at(spark, df, make):
    """What ``make`` makes of a table, and how many rows of the table went by for it."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def passed(i):
        seen.add(1)
        return i

    out = make(df.withColumn("id", passed.asNondeterministic()("id"))).collect()
    return out, seen.value


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("days", [0.0001, 0.3, 5, 80, 900, 9000])
def test_unknown_ranges_cost_no_second_look(spark, kind, days):
    start = datetime(2020, 2, 3, 4, 5, 6)
    data = [(i, start + timedelta(days=days * i / 57, microseconds=i), i**2 / 7 - 30, i if i % 3 else None, "u" if i % 5 else None) for i in range(58)]
    data += [(99, None, float("nan"), None, None), (100, None, float("inf"), None, None)]
    df = spark.createDataFrame(data, "id long, ts timestamp, x double, k int, t string").withColumn("ts", F.col("ts").cast(kind))
    df = df.withColumn("same", F.lit(7)).withColumn("none", F.lit(None).cast("double")).repartition(3)
    roles = cl.Roles(tag=["t"], num=["x", "k", "same", "none", "id"], date="ts")
    spans = pn.ranges(df, ["x", "k", "same", "none", "id", "ts"])
    known, _ = looked_at(spark, df, lambda d: pn.dashboard_table(d, roles, spans))
    found, n = looked_at(spark, df, lambda d: pn.dashboard_table(d, roles))
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, known), key=repr) and len(found) > 100
    assert n == 60
    assert pn.dashboard_table(df.where("false"), roles).count() == 0


def test_searches(rows, spark):
    assert [r["id"] for r in search.match_terms(rows, "text", ["cat", "dog"], "and").collect()] == [2]
    assert sorted(r["id"] for r in search.match_terms(rows, "text", ["dog", "cat"]).collect()) == [1, 2, 5]
    marked = search.match_terms(rows, "text", ["dog"], mark="m").first()["m"]
    assert marked == "the <em>dog</em> and cat"
    assert cl.Analyzer().query_terms("The DOG's") == ["dog"]
    listed = search.postings(rows, "id", "text")
    tf = {(r["term"], r["id"]): r["tf"] for r in listed.collect()}
    assert tf == {("cat", 1): 1, ("cat", 2): 1, ("dog", 2): 1, ("cat", 5): 2}
    assert "hashpartitioning" not in listed._jdf.queryExecution().executedPlan().toString()
    names = spark.createDataFrame([("Ann",), ("ann",), ("Ann",), ("Bo",)], "n string")
    assert [(r[0], r[1]) for r in search.suggest_prefix(names, "n", "AN").collect()] == [("Ann", 2), ("ann", 1)]
    got = search.time_range(rows, "ts", "2024-01-01 00:00:00", "2024-01-01 12:00:00")
    assert sorted(r["id"] for r in got.collect()) == [1, 5]
    assert search.relative_range(rows, "ts", "2 hours", "2024-01-02 07:00:00").count() == 2
    assert search.saved_search(rows, ["id"], [F.desc("id")]).first()["id"] == 5
    with pytest.raises(ValueError):
        search.match_terms(rows, "text", ["x"], "xor")


def test_stored_completions(spark, tmp_path):
    names = ["Ann", "ann", "Ann", "Anna", "anB", "Bo", "BO", "b\U0010ffff", "b\U0010ffffx", "\ud7ffx", "\ue000y", "Éa", "éb", "", None, "an"]
    names += [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(3)
    path = str(tmp_path / "c")
    search.write_completions(df, "n", path)
    for prefix in ("AN", "ann", "b", "B\U0010ffff", "\ud7ff", "é", "É", "zz", "", "w29", "\U0010ffff"):
        want = [tuple(r) for r in search.suggest_prefix(df.where("n IS NOT NULL"), "n", prefix, 20).collect()]
        assert [tuple(r) for r in search.stored_completions(spark, path, prefix, 20).collect()] == want, prefix
    plan = search.stored_completions(spark, path, "W29")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,w29)" in plan and "LessThan(key,w2:)" in plan


def test_time_range_reaches_the_scan(rows, spark, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    df = search.time_range(spark.read.parquet(str(tmp_path / "t")), "ts", "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].splitlines()[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed
    assert "text" not in plan.split("ReadSchema")[1]


def test_decimal_and_infinite_ranges(spark):
    import decimal

    assert pn.histogram_interval(decimal.Decimal("0"), decimal.Decimal("500000.00")) == 5000.0
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "x double")
    assert pn.ranges(df, ["x"])["x"] == (1.0, 2.0)
    assert pn.histogram(df, cl.Histogram("x", 1.0)).selectExpr("sum(n)").first()[0] == 2


def test_other_metrics_are_not_counts(spark):
    df = spark.createDataFrame([("a", 1.0)], "t string, x double")
    with pytest.raises(ValueError):
        cl.dashboard_table(df, cl.Roles(), extra=[cl.HorizontalBar("t", metric="avg", metric_col="x")])


def test_clock_times_do_not_follow_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00' AS ts UNION ALL SELECT TIMESTAMP_NTZ '1969-12-31 23:59:59.5'")
        keys = pn.date_histogram(df, cl.DateHistogram("ts", "1 day")).selectExpr("CAST(key AS STRING) AS k").collect()
        assert [r["k"] for r in keys] == ["1969-12-31 00:00:00", "2024-03-10 00:00:00"]
        table = cl.dashboard_table(df, cl.Roles(date="ts"), spans={"ts": (None, None)})
        assert sorted(r["k"] for r in table.selectExpr("CAST(ts AS STRING) AS k").collect()) == ["1969-12-31 22:00:00", "2024-03-10 02:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_large_panels_are_ranked_in_parts(spark):
    df = spark.range(3000).selectExpr("CAST(id % 1500 AS STRING) AS t")
    out = cl.dashboard_table(df, cl.Roles(), extra=[cl.HorizontalBar("t", 1200)])
    assert out.count() == 1200 and {r["n"] for r in out.collect()} == {2}


def test_time_range_of_a_dashboard(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS ts, 'x' AS t FROM range(10)")
    roles = cl.Roles(tag=["t"], date="ts")
    assert cl.dashboard(df, roles, time_from="2024-01-03", time_to="2024-01-05")["t"].first()["n"] == 3
    with pytest.raises(ValueError):
        cl.dashboard(df, cl.Roles(tag=["t"]), time_from="2024-01-03")
