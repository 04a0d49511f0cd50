import glob
import os

import pytest
from pyspark.sql import functions as F

import corpusloom as cl
from corpusloom.roles import geo_point, roles_from_schema
from corpusloom.session import cut_lineage, shared_folder
from corpusloom.sources.index import Index, latest_by_id, with_document_id, write_jdbc, write_mode
from corpusloom.streaming import streams


@pytest.fixture
def news(spark):
    rows = [(i, f"group{i % 3}", f"message {i} is good" if i % 2 else "bad $x^2$ and $y$", f"2024-01-{i + 1:02d}") for i in range(20)]
    rows.append((99, None, None, "not a date"))
    return spark.createDataFrame(rows, "id long, newsgroup string, message string, day string").repartition(4)


def pipeline(root, **options):
    p = cl.Pipeline("news", text_cols=["message"], tag_cols=["newsgroup"], id_col="id", root=str(root), **options)
    p += cl.RegexTag(r"\$([^$]+)\$", ["message"], "math")
    p += cl.LexiconSentiment("message", "sentiment")
    p += cl.LinguisticEnrichment(None, "message", pos_stats=["X"], return_doc=True)
    return p


def test_rows_and_roles(news, tmp_path):
    p = pipeline(tmp_path)
    out = p.process(news)
    assert out.count() == news.count()
    assert p.roles.tag == ("newsgroup", "math", "message_ents", "message_subj", "message_verb")
    assert p.roles.num == ("sentiment", "message_wc", "message_sentence_count", "message_num_X")
    assert p.declared.num == ()
    assert {tuple(r["math"]) for r in out.collect()} == {("x^2", "y"), ()}


def test_empty_pipeline_keeps_rows(news, tmp_path):
    assert sorted(cl.Pipeline("n", ["message"], root=str(tmp_path)).process(news).collect()) == sorted(news.collect())


def test_functions_are_stages_too(news):
    p = cl.Pipeline("n")
    p += lambda df: df.withColumn("twice", F.col("id") * 2)
    assert p.process(news).where("twice = 8").count() == 1


def test_roles_are_checked(news):
    with pytest.raises(ValueError, match="group"):
        cl.Pipeline("n", tag_cols=["group"]).transform(news)


def test_write_policies(news, tmp_path, spark):
    p = pipeline(tmp_path, timestamp_cols=["day"], suggests="newsgroup", date_col="day")
    assert p.process(news, write=True, return_processed=False) is None
    assert p.rows_written == 21 and p.spans["sentiment"][1] > 0 > p.spans["sentiment"][0]
    stored = p.index(spark).read()
    assert stored.count() == 21 and "message_doc" not in stored.columns and "suggest" in stored.columns
    assert dict(stored.dtypes)["day"] == "timestamp" and stored.where("day is null").count() == 1
    assert roles_from_schema(stored.schema)["math"] == "tag"
    for policy in ("error", "ERROR", None):
        with pytest.raises(FileExistsError):
            p.process(news, write=True, if_index_exists=policy)
    p.process(news, write=True, if_index_exists="Append")
    assert p.index(spark).read().count() == 42
    p.process(news, write=True, if_index_exists="overwrite")
    assert p.index(spark).read().count() == 21
    with pytest.raises(ValueError):
        p.process(news, write=True, if_index_exists="replace")
    panels = p.dashboard()
    assert panels["newsgroup"].count() == 3 and panels["math"].count() == 2 and panels["message"].first()["n"] == 10
    assert p.dashboard_table().where("panel = 'math'").count() == 2


def test_ragged_vectors_are_refused_before_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, v array<float>")
    p = cl.Pipeline("v", vec_cols=["v"], root=str(tmp_path))
    with pytest.raises(ValueError):
        p.process(df, write=True)
    assert not p.index(spark).exists()
    p.process(df.where("id = 1"), write=True)
    assert p.dims == {"v": 1}


def test_index_life_cycle(spark, tmp_path, news):
    index = Index(spark, str(tmp_path), "x")
    assert not index.exists() and not index.drop()
    index.create(news)
    assert index.exists() and index.read().count() == 0
    index.write(news.select("id", "day"), if_exists="append")
    index.write(news.withColumn("extra", F.lit(1)), if_exists="append", partition_by=())
    assert index.read().count() == 42 and index.read().where("extra = 1").count() == 21
    index.truncate()
    assert index.read().count() == 0 and "extra" in index.read().columns
    assert index.drop() and not index.exists()
    for bad in ("../x", "", "a/b", ".."):
        with pytest.raises(ValueError):
            Index(spark, str(tmp_path), bad)


def test_json_index(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [None, "a"])], "id int, x double, t array<string>")
    index = Index(spark, str(tmp_path), "j", "json")
    index.write(df)
    text = "".join(open(f).read() for f in glob.glob(f"{index.path}/{Index.WRITE}=*/*.json"))
    assert text.strip() == '{"id":1,"t":["a"]}'


def test_upsert_replaces_by_id(spark, tmp_path, news):
    p = cl.Pipeline("up", text_cols=["message"], id_col="id", num_cols=["size"], root=str(tmp_path))
    sized = news.withColumn("size", F.length("message"))
    p.process(sized, write=True)
    more = sized.where("id < 5").withColumn("size", F.lit(-7)).withColumn("extra", F.lit("x"))
    p.process(more, write=True, if_index_exists="upsert")
    out = p.index(spark).read()
    assert out.count() == 21 and out.where("size = -7 AND extra = 'x'").count() == more.count()
    # The ranges of the rows written last do not stand for the whole index.
    fresh = cl.Pipeline("up", text_cols=["message"], id_col="id", num_cols=["size"], root=str(tmp_path))
    assert [r["key"] for r in p.dashboard()["size"].collect()] == [r["key"] for r in fresh.dashboard()["size"].collect()]
    with pytest.raises(ValueError):
        cl.Pipeline("up", text_cols=["message"], root=str(tmp_path)).process(news, write=True, if_index_exists="upsert")


def test_a_failed_overwrite_leaves_the_index(spark, tmp_path, news):
    index = Index(spark, str(tmp_path), "kept")
    index.write(news)
    broken = news.withColumn("x", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        index.write(broken, if_exists="overwrite")
    assert index.read().count() == 21


def test_json_index_keeps_types(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id int, n long").withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    index = Index(spark, str(tmp_path), "typed", "json")
    index.write(df)
    assert index.read().dtypes == df.dtypes and index.read().collect() == df.collect()


def test_partitioned_index_prunes(spark, tmp_path, news):
    index = Index(spark, str(tmp_path), "p")
    index.write(news, partition_by=["newsgroup"])
    plan = index.read().where("newsgroup = 'group1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(newsgroup" in plan


def test_write_modes():
    assert [write_mode(x) for x in ("error", None, "OVERWRITE", "append")] == ["errorifexists", "errorifexists", "overwrite", "append"]


def test_ids(spark, news):
    a = {r["_id"] for r in with_document_id(news).collect()}
    b = {r["_id"] for r in with_document_id(news.repartition(1)).collect()}
    assert a == b and len(a) == 21 and len(next(iter(a))) == 64
    assert with_document_id(news, "id").where("_id = '99'").count() == 1


def test_latest_by_id_with_a_hot_id(spark):
    rows = [(1, v, f"v{v}") for v in range(50)] + [(2, 3, "a"), (2, 3, "b"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "id int, v int, t string").repartition(4)
    out = {r["id"]: (r["v"], r["t"]) for r in latest_by_id(df, "id", "v").collect()}
    assert out == {1: (49, "v49"), 2: (3, "b"), None: (1, "n")}


class Recorder:
    """Stands in for a frame and its writer; no database is started for a test."""

    def __init__(self):
        self.calls = {}
        self.write = self

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls.setdefault(name, []).append(args or kwargs)
            return self

        return call


def test_jdbc_options():
    r = Recorder()
    write_jdbc(r, "jdbc:x", "t", "append", batch_rows=50, connections=2, user="u")
    assert r.calls["repartition"] == [(2,)] and r.calls["mode"] == [("append",)] and ("batchsize", "50") in r.calls["option"]
    assert {"user": "u"} in r.calls["options"] and ("dbtable", "t") in r.calls["option"]


def test_geo_points(spark):
    df = spark.createDataFrame([("47.4, 8.5",), ("91,0",), ("x,y",), (None,), ("1",), ("1,2,3",)], "p string")
    got = [r["g"] and tuple(r["g"]) for r in df.select(geo_point(F.col("p")).alias("g")).collect()]
    assert got == [(47.4, 8.5), None, None, None, None, None]
    assert df.select(geo_point(F.lit(1), F.lit(2)).alias("g")).first()["g"]["lon"] == 2.0


def test_typed_keeps_filters_at_the_scan(spark, tmp_path, news):
    news.write.parquet(str(tmp_path / "n"))
    df = cl.Roles(tag=["newsgroup"], id="id").typed(spark.read.parquet(str(tmp_path / "n")))
    plan = df.where("newsgroup = 'group1'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(newsgroup,group1)" in plan and "message" not in plan.split("ReadSchema")[1]


def test_reading(spark, tmp_path, news):
    news.write.json(str(tmp_path / "n.json"))
    news.createOrReplaceTempView("news_view")
    assert cl.read_texts(spark, str(tmp_path / "n.json"), schema=news.schema).count() == 21
    assert cl.read_texts(spark, "news_view").count() == 21
    assert [r["id"] for r in cl.head(news, 2, "id").collect()] == [0, 1]
    assert cl.read_texts(spark, "news_view", partitions=7).rdd.getNumPartitions() == 7
    with pytest.raises(ValueError):
        cl.read_texts(spark, "news_view", partitions=0)
    p = cl.Pipeline("n", ["message"])
    assert p.process(news.coalesce(1), partitions=3).rdd.getNumPartitions() == 3
    merged = cl.union_by_name(news.select("id"), news.select(F.col("id").alias("other")))
    assert merged.columns == ["id", "other"] and merged.count() == 42


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert cut_lineage(spark.range(5)).count() == 5


def test_stream_gives_what_the_batch_gives(spark, tmp_path, news):
    news.repartition(3).write.parquet(str(tmp_path / "in"))
    p = pipeline(tmp_path / "root")
    stream = streams.stream_table(spark, str(tmp_path / "in"), maxFilesPerTrigger=1)
    streams.enrich_stream(p, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = p.transform(news).drop(*p.roles.transient)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_large_lexicons_and_phrases_stream(spark, tmp_path, news):
    """100,000 entries, appended to an index folder as the batch has them; nothing is regrouped."""
    news.repartition(3).write.parquet(str(tmp_path / "in"))
    words = spark.range(100_000).select(F.concat(F.lit("w"), "id").alias("term"), F.lit(1.0).alias("valence"))
    words = words.union(spark.createDataFrame([("message", -2.0)], words.schema))
    p = cl.Pipeline("n", text_cols=["message"], id_col="id", root=str(tmp_path))
    p += cl.LexiconSentiment("message", "s", words)
    phrases = {**{f"p{i} q": "X" for i in range(30_000)}, "is good": "OK", "bad x": "BAD"}
    p += cl.LinguisticEnrichment(cl.DictionaryAnnotator(phrases=phrases, patterns={"N": "^[0-9]+$"}), "message", tags=["ents"])
    stream = streams.stream_table(spark, str(tmp_path / "in"), maxFilesPerTrigger=1)
    streams.enrich_stream(p, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = p.transform(news).drop(*p.roles.transient)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {tuple(r["message_ents"] or ()) for r in got.where("id = 7").collect()} == {("7", "is good")}
    assert got.where("s < 0").count() == 10


def test_live_counts_over_several_batches(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:30:00", k) for h in range(6) for k in ("a", "b", "a")]
    df = spark.createDataFrame(rows, "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: streams.stream_table(spark, str(tmp_path / "in"), maxFilesPerTrigger=1)
    hist = streams.live_date_histogram(stream(), "ts", "2 hours", late="10 days")
    streams.write_live(hist, str(tmp_path / "h"), str(tmp_path / "hc")).awaitTermination()
    assert sorted((str(r["key"]), r["n"]) for r in streams.read_live(spark, str(tmp_path / "h")).collect()) == [
        (f"2024-01-01 0{h}:00:00", 6) for h in (0, 2, 4)
    ]
    terms = streams.live_terms(stream(), "ts", F.array("k"), late="10 days")
    streams.write_live(terms, str(tmp_path / "t"), str(tmp_path / "tc")).awaitTermination()
    top = streams.top_terms(streams.read_live(spark, str(tmp_path / "t")), 1).collect()
    assert [(r["term"], r["n"]) for r in top] == [("a", 12)]


def files_in_order(df, path, numbers):
    for n in numbers:
        df.where(F.col("f") == n).drop("f").coalesce(1).write.mode("append").parquet(str(path))


def test_windows_close(spark, tmp_path):
    at = lambda f, t, k="a": (f, None if t is None else f"2024-01-01 {t}", k)
    rows = [
        at(0, "00:10:00"), at(0, "02:30:00"), at(0, None), at(0, "02:30:00", None),
        at(1, "01:59:59"),  # of a window that the mark, 01:30, has not passed
        at(1, "05:00:00"),  # the mark goes to 04:00
        at(2, "01:00:00"), at(2, "01:00:00"), at(2, "03:59:59", "b"), at(2, "04:00:00"), at(2, "23:00:00"),
    ]
    df = spark.createDataFrame(rows, "f int, ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    files_in_order(df, tmp_path / "in", range(3))
    run = lambda most, name: streams.write_windows(
        streams.stream_table(spark, str(tmp_path / "in"), maxFilesPerTrigger=1), "ts", str(tmp_path / name), str(tmp_path / f"{name}c"),
        by=["k"], most_folders=most,
    ).awaitTermination()
    got = lambda name, closed: sorted(
        ((str(r["key"])[11:13], r["k"], r["n"], r["n_late"]) for r in streams.read_windows(spark, str(tmp_path / name), closed=closed).collect()), key=repr
    )
    run(20, "x")
    want = [("00", "a", 2, 2), ("02", "a", 1, 0), ("02", "b", 0, 1), ("02", None, 1, 0), ("04", "a", 2, 0), ("22", "a", 1, 0)]
    assert got("x", False) == sorted(want, key=repr) and got("x", True) == sorted(want[:-1], key=repr)
    # Merged at each step, the same; and the number of folders stays bounded.
    run(1, "y")
    assert got("y", False) == got("x", False) and len(glob.glob(str(tmp_path / "y" / "*=*"))) == 1
    # A batch that is repeated writes its folder again and changes nothing.
    for name in ("2", ".2.crc"):
        os.remove(tmp_path / "xc" / "commits" / name)
    run(20, "x")
    assert got("x", False) == sorted(want, key=repr) and len(glob.glob(str(tmp_path / "x" / "epoch=*"))) == 3


def test_live_counts_are_merged(spark, tmp_path):
    newest = lambda rows: {r["k"]: r["n"] for r in rows.collect()}
    epochs = streams.Epochs(spark, str(tmp_path / "e"), most=2)
    for e in range(7):
        epochs.add(e, spark.createDataFrame([("a", e), (f"k{e}", 1)], "k string, n long"))
        epochs.merge(streams._newest)
        assert len(epochs.folders()) <= 2
    assert newest(streams.read_live(spark, str(tmp_path / "e"))) == {"a": 6, **{f"k{e}": 1 for e in range(7)}}
    # A merge that stops before it has deleted anything.
    before = newest(streams.read_live(spark, str(tmp_path / "e")))
    epochs.add(7, spark.createDataFrame([("a", 9)], "k string, n long"))
    epochs.add(8, spark.createDataFrame([("b", 2)], "k string, n long"))
    delete, epochs.files.delete = epochs.files.delete, lambda name: False
    epochs.merge(streams._newest)
    epochs.files.delete = delete
    assert epochs.folders() == ["merged=8"] and newest(streams.read_live(spark, str(tmp_path / "e"))) == {**before, "a": 9, "b": 2}


@pytest.mark.parametrize("buckets", [0, 3])
def test_stream_upserts_keep_the_newest_of_an_id(spark, tmp_path, buckets):
    rows = [(0, 1, 5, "x"), (0, 2, 1, "x"), (0, 2, 3, "y"), (1, 1, 4, "late"), (1, 2, 4, "z"), (2, 2, 4, "z"), (2, 3, 1, "new"), (2, 1, 6, "last")]
    df = spark.createDataFrame(rows, "f int, id long, at int, t string")
    files_in_order(df, tmp_path / "in", range(3))
    p = cl.Pipeline("s", text_cols=["t"], id_col="id", root=str(tmp_path), buckets=buckets)
    p += lambda d: d.withColumn("loud", F.upper("t"))
    run = lambda c: streams.upsert_stream(
        p, streams.stream_table(spark, str(tmp_path / "in"), maxFilesPerTrigger=1), str(tmp_path / c), version="at"
    ).awaitTermination()
    run("c")
    want = [(1, 6, "last", "LAST"), (2, 4, "z", "Z"), (3, 1, "new", "NEW")]
    assert sorted(map(tuple, p.index(spark).read().collect())) == want
    run("d")  # all of it once more
    assert sorted(map(tuple, p.index(spark).read().collect())) == want
    with pytest.raises(ValueError):
        streams.upsert_stream(cl.Pipeline("n"), df, str(tmp_path / "e"))


def test_open_labels_are_refused_on_streams(spark, tmp_path, news):
    news.write.parquet(str(tmp_path / "in"))
    stream = streams.stream_table(spark, str(tmp_path / "in"))
    with pytest.raises(ValueError):
        cl.widen(stream.withColumn("m", F.create_map(F.lit("a"), F.lit("b"))), "m", "x_")
