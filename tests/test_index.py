"""Versions of an index: failures, replaced buckets, columns that drift, what is told about columns."""

import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpusloom as cl
from corpusloom.sources.index import Index
from corpusloom.sources.versions import ConcurrentWrite, Files, merged_columns, widened

ROLES = cl.Roles(id="id")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def numbers(spark):
    return spark.range(2000).select("id", (F.col("id") * 2).alias("v")).repartition(3)


def data_files(index):
    return {os.path.relpath(f, index.path): os.stat(f).st_ino for f in glob.glob(f"{index.path}/{Index.WRITE}=*/**/*.parquet", recursive=True)}


@pytest.mark.parametrize("buckets", [0, 8])
@pytest.mark.parametrize("how", ["overwrite", "append", "upsert", "truncate"])
def test_a_job_that_fails_at_its_last_step_leaves_the_index(spark, tmp_path, numbers, monkeypatch, how, buckets):
    index = Index(spark, str(tmp_path), "x", buckets=buckets)
    index.write(numbers, ROLES)

    def broken(self, name, text):
        raise OSError("killed")

    monkeypatch.setattr(Files, "put", broken)
    with pytest.raises(OSError, match="killed"):
        {
            "overwrite": lambda: index.write(numbers.limit(3), ROLES, "overwrite"),
            "append": lambda: index.write(numbers.limit(3), ROLES, "append"),
            "upsert": lambda: index.upsert(numbers.where("id < 9").withColumn("v", F.lit(-1).cast("long")), ROLES),
            "truncate": index.truncate,
        }[how]()
    monkeypatch.undo()
    assert rows(Index(spark, str(tmp_path), "x").read()) == rows(numbers)
    index.write(numbers.limit(1), ROLES, "append")
    assert index.read().count() == 2001


def test_a_rename_that_says_false_is_no_success(spark, tmp_path, numbers):
    index = Index(spark, str(tmp_path), "x")
    index.write(numbers)
    log = index.log
    late = log.get()
    with pytest.raises(ConcurrentWrite):
        log.commit(late)  # the same number again
    assert index.versions() == [1] and not [n for n in log.files.names("_versions") if n.endswith(".tmp")]


def test_only_the_buckets_of_the_ids_are_written_again(spark, tmp_path, numbers):
    index = Index(spark, str(tmp_path), "x", buckets=50)
    index.write(numbers, ROLES)
    before = data_files(index)
    assert len(before) == 50
    ids = index._bucketed(numbers, "id", 50).where(f"{Index.BUCKET} = 7").select("id")
    changed = ids.limit(3).withColumn("v", F.lit(-1).cast("long"))
    index.upsert(changed, ROLES)
    now = data_files(index)
    named = {p for part in index.log.get().parts for p in part.paths}
    assert len(named) == 51  # 49 as they were, the bucket without the replaced rows, the new rows
    assert sum(now.get(f) == inode for f, inode in before.items()) == 50 and len(now) == 52
    assert index.read().where("v = -1").count() == 3 and index.read().count() == 2000
    # New ids touch nothing that is there.
    fresh = spark.createDataFrame([(-1, 5)], "id long, v long")
    index.upsert(fresh, ROLES)
    assert len({p for part in index.log.get().parts for p in part.paths}) == 52 and index.read().count() == 2001


@pytest.mark.parametrize("buckets", [0, 4])
def test_upsert_writes_an_id_once_and_refuses_null(spark, tmp_path, buckets):
    index = Index(spark, str(tmp_path), "x", buckets=buckets)
    df = lambda *r: spark.createDataFrame(list(r), "id long, at int, t string")
    index.upsert(df((1, 1, "a"), (1, 2, "b"), (2, 1, "c")), ROLES, version="at")
    assert rows(index.read()) == [(1, 2, "b"), (2, 1, "c")]
    index.upsert(df((2, 5, "d"), (2, 4, "e"), (3, 1, "f")), ROLES, version="at")
    want = [(1, 2, "b"), (2, 5, "d"), (3, 1, "f")]
    assert rows(index.read()) == want
    with pytest.raises(ValueError, match="have no 'id'"):
        index.upsert(df((1, 9, "x"), (None, 1, "y")), ROLES)
    assert rows(index.read()) == want and index.versions() == [1, 2]
    index.upsert(df(), ROLES)
    assert rows(index.read()) == want


def test_null_ids_are_kept_by_a_plain_write(spark, tmp_path):
    index = Index(spark, str(tmp_path), "x", buckets=3)
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b")], "id long, t string")
    index.write(df, ROLES)
    index.upsert(df.where("id = 1").withColumn("t", F.lit("c")), ROLES)
    assert rows(index.read()) == [(1, "c"), (None, "a"), (None, "a")]


def test_older_versions_and_vacuum(spark, tmp_path, numbers):
    index = Index(spark, str(tmp_path), "x", keep=3)
    for k in range(5):
        index.write(numbers.limit(k + 1), if_exists="overwrite")
    assert index.versions() == [3, 4, 5] and [index.read(v).count() for v in index.versions()] == [3, 4, 5]
    assert len(glob.glob(f"{index.path}/{Index.WRITE}=*")) == 3
    with pytest.raises(ValueError, match="no version 1"):
        index.read(1)


def test_types_widen_on_append(spark, tmp_path):
    index = Index(spark, str(tmp_path), "x")
    df = lambda schema, *r: spark.createDataFrame(list(r), schema)
    index.write(df("a int, b array<int>, c string", (1, [1], "x")))
    index.write(df("a double, b array<bigint>", (0.5, [1 << 40])), if_exists="append")
    index.write(df("c string, a smallint", ("y", 7)), if_exists="append")
    assert dict(index.read().dtypes) == {"a": "double", "b": "array<bigint>", "c": "string"}
    assert rows(index.read()) == [(0.5, [1 << 40], None), (1.0, [1], "x"), (7.0, None, "y")]
    index.write(df("a string", ("text",)), if_exists="append")
    assert sorted(r["a"] for r in index.read().collect()) == ["0.5", "1", "7", "text"]
    before = data_files(index)
    for bad in ("b string", "b array<array<int>>", "c date", "a timestamp"):
        with pytest.raises(ValueError, match="the new rows"):
            index.write(df(bad), if_exists="append")
    with pytest.raises(ValueError, match="holds array<bigint>"):
        index.write(df("b array<double>"), if_exists="append", widen=False)
    assert data_files(index) == before and index.versions()[-1] == 4


def test_json_index_widens_too(spark, tmp_path):
    index = Index(spark, str(tmp_path), "x", "json")
    index.write(spark.createDataFrame([(1,)], "a int"))
    index.write(spark.createDataFrame([(0.5, "n")], "a double, b string"), if_exists="append")
    assert rows(index.read()) == [(0.5, "n"), (1.0, None)]


@pytest.mark.parametrize("a, b, c", [("int", "bigint", "bigint"), ("bigint", "double", "double"), ("float", "int", "double"),
    ("string", "int", "string"), ("array<int>", "array<string>", "array<string>"), ("date", "int", None), ("int", "array<int>", None),
    ("boolean", "int", None), ("struct<a:int>", "struct<a:int>", "struct<a:int>")])
def test_widened(spark, a, b, c):
    kinds = [T.DataType.fromDDL(x) for x in (a, b)]
    for x, y in (kinds, kinds[::-1]):
        assert (k := widened(x, y)) is None if c is None else (k := widened(x, y)).simpleString() == c


def test_merged_columns_keep_order_and_roles(spark):
    role = T.StructField("a", T.IntegerType(), True, {"role": "num"})
    out = merged_columns(T.StructType([role]), T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.LongType())]))
    assert out.names == ["a", "b"] and out["a"].dataType == T.LongType() and out["a"].metadata == {"role": "num"}


def test_partitions_and_buckets_prune(spark, tmp_path, numbers):
    df = numbers.withColumn("k", F.concat(F.lit("k"), F.col("id") % 3))
    index = Index(spark, str(tmp_path), "x", buckets=4)
    index.write(df, ROLES, partition_by=["k"])
    index.write(df.select((F.col("id") + 5000).alias("id"), "v", "k"), ROLES, "append", partition_by=["k"])
    index.upsert(df.where("id = 9").withColumn("v", F.lit(0).cast("long")), ROLES, partition_by=["k"])
    found = index.read().where("k = 'k0'")
    assert "PartitionFilters: [isnotnull(k" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2 * 667 and index.read().count() == 4000 and found.where("id = 9").first()["v"] == 0


def test_buckets_need_an_id_that_keeps_its_type(spark, tmp_path, numbers):
    index = Index(spark, str(tmp_path), "x", buckets=4)
    with pytest.raises(ValueError, match="by id"):
        index.write(numbers)
    index.write(numbers, ROLES)
    with pytest.raises(ValueError, match="keeps its type"):
        index.write(numbers.withColumn("id", F.col("id").cast("string")), ROLES, "append")
    with pytest.raises(ValueError, match="by id"):
        index.write(numbers, if_exists="append")
    # The number of buckets is that of the index, whatever the one who opens it says.
    other = Index(spark, str(tmp_path), "x")
    other.upsert(numbers.where("id = 3").withColumn("v", F.lit(1).cast("long")), ROLES)
    assert other.read().count() == 2000 and other.log.get().buckets == 4


def test_a_folder_of_something_else_is_taken_over(spark, tmp_path, numbers):
    numbers.write.parquet(str(tmp_path / "x"))
    index = Index(spark, str(tmp_path), "x")
    assert index.read().count() == 2000
    index.write(numbers.limit(5).withColumn("more", F.lit("m")), if_exists="append")
    assert index.read().count() == 2005 and index.read().where("more = 'm'").count() == 5


def test_ranges_after_an_append_read_no_row(spark, tmp_path):
    make = lambda: cl.Pipeline("n", num_cols=["v"], id_col="id", date_col="day", root=str(tmp_path))
    df = lambda *r: spark.createDataFrame(list(r), "id int, v double, day string").withColumn("day", F.to_timestamp("day"))
    p = make()
    p.process(df((1, 2.0, "2024-01-01"), (2, float("nan"), None)), write=True)
    p.process(df((3, -4.5, "2024-03-05")), write=True, if_index_exists="append")
    want = {"v": (-4.5, 2.0), "day": tuple(__import__("datetime").datetime(2024, *x) for x in ((1, 1), (3, 5)))}
    assert p.spans == want and make().index(spark).spans(["v", "day", "none"]) == want
    whole = cl.Pipeline("m", num_cols=["v"], id_col="id", date_col="day", root=str(tmp_path))
    assert whole.ranges(p.index(spark).read())["v"] == (-4.5, 2.0)
    # Rows that were replaced may have held the ends.
    p.process(df((3, 0.0, "2024-02-01")), write=True, if_index_exists="upsert")
    assert p.spans == {} and len(p.dashboard()["v"].collect()) == 2


def test_the_folder_of_a_stream_is_read_and_left_alone(spark, tmp_path, numbers):
    from corpusloom.streaming import streams

    numbers.write.parquet(str(tmp_path / "in"))
    p = cl.Pipeline("x", id_col="id", root=str(tmp_path))
    stream = streams.stream_table(spark, str(tmp_path / "in"))
    streams.enrich_stream(p, stream, str(tmp_path / "x"), str(tmp_path / "cp")).awaitTermination()
    index = p.index(spark)
    assert index.read().count() == 2000 and index.spans(["v"]) == {}
    with pytest.raises(ValueError, match="a stream writes"):
        index.write(numbers, ROLES, "append")
    with pytest.raises(FileNotFoundError):
        Index(spark, str(tmp_path), "none").read()
