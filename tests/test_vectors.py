import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpusloom as cl
from conftest import rows_by_id
from corpusloom.functions.text import words
from corpusloom.operators.vectors import approximate_neighbours, vector_dims


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 6)).round(3)
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(200 + i, "hot", rows[5][2]) for i in range(4)]  # exact copies tie
    rows += [(300, "zero", [0.0] * 6)]
    return spark.createDataFrame(rows, "id long, g string, v array<double>").repartition(5), rows


def brute_force(queries, rows, k):
    out = {}
    for qid, qv in queries:
        if not np.any(qv):
            continue
        scored = []
        for i, _, v in rows:
            n = np.linalg.norm(v) * np.linalg.norm(qv)
            if n:
                scored.append((-round(float(np.dot(v, qv) / n), 9), i))
        out[qid] = [i for _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 100}])
def test_neighbours_equal_brute_force(points, options):
    df, rows = points
    queries = df.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    found = cl.nearest_neighbours(queries, df, 5, "q", "qv", "id", "v", **options)
    got: dict = {}
    for r in found.orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["id"])
    assert got == brute_force([(i, v) for i, _, v in rows], rows, 5)


def test_neighbours_are_cut_before_the_shuffle(points):
    df, _ = points
    found = cl.nearest_neighbours(df.select(F.col("id").alias("q"), F.col("v").alias("qv")), df, 5, "q", "qv", "id", "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_approximate_neighbours_find_copies(points):
    df, _ = points
    queries = df.where("id = 5").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    found = approximate_neighbours(queries, df, 3, "q", "qv", "id", "v")
    assert [r["id"] for r in found.orderBy("rank").collect()] == [5, 200, 201]


def test_centroids_with_a_hot_group(points, spark):
    df, rows = points
    df = df.union(spark.createDataFrame([(900, "hot", None), (901, None, [1.0] * 6)], df.schema))
    got = {r["g"]: r["centroid"] for r in cl.group_centroids(df, "g", "v").collect()}
    assert set(got) == {g for _, g, _ in rows} | {None}
    for g in {g for _, g, _ in rows}:
        want = np.mean([v for _, h, v in rows if h == g], axis=0)
        assert np.allclose(got[g], want)


@pytest.mark.parametrize("block", [2, 512])
def test_pairwise_distances(spark, block):
    rows = [("a", [0.0, 0.0]), ("b", [3.0, 4.0]), ("c", [0.0, 1.0]), ("d", [3.0, 4.0])]
    df = spark.createDataFrame(rows, "g string, v array<double>")
    got = {(r["group_a"], r["group_b"]): r["distance"] for r in cl.pairwise_distances(df, "g", "v", block).collect()}
    want = {(a, b): math.dist(x, y) for a, x in rows for b, y in rows if a < b}
    assert got == pytest.approx(want) and len(got) == 6


def test_dims(spark):
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, v array<float>")
    with pytest.raises(ValueError, match="1 to 2"):
        vector_dims(ragged, "v")
    assert vector_dims(ragged.where("id = 2"), "v") == {"v": 2}
    with pytest.raises(ValueError):
        vector_dims(ragged.limit(0), "v")


def test_word_vectors_broadcast_and_joined_agree(spark):
    table = spark.createDataFrame([("the", [1.0, 2.0]), ("cat", [0.0, 1.0]), ("zero", [0.0, 0.0])], "term string, vec array<float>")
    df = spark.createDataFrame([(1, "the the cat x"), (2, "unknown"), (3, None), (4, "zero")], "id long, t string")
    out = []
    for limit in (1 << 20, 0):
        vectors = cl.WordVectors(table, max_broadcast_bytes=limit)
        assert vectors.inline == (limit > 0)
        done = vectors.add_document_vector(df, words(F.coalesce("t", F.lit(""))), "v", "id")
        out.append(rows_by_id(done, "v"))
    assert out[0] == out[1]
    assert out[0][1] == pytest.approx([2 / 3, 5 / 3]) and out[0][2] == [0.0, 0.0] == out[0][3]
    odd = spark.createDataFrame([(None, "the"), (None, "cat"), (7, "the"), (7, "cat cat the"), (7, "cat cat the")], "id long, t string")
    joined = cl.WordVectors(table, max_broadcast_bytes=0).add_document_vector(odd, words(F.col("t")), "v", "id").collect()
    near = [[round(x, 6) for x in v] for v in ([1.0, 2.0], [0.0, 1.0], [1.0, 2.0], [1 / 3, 4 / 3], [1 / 3, 4 / 3])]
    assert sorted([round(x, 6) for x in r["v"]] for r in joined) == sorted(near)


def test_cells_give_what_a_scan_gives_and_leave_cells_unread(spark, tmp_path):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 8)) * 5
    rows = [(i, (middles[i % 40] + rng.normal(size=8) * 0.1).tolist()) for i in range(4000)]
    rows += [(5000 + i, rows[7][1]) for i in range(300)]  # one vector many times
    rows += [(9000, [0.0] * 8), (9001, None), (9002, [float("nan")] * 8), (None, [1.0] * 8), (9003, [None] * 8)]
    table = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    asked = [(f"q{i}", (middles[i] + rng.normal(size=8) * 0.2).tolist()) for i in range(3)] + [("same", rows[7][1]), ("none", [0.0] * 8), ("null", None)]
    asked += [("far", rng.normal(size=8).tolist())]
    queries = spark.createDataFrame(asked, "q string, w array<double>").repartition(2)
    cells = cl.VectorCells.build(table, "id", "v", str(tmp_path / "cells"), cells=40, sample=1000)
    clean = table.where("id < 9000")
    for k in (1, 10, 400):
        want = sorted(map(tuple, cl.nearest_neighbours(queries, clean, k, "q", "w", "id", "v").collect()))
        got = sorted(map(tuple, cells.nearest(queries, k, "q", "w").select("q", "id", "score", "rank").collect()))
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-8)
    again = cl.VectorCells(spark, str(tmp_path / "cells"))
    assert again.nearest(queries.where("q = 'q1'"), 10, "q", "w").count() == 10
    assert 0 < len(again.cells_read) < 10 <= len(again.numbers)
    assert again.nearest(queries.where("false"), 3, "q", "w").count() == 0
    # Few rows, fewer than are asked for; and none.
    few = cl.VectorCells.build(table.where("id < 3"), "id", "v", str(tmp_path / "few"), cells=2)
    assert few.nearest(queries.where("q = 'q0'"), 10, "q", "w").count() == 3
    none = cl.VectorCells.build(table.where("false"), "id", "v", str(tmp_path / "none"))
    assert none.nearest(queries, 10, "q", "w").count() == 0


def test_blocks_of_a_cell(spark, tmp_path, monkeypatch):
    from corpusloom.operators import cells as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 7)
    monkeypatch.setattr(module, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(2)
    table = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(100)], "id long, v array<double>")
    cells = cl.VectorCells.build(table, "id", "v", str(tmp_path / "c"), cells=3)
    queries = table.where("id % 10 = 0").selectExpr("id AS q", "v AS w")
    got = sorted((r["q"], r["rank"], r["id"]) for r in cells.nearest(queries, 5, "q", "w").collect())
    assert got == sorted((r["q"], r["rank"], r["id"]) for r in cl.nearest_neighbours(queries, table, 5, "q", "w", "id", "v").collect())
