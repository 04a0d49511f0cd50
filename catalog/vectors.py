"""Queries on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpusloom as cl
from corpusloom.functions import arrays
from corpusloom.operators.vectors import vector_dims
from corpusloom.session import cut_lineage

from .registry import query, table
from .tables import scratch

SQL_CENTROID = """
    WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    c AS (SELECT label, pos, avg(v) AS v FROM x GROUP BY label, pos)
"""


def centroids(spark, sf):
    return cl.group_centroids(table(spark, sf, "embeddings"), "label", "embedding")


@query(
    "vector_normalized",
    """
    WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm
      FROM embeddings)
    SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos,
      round(unnest(embedding)::DOUBLE / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) AS x FROM n
    """,
)
def vector_normalized(spark, sf):
    emb = table(spark, sf, "embeddings").withColumn("u", arrays.rounded(arrays.unit(F.col("embedding"))))
    return emb.select("vec_id", F.posexplode("u").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))


@query("vector_dims", "SELECT max(len(embedding)) AS dims FROM embeddings")
def dims(spark, sf):
    """The dimension of all vectors, which ``vector_dims`` has found to be one and the same."""
    vectors = table(spark, sf, "embeddings")
    vector_dims(vectors, "embedding")
    return vectors.agg(F.max(F.size("embedding")).cast("long").alias("dims"))


@query("group_centroid", SQL_CENTROID + "SELECT label, CAST(pos AS BIGINT) AS pos, round(v, 6) AS x FROM c")
def group_centroid(spark, sf):
    spread = centroids(spark, sf).select("label", F.posexplode("centroid").alias("pos", "x"))
    return spread.select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(
    "centroid_distance",
    SQL_CENTROID
    + """SELECT a.label AS group_a, b.label AS group_b, round(sqrt(sum((a.v - b.v) ** 2)), 6) AS distance
    FROM c a JOIN c b ON a.pos = b.pos AND a.label < b.label GROUP BY a.label, b.label""",
)
def centroid_distance(spark, sf):
    out = cl.pairwise_distances(cut_lineage(centroids(spark, sf)), "label", "centroid")
    return out.withColumn("distance", F.round("distance", 6))


@query(
    "knn_many_queries",
    """
    WITH x AS (SELECT label || '-' || vec_id % 50 AS g, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    c AS (SELECT g, pos, avg(v) AS v FROM x GROUP BY g, pos),
    q AS (SELECT g, list(v ORDER BY pos) AS v FROM c GROUP BY g),
    s AS (SELECT g, vec_id, round(list_cosine_similarity(q.v, embedding::DOUBLE[]), 9) AS score FROM q, embeddings),
    k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT g, vec_id, round(score, 6) AS score, rank FROM k WHERE rank <= 10""",
)
def knn_many_queries(spark, sf):
    """Many centres, as a query set beyond the bound that goes to a task: several chunks."""
    vectors = table(spark, sf, "embeddings")
    grouped = vectors.withColumn("g", F.concat_ws("-", "label", F.col("vec_id") % 50))
    centres = cut_lineage(cl.group_centroids(grouped, "g", "embedding"))
    found = cl.nearest_neighbours(centres, vectors, 10, "g", "centroid", "vec_id", "embedding", max_broadcast_bytes=1 << 16)
    return found.select("g", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


KNN_SQL = (
    SQL_CENTROID
    + """, q AS (SELECT label, list(v ORDER BY pos) AS v FROM c GROUP BY label),
    s AS (SELECT q.label, vec_id, round(list_cosine_similarity(q.v, embedding::DOUBLE[]), 9) AS score FROM q, embeddings),
    k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT label, vec_id, round(score, 6) AS score, rank FROM k WHERE rank <= 10"""
)


@query("knn_cells", KNN_SQL)
def knn_cells(spark, sf):
    """The same from vectors stored by cell: only cells that can hold one of the ten are read."""
    stored = cl.VectorCells.build(table(spark, sf, "embeddings"), "vec_id", "embedding", scratch(spark, "cells"), cells=32)
    found = stored.nearest(cut_lineage(centroids(spark, sf)), 10, "label", "centroid", "vec_id")
    return found.select("label", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("knn_cosine", KNN_SQL)
def knn_cosine(spark, sf):
    """The ten vectors closest to the centre of each label."""
    found = cl.nearest_neighbours(
        cut_lineage(centroids(spark, sf)), table(spark, sf, "embeddings"), 10, "label", "centroid", "vec_id", "embedding"
    )
    return found.select("label", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
