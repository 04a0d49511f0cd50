"""Vectors: dimensions, document vectors, group centroids, distances, nearest neighbours.

Numeric work runs in numpy over Arrow batches inside tasks; Spark partitions
the rows and merges the small partial results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.batches import in_pieces
from ..functions.dictionary import salted

# Sides sent whole to every task may not exceed this.
MAX_BROADCAST_BYTES = 64 << 20
# Rows per block where every two groups meet.
BLOCK_ROWS = 8192
# Scores that are in a task's memory at a time, whatever the numbers of rows and queries.
SCORES_AT_ONCE = 1 << 22
# Tasks' best rows are brought together in two steps, so that no task holds those of all tasks for a query.
MERGE_PARTS = 64
# Scores are compared at this many digits, so that equal vectors tie whatever
# batch they came in; ties go to the smaller id.
SCORE_DIGITS = 9
# Word vectors gathered in one go while averaging; bounds a worker's memory.
TOKENS_AT_ONCE = 1 << 15


def vector_dims(df: DataFrame, *cols: str) -> dict[str, int]:
    """Dimension of each vector column; vectors of unequal length are an error."""
    ends = [f(F.size(c)).alias(f"{c}.{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    row = df.agg(*ends).first()
    dims = {}
    for c in cols:
        lo, hi = row[f"{c}.lo"], row[f"{c}.hi"]
        if lo is None:
            raise ValueError(f"column {c} holds no vector")
        if lo != hi:
            raise ValueError(f"column {c} holds vectors of {lo} to {hi} dimensions")
        dims[c] = hi
    return dims


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An Arrow list column without nulls as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return flat.reshape(0, 0)
    lengths = pc.list_value_length(column)
    if pc.min(lengths).as_py() != pc.max(lengths).as_py():
        raise ValueError("vectors differ in length")
    return flat.reshape(n, -1)


# --- group centroids -------------------------------------------------------


def group_centroids(df: DataFrame, group: str, vec: str, out_col: str = "centroid") -> DataFrame:
    """Mean vector per group, rows without a vector left out.

    Every Arrow batch is summed per group before anything is shuffled, so a
    group holding most of the rows costs the shuffle no more than another.
    """
    rows = df.where(F.col(vec).isNotNull()).select(F.col(group).alias("g"), F.col(vec).alias("v"))
    group_type = df.schema[group].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = _matrix(batch.column("v"))
            coded = batch.column("g").dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            sums = np.add.reduceat(vectors[order], starts, axis=0)
            present = codes[order][starts]
            counts = np.bincount(codes, minlength=len(coded.dictionary))[present]
            offsets = np.arange(len(present) + 1, dtype=np.int32) * vectors.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pc.take(coded.dictionary, pa.array(present)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel())),
                    pa.array(counts.astype(np.int64)),
                ],
                names=["g", "s", "n"],
            )

    sums = rows.mapInArrow(partial, f"g {group_type}, s array<double>, n long")
    means = (
        sums.select("g", "n", F.posexplode("s").alias("pos", "x"))
        .groupBy("g", "pos")
        .agg((F.sum("x") / F.sum("n")).alias("x"))
    )
    return means.groupBy(F.col("g").alias(group)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias(out_col)
    )


def pairwise_distances(centroids: DataFrame, group: str, vec: str, block_rows: int = BLOCK_ROWS // 16) -> DataFrame:
    """Euclidean distance of every two centroids, each pair once, smaller group first.

    This is the condensed matrix a hierarchical clustering starts from, and as
    long by definition. Blocks of centroids meet in separate tasks.
    """
    n = centroids.count()
    blocks = max(1, -(-n // block_rows))
    keyed = centroids.select(
        F.col(group).alias("g"),
        F.col(vec).cast("array<double>").alias("v"),
        F.pmod(F.xxhash64(group), F.lit(blocks)).cast("int").alias("b"),
    )
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = keyed.select("g", "v", "b", F.explode(every).alias("other")).where("b <= other")
    # Other names than on the left: both sides come from one table.
    right = keyed.select(
        F.col("g").alias("h"), F.col("v").alias("w"), F.col("b").alias("later"), F.explode(every).alias("first")
    ).where("first <= later")
    group_type = centroids.schema[group].dataType.simpleString()

    kind = to_arrow_type(centroids.schema[group].dataType)

    def distances(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(a) and len(b):  # a block may be empty
            va, vb = _matrix(a.column("v")), _matrix(b.column("w"))
            ga, gb = (np.asarray(x.to_pylist(), dtype=object) for x in (a.column("g"), b.column("h")))
            same = a.column("b")[0].as_py() == b.column("later")[0].as_py()
            for i in range(len(ga)):
                gaps = np.sqrt(((vb - va[i]) ** 2).sum(axis=1))
                keep = np.flatnonzero(gb > ga[i]) if same else np.arange(len(gb))
                found += [(min(ga[i], gb[j]), max(ga[i], gb[j]), float(gaps[j])) for j in keep]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table(
            {
                "group_a": pa.array(columns[0], kind),
                "group_b": pa.array(columns[1], kind),
                "distance": pa.array(columns[2], pa.float64()),
            }
        )

    return (
        left.groupBy("b", "other")
        .cogroup(right.groupBy("first", "later"))
        .applyInArrow(distances, f"group_a {group_type}, group_b {group_type}, distance double")
    )


# --- nearest neighbours ----------------------------------------------------


def _directions(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        bar = -np.partition(-scores, k - 1)[k - 1]
        near = np.flatnonzero(scores >= bar)
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    return np.asarray(column.to_pylist(), dtype=str)


def _neighbour_table(q_ids, tops, q_type, id_type) -> dict:
    queries, ids, scores = [], [], []
    for q, (s, i) in zip(q_ids, tops):
        queries += [q] * len(i)
        ids.append(i)
        scores.append(s)
    flat = np.concatenate(ids) if ids else np.array([])
    return {
        "q": pa.array(queries, q_type),
        "id": pa.array(flat.tolist(), id_type),
        "score": pa.array(np.concatenate(scores) if scores else np.array([], dtype=float), pa.float64()),
    }


def nearest_neighbours(
    queries: DataFrame,
    table: DataFrame,
    k: int,
    query_id: str,
    query_vec: str,
    id_col: str,
    vec_col: str,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """The ``k`` most cosine-similar rows of ``table`` for each query, exactly.

    Result: the query id, the row id, ``score`` and ``rank`` from 1. Vectors of
    length zero have no direction and are nobody's neighbours.

    Queries go to every task in chunks within the size bound; the table is
    scanned once for each chunk and never shuffled, and each task keeps its own
    best ``k``. A task's memory does not depend on the number of queries.
    """
    q = queries.where(F.col(query_vec).isNotNull()).select(
        F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("v")
    )
    t = table.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")
    )
    q_type, id_type = (d.schema[c].dataType.simpleString() for d, c in ((q, "q"), (t, "id")))
    out = f"q {q_type}, id {id_type}, score double"
    size = q.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    total = (size["n"] or 0) * (size["d"] or 0) * 8
    chunks = max(1, -(-total // max(1, max_broadcast_bytes)))
    dealt = q.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks))) if chunks > 1 else None
    best = None
    for chunk in range(chunks):
        some = q if dealt is None else dealt.where(F.col("chunk") == chunk).select("q", "v")
        # Sent from a file: the driver holds one chunk at a time.
        scanned = t.mapInArrow(_scan_with(t.sparkSession.sparkContext.broadcast(some.toArrow()), k), out)
        best = scanned if best is None else best.unionAll(scanned)
    best = best.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(MERGE_PARTS)))
    first = Window.partitionBy("q", "part").orderBy(F.desc("score"), "id")
    best = best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    rank = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return (
        best.withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")
    )


def _scan_with(sent, k: int):
    """A task function: best ``k`` rows of a partition for each of a few queries, a broadcast table."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_table = sent.value
        q_ids = query_table.column("q").to_pylist()
        q_type = query_table.schema.field("q").type
        directions = _directions(_matrix(query_table.column("v"))) if len(q_ids) else np.zeros((0, 0))
        live = [j for j in range(len(q_ids)) if directions[j].any()]
        q_live, d_live = [q_ids[j] for j in live], directions[live]
        tops: list | None = None
        id_type = None
        for batch in batches:
            if batch.num_rows == 0 or not live:
                continue
            vectors, ids = _matrix(batch.column("v")), _ids(batch.column("id"))
            id_type = batch.column("id").type
            nonzero = vectors.any(axis=1)
            ids = ids[nonzero]
            rows = _directions(vectors[nonzero])
            tile = max(1, SCORES_AT_ONCE // max(1, len(rows)))
            new = []
            for first in range(0, len(q_live), tile):
                scores = np.round(d_live[first : first + tile] @ rows.T, SCORE_DIGITS)
                new += [_best(s, ids, k) for s in scores]
            if tops is None:
                tops = new
            else:
                tops = [
                    _best(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), k) for a, b in zip(tops, new)
                ]
        if tops is not None:
            yield pa.RecordBatch.from_pydict(_neighbour_table(q_live, tops, q_type, id_type))

    return scan


def approximate_neighbours(
    queries: DataFrame,
    table: DataFrame,
    k: int,
    query_id: str,
    query_vec: str,
    id_col: str,
    vec_col: str,
    bucket_length: float = 0.5,
    tables: int = 4,
    radius: float = 1.0,
) -> DataFrame:
    """Like :func:`nearest_neighbours`, by random-projection hashing: may miss some.

    For query sets so large that a scan for each chunk of queries is out of
    reach. Rows farther than ``radius`` on the unit sphere (1.0: a cosine below
    0.5) are never found, so a query may get fewer than ``k`` rows.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from ..functions.arrays import norm, unit

    def side(df: DataFrame, key: str, vec: str, name: str) -> DataFrame:
        rows = df.where(F.col(vec).isNotNull() & (norm(F.col(vec)) > 0))
        return rows.select(F.col(key).alias(name), array_to_vector(unit(F.col(vec))).alias("features"))

    a, b = side(queries, query_id, query_vec, "q"), side(table, id_col, vec_col, "id")
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=1
    ).fit(b)
    pairs = lsh.approxSimilarityJoin(a, b, radius, distCol="gap")
    rank = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    # On unit vectors: cosine = 1 - gap² / 2.
    return (
        pairs.select("datasetA.q", "datasetB.id", F.round(1 - F.col("gap") * F.col("gap") / 2, SCORE_DIGITS).alias("score"))
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")
    )


# --- document vectors ------------------------------------------------------


class WordVectors:
    """A table ``(term, vec)`` used to average the word vectors of a text.

    Within the size bound the vectors are sent to the workers once and texts
    are averaged row by row (works on streams). Beyond it the words of each
    text are joined with the table, with the same results; see :meth:`_joined`.
    """

    def __init__(
        self,
        table: DataFrame,
        term: str = "term",
        vec: str = "vec",
        max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
        salts: int = 16,
    ):
        self.table = table.where(F.col(vec).isNotNull()).select(
            F.col(term).alias("term"), F.col(vec).cast("array<float>").alias("vec")
        )
        self.salts = salts
        size = self.table.agg(
            F.count("*").alias("n"),
            F.min(F.size("vec")).alias("lo"),
            F.max(F.size("vec")).alias("dims"),
            F.sum(F.octet_length("term")).alias("bytes"),
        ).first()
        if size["n"] and size["lo"] != size["dims"]:
            raise ValueError("word vectors differ in length")
        self.dims = size["dims"] or 0
        # A word costs its vector, its spelling and its place in a hash table.
        self.bytes = size["n"] * (self.dims * 4 + 120) + (size["bytes"] or 0)
        self.inline = self.bytes <= max_broadcast_bytes
        self._shared = None

    def _broadcast(self):
        if self._shared is None:
            rows = self.table.toArrow()
            matrix = _matrix(rows.column("vec")).astype(np.float32)
            self._shared = self.table.sparkSession.sparkContext.broadcast((rows.column("term").to_pylist(), matrix))
        return self._shared

    def add_document_vector(self, df: DataFrame, words: Column, out_col: str, id_col: str | None = None) -> DataFrame:
        """Mean vector of the known words of a text; the zero vector if none is known."""
        if self.inline:
            return df.withColumn(out_col, _mean_vector(self._broadcast(), self.dims)(words))
        return self._joined(df, words, out_col)

    def _joined(self, df: DataFrame, words: Column, out_col: str) -> DataFrame:
        """Join the distinct words of each text with their vectors, and add up.

        Rows are met by a hash of their words, so no id is needed. Each text's
        words are counted before anything is shuffled. Equal texts add to the
        same sums, which leaves their mean as it is. The join key is spread
        over ``salts`` values since common words occur in most texts. Each task
        adds up the vectors it has for a text before they are shuffled again.
        """
        h1, h2, held = (f"_{out_col}_{x}" for x in ("h1", "h2", "words"))
        df = df.withColumn(held, words)
        df = df.withColumns({h1: F.xxhash64(held), h2: F.xxhash64(F.lit("second"), held)})
        # Not explode(), see TableDictionary.bind; a null term meets nothing.
        each = F.explode_outer(_counted_words(F.col(held)))
        pairs = df.select(F.col(h1).alias("_h1"), F.col(h2).alias("_h2"), each.alias("w"))
        counted = pairs.select("_h1", "_h2", "w.term", "w.n", salted("_h2", self.salts).alias("salt"))
        spread = self.table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))
        sums = [F.sum(F.col("n") * F.get("vec", F.lit(j)).cast("double")).alias(f"s{j}") for j in range(self.dims)]
        means = (
            counted.join(spread, ["term", "salt"])
            .groupBy("_h1", "_h2")
            .agg(F.sum("n").alias("total"), *sums)
            .select("_h1", "_h2", F.array(*[F.col(f"s{j}") / F.col("total") for j in range(self.dims)]).alias(out_col))
        )
        zero = F.array_repeat(F.lit(0.0), self.dims)
        joined = df.join(means, (df[h1] == means["_h1"]) & (df[h2] == means["_h2"]), "left")
        return joined.drop("_h1", "_h2", h1, h2, held).withColumn(out_col, F.coalesce(F.col(out_col), zero))


def _counted_words(words: Column) -> Column:
    """The distinct words of a list, each with how often it is there."""

    def count(arrays: pa.Array) -> pa.Array:
        coded = arrays.flatten().dictionary_encode()
        lengths = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        known = len(coded.dictionary) + 1
        codes = pc.fill_null(coded.indices, known - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        found, numbers = np.unique(np.repeat(np.arange(len(arrays)), lengths) * known + codes, return_counts=True)
        ends = np.searchsorted(found, np.arange(len(arrays) + 1) * known).astype(np.int32)
        place = found % known
        terms = pc.take(coded.dictionary, pa.array(place, pa.int64(), mask=place == known - 1))
        pairs = pa.StructArray.from_arrays([terms, pa.array(numbers.astype(np.int64))], names=["term", "n"])
        return pa.ListArray.from_arrays(pa.array(ends), pairs)

    @F.arrow_udf("array<struct<term:string,n:bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_pieces(batches, count)

    return run(words)


def _mean_vector(shared, dims: int):
    @F.arrow_udf("array<double>")
    def mean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms, matrix = shared.value
        row_of = {t: i for i, t in enumerate(terms)}
        for words in batches:
            coded = words.flatten().dictionary_encode()
            rows = np.array([row_of.get(w, -1) for w in coded.dictionary.to_pylist()], dtype=np.int64)
            token_rows = rows[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.array([], np.int64)
            lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(words)), lengths)[token_rows >= 0]
            known = token_rows[token_rows >= 0]
            sums = np.zeros((len(words), dims))
            # Tokens come in order of their text, so in each slice a text is one run.
            for at in range(0, len(known), TOKENS_AT_ONCE):
                part = owner[at : at + TOKENS_AT_ONCE]
                starts = np.flatnonzero(np.diff(part, prepend=-1))
                vectors = matrix[known[at : at + TOKENS_AT_ONCE]].astype(np.float64)
                sums[part[starts]] += np.add.reduceat(vectors, starts, axis=0)
            counts = np.bincount(owner, minlength=len(words))
            sums /= np.maximum(counts, 1)[:, None]
            offsets = np.arange(len(words) + 1, dtype=np.int32) * dims
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))

    return mean
