"""Token ids in binary shards, in an order fixed by a key.

Documents become token ids, each with an end mark, and each task cuts its
stream into sequences of one length. Every sequence has a number from 0 to
N - 1, and a keyed Feistel network with cycle-walking maps the numbers one to
one onto slots. A shard holds a range of slots as records of one size, so a
reader finds any slot by arithmetic, reads on from there, and may stop and go
on anywhere.

Tokens are written once to the shared folder before N is known, and shuffled
once (compressed by sequence) to the shard they belong to, which one task
writes in order of slot. What comes to the driver is a count per input
partition. A shard is written under another name and then renamed; one that is
there with its full size is not written again, so a job can be repeated after a
loss. The vocabulary file is read by the driver and broadcast.

Defined results: null and empty texts are an end mark only; the last sequence
of a task is filled up with end marks, ``n_tokens`` says how many ids count; an
empty table has no shards; rows are tokenised as often as they occur.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.session import shared_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the vocabulary cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQUENCE, SHARD_SEQUENCES = 4096, 4096
ROUNDS = 6
# Between these, the pattern always cuts: a long text can be encoded in pieces without any effect on its ids.
_SAFE_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
PIECE = 1 << 20


def _round(half: np.ndarray, key: int, number: int) -> np.ndarray:
    h = half + np.uint64((key * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 .. n - 1 for each key; ``numbers`` are taken to their places."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    out = np.array(numbers, dtype=np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        left, right = out[todo] >> shift, out[todo] & mask
        for number in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, number) & mask)
        out[todo] = left << shift | right
        # The network permutes a power of four; from outside the range it is walked until it comes back in.
        todo &= out >= np.uint64(n)
    return out.astype(np.int64)


def encoder(ranks_file: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, encoding, end: int, dtype) -> Iterator[np.ndarray]:
    """The ids of a text in pieces, the end mark last."""
    text, at = text or "", 0
    while len(text) - at > PIECE:
        cut = _SAFE_CUT.search(text, at + PIECE)
        if cut is None:
            break
        yield np.array(encoding.encode_ordinary(text[at : cut.start()]), dtype=dtype)
        at = cut.start()
    yield np.array([*encoding.encode_ordinary(text[at:]), end], dtype=dtype)


@dataclass
class Shards:
    """What a reader has to know; kept as ``manifest.json`` beside the shards."""

    folder: str
    sequences: int
    sequence: int
    shard_sequences: int
    dtype: str
    end: int
    key: int

    @property
    def stride(self) -> int:
        return self.sequence * np.dtype(self.dtype).itemsize

    def name(self, shard: int) -> str:
        return f"shard-{shard:08d}.bin"

    def place(self, slot: int) -> tuple[int, int]:
        """(shard, byte) at which a slot begins."""
        return slot // self.shard_sequences, slot % self.shard_sequences * self.stride


def _files(folder: str):
    """File system and path of a folder that all tasks share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder else folder)


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _sequences(docs: DataFrame, id_col: str, text_col: str, vocabulary, end: int, length: int, dtype: str) -> DataFrame:
    """``part, pos, n_tokens, ids, tokens``: each task's stream of ids in sequences, the tokens as bytes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    arrow_id = to_arrow_type(id_type)
    schema = pa.schema(
        [("part", pa.int32()), ("pos", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(arrow_id)), ("tokens", pa.binary())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part, pos = encoder(vocabulary.value), TaskContext.get().partitionId(), 0
        held, ids, n = [], [], 0

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

        done: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("id"), batch.column("text")):
                doc_id = doc_id.as_py()
                for tokens in token_ids(text.as_py(), encoding, end, dtype):
                    while len(tokens):
                        some = tokens[: length - n]
                        held.append(some)
                        if not ids or ids[-1] != doc_id:
                            ids.append(doc_id)
                        n += len(some)
                        tokens = tokens[len(some) :]
                        if n == length:
                            done.append((part, pos, n, ids, np.concatenate(held).tobytes()))
                            held, ids, n, pos = [], [], 0, pos + 1
                        if len(done) == 256:
                            yield batch_of(done)
                            done = []
        if n:
            filled = np.concatenate([*held, np.full(length - n, end, dtype=dtype)])
            done.append((part, pos, n, ids, filled.tobytes()))
        if done:
            yield batch_of(done)

    return rows.mapInArrow(cut, f"part int, pos long, n_tokens int, ids array<{id_type.simpleString()}>, tokens binary")


def write_shards(
    docs: DataFrame,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    sequence: int = SEQUENCE,
    shard_sequences: int = SHARD_SEQUENCES,
    key: int = 20240229,
) -> tuple[Shards, DataFrame]:
    """Write the shards below ``folder`` (a new one in the shared folder if None).

    Returns what a reader needs, and the index, a table in the same folder:
    ``slot, number, shard, n_tokens, ids`` (the documents in the sequence).
    """
    spark = docs.sparkSession
    folder = _qualified(spark, folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    end = len(ranks.splitlines())  # the first free id
    dtype = "<u2" if end < 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(ranks)
    # Not below the shards' folder: it is removed when they are there.
    stored = _qualified(spark, f"{shared_folder(spark)}/sequences-{uuid.uuid4().hex}")
    cut = _sequences(docs, id_col, text_col, shared, end, sequence, dtype)
    cut.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(stored)
    cut = spark.read.schema(cut.schema).parquet(stored)

    counts = {r["part"]: r["n"] for r in cut.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per partition
    offsets, total = {}, 0
    for part in sorted(counts):
        offsets[part], total = total, total + counts[part]
    made = Shards(folder, total, sequence, shard_sequences, dtype, end, key)
    starts = spark.sparkContext.broadcast(offsets)
    n_shards = max(1, -(-total // shard_sequences))
    ids_type = cut.schema["ids"].dataType
    moved_schema = pa.schema(
        [("slot", pa.int64()), ("number", pa.int64()), ("shard", pa.int32()), ("n_tokens", pa.int32()), ("ids", to_arrow_type(ids_type)), ("packed", pa.binary())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            numbers = batch.column("pos").to_numpy(zero_copy_only=False) + np.array([starts.value[p] for p in parts], dtype=np.int64)
            slots = permuted(numbers, total, key)
            packed = pa.array([codec.compress(t.as_buffer(), asbytes=True) for t in batch.column("tokens")], pa.binary())
            columns = [pa.array(slots), pa.array(numbers), pa.array((slots // shard_sequences).astype(np.int32)), batch.column("n_tokens"), batch.column("ids"), packed]
            yield pa.RecordBatch.from_arrays(columns, schema=moved_schema)

    ids_sql = ids_type.simpleString()
    moved = cut.mapInArrow(place, f"slot long, number long, shard int, n_tokens int, ids {ids_sql}, packed binary")
    # One range of slots to one task.
    moved = moved.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        codec = pa.Codec("zstd")
        shard, out, temporary = None, None, ""

        def close():
            if out is not None:
                out.close()
                files.move(temporary, f"{root}/{made.name(shard)}")

        for batch in batches:
            shards = batch.column("shard").to_pylist()
            for s, packed in zip(shards, batch.column("packed")):
                if s != shard:
                    close()
                    shard, out = s, None
                    info = files.get_file_info(f"{root}/{made.name(s)}")
                    full = min(shard_sequences, total - s * shard_sequences) * made.stride
                    if not info.is_file or info.size != full:
                        temporary = f"{root}/.{made.name(s)}.{uuid.uuid4().hex}"
                        out = files.open_output_stream(temporary)
                if out is not None:
                    out.write(codec.decompress(packed.as_buffer(), made.stride))
            yield batch.drop_columns(["packed"])
        close()

    index = moved.mapInArrow(write, f"slot long, number long, shard int, n_tokens int, ids {ids_sql}")
    index.write.mode("overwrite").parquet(f"{folder}/index")
    files, root = _files(folder)
    with files.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(asdict(made)).encode())
    stored_path = spark._jvm.org.apache.hadoop.fs.Path(stored)
    stored_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(stored_path, True)
    return made, spark.read.schema(index.schema).parquet(f"{folder}/index")


def read_slots(made: Shards, first: int, stop: int) -> Iterator[np.ndarray]:
    """The ids of the slots from ``first`` to before ``stop``, in order, each file opened once."""
    files, root = _files(made.folder)
    slot = first
    while slot < min(stop, made.sequences):
        shard, at = made.place(slot)
        with files.open_input_file(f"{root}/{made.name(shard)}") as f:
            f.seek(at)
            for slot in range(slot, min(stop, made.sequences, (shard + 1) * made.shard_sequences)):  # noqa: B020
                yield np.frombuffer(f.read(made.stride), dtype=made.dtype)
        slot += 1


def read_index(made: Shards, index: DataFrame, column: str, kind: str, of_tokens) -> DataFrame:
    """The index with ``column``: what ``of_tokens`` makes of the ids of each slot, read from the shards."""

    @F.pandas_udf(kind)
    def read(slots):
        import pandas as pd

        order = np.argsort(slots.to_numpy(), kind="stable")
        out = np.empty(len(slots), dtype=object)
        where = slots.to_numpy()[order]
        breaks = np.flatnonzero(np.diff(where) != 1) + 1
        for run in np.split(np.arange(len(where)), breaks):
            if len(run):
                for k, ids in zip(run, read_slots(made, int(where[run[0]]), int(where[run[-1]]) + 1)):
                    out[order[k]] = of_tokens(ids)
        return pd.Series(out)

    return index.withColumn(column, read("slot"))
