"""Benchmark decontamination by winnowing.

Both sides keep, of every ``window - gram + 1`` consecutive hashes of ``gram``
words, the least one (the last of equals). A span of ``window`` words that both
sides share holds the same least hash at the same place on both sides, so every
shared span is found. Each kept fingerprint carries the hashes of the words
around it that such a span may reach; after the join a hit is extended to both
sides by comparing them, and counts if it comes to ``window`` words. Items
shorter than a window are one span of their own length: their hash is looked
up at every place of a text.

The texts are read once and never shuffled. A bitmap of fixed size over the
benchmark's hashes goes to every task and keeps nearly all other fingerprints
from the shuffle; a benchmark too large for it only lets more of them through.
Equal fingerprints with equal surroundings are one row with a list of items, so
a passage that many items share is joined once. A passage that a third of all
documents hold is a hot key of an equi-join, which adaptive execution splits.

Word hashes have 64 bits; a hit needs ``window`` (or all) of them equal in order.

Defined results: null and empty texts have no words, no hits and are not
contaminated; items without words take no part; items alike in id and text are
one; rows of documents alike in id and text are each reported. Items of null id
are one item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bitmap_of, cut_lineage, in_bitmap, keyed, without
from .words import blocks, gram_hashes, word_hashes

WINDOW, GRAM = 13, 7

# A fingerprint: ``size`` words at word ``at``; ``around`` holds word hashes, ``before`` of them before the gram.
# A size below 0 is a whole short item, which must not meet a gram of as many words. Size 0 stands for the text itself.
FOUND = pa.list_(
    pa.struct(
        [("size", pa.int32()), ("at", pa.int32()), ("fp", pa.int64()), ("around", pa.list_(pa.int64())), ("before", pa.int32())]
    )
)
FOUND_SQL = "array<struct<size:int,at:int,fp:long,around:array<long>,before:int>>"


def winnowed(grams: np.ndarray, ends: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Places of the least gram hash in each window of words, the last of equals; each place once.

    ``ends`` says for each word where its text ends; windows over an end do not count.
    """
    spread = window - gram + 1
    n = len(grams) - spread + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least, at = grams[:n].copy(), np.arange(n)
    for k in range(1, spread):
        less = grams[k : k + n] <= least
        least[less] = grams[k : k + n][less]
        at[less] = np.flatnonzero(less) + k
    return np.unique(at[np.arange(n) + window <= ends[:n]])


def _passing(hashes: np.ndarray, bitmap: bytes | None) -> np.ndarray:
    return np.ones(len(hashes), dtype=bool) if bitmap is None else in_bitmap(hashes, bitmap)


def fingerprints_of(
    texts: list[str | None], window: int, gram: int, shorts: list[int] | None = None, bitmap: bytes | None = None
) -> tuple[np.ndarray, list[list[dict]]]:
    """Words per text, and its fingerprints. Texts of a benchmark (``shorts`` None) that are shorter than a window
    have one, all of them; other texts have one at every place for each of the sizes ``shorts``."""
    hashes, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), counts)
    ends = bounds[owner + 1]
    found: list[list[dict]] = [[] for _ in texts]
    grams = gram_hashes(hashes, gram)
    places = winnowed(grams, ends, window, gram)
    places = places[_passing(grams[places], bitmap)]
    for p in places:
        lo, hi = bounds[owner[p]], ends[p]
        first, last = max(lo, p - (window - gram)), min(hi, p + window)
        found[owner[p]].append(
            {"size": gram, "at": p - lo, "fp": grams[p].view(np.int64), "around": hashes[first:last].view(np.int64), "before": p - first}
        )
    for size in range(1, window) if shorts is None else shorts:
        short = gram_hashes(hashes, size)
        if shorts is None:
            places = bounds[:-1][counts == size]
        else:
            places = np.flatnonzero(_passing(short, bitmap))
            places = places[places + size <= ends[places]]
        for p in places:
            found[owner[p]].append(
                {"size": -size, "at": p - bounds[owner[p]], "fp": short[p].view(np.int64), "around": hashes[p : p + size].view(np.int64), "before": 0}
            )
    return counts, found


def _fingerprinted(df: DataFrame, window: int, gram: int, shorts: list[int] | None = None, bitmap=None) -> DataFrame:
    """``id, th, n_words, found`` for each row of ``id, th, text``."""
    kept = df.select("id", "th")
    schema = pa.schema([*to_arrow_schema(kept.schema), pa.field("n_words", pa.int64()), pa.field("found", FOUND)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            for first, stop in blocks(batch.column("text")):
                part = batch.slice(first, stop - first)
                counts, found = fingerprints_of(part.column("text").to_pylist(), window, gram, shorts, bits)
                columns = [part.column("id"), part.column("th"), pa.array(counts, pa.int64()), pa.array(found, FOUND)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            pa.default_memory_pool().release_unused()

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return df.select("id", "th", "text").mapInArrow(work, f"{names}, n_words long, found {FOUND_SQL}")


def _in_common(a: Column, b: Column) -> Column:
    """How many entries two arrays share from their first one on."""
    unequal = F.array_position(F.zip_with(a, b, lambda x, y: x == y), False)
    least = F.least(F.size(a), F.size(b))
    return F.when(unequal > 0, F.least(unequal.cast("int") - 1, least)).otherwise(least)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    share: float = 0.05,
) -> DataFrame:
    """Per document ``id_col, text_hash, n_words, n_hit, items`` (ids of items with a window in it), ``spans`` (start and
    end, in words, of hits; they may overlap) and ``contaminated``: words are hit, at least ``share`` of all words."""
    bench = _fingerprinted(keyed(benchmark, item_col, item_text_col), window, gram)
    bench = bench.select("id", F.inline("found"))
    bench = cut_lineage(bench.groupBy("size", "fp", "around", "before").agg(F.collect_set(F.struct("id")).alias("items")))
    shorts = sorted(-r["size"] for r in bench.where("size < 0").select("size").distinct().collect())  # 12 at most
    found = _fingerprinted(keyed(docs, id_col, text_col), window, gram, shorts, bitmap_of(bench, "fp"))

    # The text itself goes along as a row that nothing meets.
    own = F.struct(
        F.lit(0).alias("size"), F.lit(0).alias("at"), F.col("th").alias("fp"), F.lit(None).cast("array<long>").alias("around"), F.lit(0).alias("before")
    )
    prints = found.select("id", "th", "n_words", F.inline(F.concat(F.array(own), "found")))
    theirs = bench.select("size", "fp", F.col("around").alias("i_around"), F.col("before").alias("i_before"), "items")
    met = prints.join(theirs, ["size", "fp"], "left")

    left = _in_common(
        F.reverse(F.slice("around", F.lit(1), F.col("before"))), F.reverse(F.slice("i_around", F.lit(1), F.col("i_before")))
    )
    # From the gram's first word on: the gram itself is compared too.
    right = _in_common(
        F.slice("around", F.col("before") + 1, F.lit(2 * window)), F.slice("i_around", F.col("i_before") + 1, F.lit(2 * window))
    )
    met = met.withColumn("left", left).withColumn("right", right)
    need = F.when(F.col("size") < 0, -F.col("size")).otherwise(F.lit(window))
    whole = F.col("items").isNotNull() & (F.col("left") + F.col("right") >= need) & (F.col("right") >= F.abs("size"))
    span = F.struct((F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end"))
    per_doc = met.groupBy("id", "th").agg(
        F.count_if(F.col("size") == 0).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(whole, span))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.when(whole, F.col("items"))))).alias("items"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["to"]))).alias("n"),
            F.greatest(acc["to"], x["end"]).alias("to"),
        ),
    )
    counted = per_doc.withColumn("n_hit", covered["n"])
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(str(share)).cast("decimal(10,6)") * F.col("n_words"))
    out = counted.select(
        F.col("id").alias(id_col), F.col("th").alias("text_hash"), "n_words", "n_hit",
        F.transform("items", lambda x: x["id"]).alias("items"), "spans", bad.alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    bad = contamination(docs, benchmark, id_col, text_col, item_col).where("contaminated")
    return without(docs, bad.select(F.col(id_col).alias("id"), F.col("text_hash").alias("th")).distinct(), id_col, text_col)
