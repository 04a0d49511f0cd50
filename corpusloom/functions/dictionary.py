"""Word dictionaries (lexicons, synonyms, word classes) for use inside row-wise expressions.

Three forms, with the same answers:

* ``inline``: a small dictionary travels in the plan as one constant, so looking
  a token up costs neither a shuffle nor a Python worker. Spark scans a map
  literal from end to end on each lookup; the constant is therefore an array of
  little maps and the key's CRC picks the one to search.
* ``broadcast``: a larger one, of a checked size, is sent once to each worker
  process and looked up there, an Arrow batch of words at a time.
* ``joined``: one of any size is joined by term. It groups by text, so it is for
  tables, not for streams.

The first two work row by row, on tables and streams alike. The joined form is
taken when it is asked for, never because of a size.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_INLINE_ENTRIES = 20_000
MAX_INLINE_BYTES = 4 << 20
# Up to so many keys are a set in the plan besides.
MAX_SET_ENTRIES = 1000
# Terms and values as text, of a dictionary that is broadcast: a few times that much in each worker process.
MAX_BROADCAST_BYTES = 256 << 20
FORMS = ("auto", "inline", "broadcast", "joined")

Lookup = Callable[[Column], Column]
_names = itertools.count()


def _bucket(key: Column, buckets: int) -> Column:
    return (F.crc32(key.cast("binary")) % F.lit(buckets)).cast("int")


class InlineDictionary:
    """String-keyed constants of a checked size, folded into the plan."""

    def __init__(self, entries: Mapping[str, Any], value_type: str):
        self.entries = dict(entries)
        self.value_type = value_type
        self.n_buckets = max(1, len(self.entries) // 2)
        buckets: list[dict] = [{} for _ in range(self.n_buckets)]
        for key, value in self.entries.items():
            buckets[zlib.crc32(key.encode("utf-8")) % self.n_buckets][key] = value
        self._json = json.dumps(buckets, ensure_ascii=False)
        if len(self.entries) > MAX_INLINE_ENTRIES or len(self._json) > MAX_INLINE_BYTES:
            raise ValueError(f"{len(self.entries)} entries are too many to carry in a plan")

    @staticmethod
    def fits(entries: Mapping[str, Any]) -> bool:
        """Whether a mapping is small enough to be carried in a plan."""
        if len(entries) > MAX_INLINE_ENTRIES:
            return False
        # Braces, quotes and commas of the form it is carried in, generously.
        return len(json.dumps(dict(entries), ensure_ascii=False)) + 8 * len(entries) + 64 <= MAX_INLINE_BYTES

    def longest_key(self) -> int:
        """Words of the longest key."""
        return max((len(k.split(" ")) for k in self.entries), default=0)

    def get(self, key: Column) -> Column:
        """The value of ``key``, or null."""
        table = F.from_json(F.lit(self._json), f"array<map<string,{self.value_type}>>")
        found = F.try_element_at(F.get(table, _bucket(key, self.n_buckets)), key)
        # Most words are not in it; a set says so in a tenth of the time.
        return F.when(key.isin(list(self.entries)), found) if 0 < len(self.entries) <= MAX_SET_ENTRIES else found

    def bind(self, df: DataFrame, keys: Column | None = None, id_col: str | None = None):
        """Same protocol as :meth:`TableDictionary.bind`; nothing to attach here."""
        return df, self.get, []


# Bits that say which keys a joined dictionary may hold: a fixed 256 KB in the plan, whatever the number of keys.
FILTER_BITS = 21


def _may_hold(table: DataFrame, key: Column) -> Lookup:
    """Whether a word may be among the keys of a table: true for all that are, and for few others unless they are very many.

    One or two aggregations now; what comes to the driver is bounded by the size of a set and the bits.
    """
    few = table.select(key.alias("key")).where("key IS NOT NULL").distinct().limit(MAX_SET_ENTRIES + 1).collect()
    if len(few) <= MAX_SET_ENTRIES:
        return lambda word: word.isin([row["key"] for row in few])
    slot = lambda k: F.shiftrightunsigned(F.xxhash64(k), 64 - FILTER_BITS)
    place = lambda k: slot(k).bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place(key))
    bits = [0] * (1 << (FILTER_BITS - 6))
    for row in table.groupBy(F.shiftright(slot(key), 6).cast("int").alias("at")).agg(F.bit_or(one).alias("bits")).collect():
        bits[row["at"]] = row["bits"]
    constant = json.dumps(bits, separators=(",", ":"))

    def test(word: Column) -> Column:
        held = F.get(F.from_json(F.lit(constant), "array<bigint>"), F.shiftright(slot(word), 6).cast("int"))
        return F.getbit(held, place(word)) == 1

    return test


def _by_bucket(hits: Column, buckets: int) -> Column:
    """An array of structs ``term, value`` as an array of little maps."""
    numbers = F.sequence(F.lit(0), F.lit(buckets - 1))
    return F.transform(numbers, lambda b: F.map_from_entries(F.filter(hits, lambda e: _bucket(e["term"], buckets) == b)))


def _from_buckets(helper: str, buckets: int) -> Lookup:
    return lambda key: F.try_element_at(F.get(F.col(helper), _bucket(key, buckets)), key)


def _heads(hits: Column) -> Column:
    return F.array_distinct(F.transform(hits, lambda e: F.get(F.split(e["term"], " "), F.lit(0))))


def salted(number: str, salts: int) -> Column:
    """One of so many salts. Never null, also for the optimizer: a test for null would be taken below all columns the number
    is made of, with their expressions written out inside one another's lambdas, to be computed for every token."""
    return F.coalesce(F.pmod(number, F.lit(salts)).cast("int"), F.lit(0))


class BroadcastDictionary:
    """A dictionary that every worker process holds once, looked up row by row in Arrow batches.

    Nothing is shuffled or grouped, so it runs on streams as on tables. What a
    row gets is bounded by its own distinct words.
    """

    ROW_BUCKETS = 64

    def __init__(self, table: DataFrame, key: str, value: Column, value_type: str, max_bytes: int = MAX_BROADCAST_BYTES):
        self.value_type = value_type
        wanted = table.select(F.col(key).alias("term"), value.cast(value_type).alias("value")).where("term IS NOT NULL")
        entries = wanted.groupBy("term").agg(F.max("value").alias("value"))
        size = F.octet_length("term") + F.octet_length(F.to_json(F.struct("value"))) + 16
        taken = entries.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
        if taken > max_bytes:
            raise ValueError(f"a dictionary of {taken} bytes is not broadcast (at most {max_bytes}): ask for form='joined'")
        found = entries.orderBy("term").toArrow().combine_chunks()
        buckets = [zlib.crc32(t.encode("utf-8")) % self.ROW_BUCKETS for t in found.column("term").to_pylist()]
        self.table = found.append_column("bucket", pa.array(buckets, pa.int64()))
        self._sent = table.sparkSession.sparkContext.broadcast(self.table)

    def longest_key(self) -> int:
        terms = self.table.column("term")
        return pc.max(pc.count_substring(terms, " ")).as_py() + 1 if len(terms) else 0

    def bind(self, df: DataFrame, keys: Column, id_col: str | None = None):
        """Same protocol as :meth:`TableDictionary.bind`."""
        sent, buckets = self._sent, self.ROW_BUCKETS
        helper = f"_dictionary_{next(_names)}"

        # The maps are made here: made by an expression, the optimizer would put them into the lambda
        # that looks words up, to be made for each word.
        @F.arrow_udf(f"array<map<string,{self.value_type}>>")
        def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            terms, values, places = (sent.value.column(c).combine_chunks() for c in ("term", "value", "bucket"))
            for words in batches:
                sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
                at = pc.index_in(words.flatten(), value_set=terms, skip_nulls=True)
                row = np.repeat(np.arange(len(words)), sizes)[pc.is_valid(at).to_numpy(zero_copy_only=False)]
                hit = at.drop_null()
                place = row * buckets + places.take(hit).to_numpy()
                order = np.argsort(place, kind="stable")
                hit = hit.take(pa.array(order))
                ends = np.searchsorted(place[order], np.arange(len(words) * buckets + 1))
                maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), terms.take(hit), values.take(hit))
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * buckets, pa.int32()), maps)

        return df.withColumn(helper, look_up(F.array_distinct(keys))), _from_buckets(helper, buckets), [helper]


class TableDictionary:
    """A dictionary of any size: joined by term, exactly.

    Rows are met by a hash of their words, not by an id: null and repeated ids
    are no matter, and texts that occur often are looked up once. Frequent
    words make the term a skewed join key, so the text side spreads each term
    over ``salts`` keys and the dictionary side repeats its rows that often;
    adaptive skew-join handling splits further. What is collected per text is
    bounded by its own distinct words. Only words are sent that may be keys,
    by a filter of fixed size; the join then decides.

    The lookup groups by text, so on a stream it runs inside ``foreachBatch``
    only; the other forms run on streams as they are.
    """

    ROW_BUCKETS = 64

    def __init__(self, table: DataFrame, key: str, value: Column, value_type: str, salts: int = 16):
        self.table = table.groupBy(F.col(key).alias("term")).agg(F.max(value.cast(value_type)).alias("value"))
        self.salts = salts
        self.value_type = value_type
        self._filters: dict[str, Lookup] = {}

    def may_hold(self, word: Column) -> Column:
        """Whether a word may be a key."""
        if "key" not in self._filters:
            self._filters["key"] = _may_hold(self.table, F.col("term"))
        return self._filters["key"](word)

    def may_open(self, word: Column) -> Column:
        """Whether a word may be the first of a key."""
        if "head" not in self._filters:
            self._filters["head"] = _may_hold(self.table, F.get(F.split("term", " "), F.lit(0)))
        return self._filters["head"](word)

    def bind(
        self, df: DataFrame, keys: Column, id_col: str | None = None, source: DataFrame | None = None, held: bool = False
    ):
        """``(df with helper columns, lookup, helper columns to drop)``; the second helper has the hits' first words.

        ``source``: the same texts to collect the keys from, before they were joined with anything else.
        ``held``: all keys have passed :meth:`may_hold`.
        """
        n = next(_names)
        helper, heads, h1, h2, words = (f"_dictionary_{n}{x}" for x in ("", "_heads", "_h1", "_h2", "_words"))

        def hashed(rows: DataFrame) -> DataFrame:
            # In order, so that texts with the same hits are one.
            rows = rows.withColumn(words, F.array_sort(F.array_distinct(keys if held else F.filter(keys, self.may_hold))))
            return rows.withColumns({h1: F.xxhash64(words), h2: F.xxhash64(F.lit("second"), words)})

        df = hashed(df)
        # explode() would have the optimizer test the array for emptiness below the columns it is made
        # of, with their expressions written out inside its lambdas; a null term meets nothing anyway.
        terms = (
            (df if source is None else hashed(source))
            .select(F.col(h1).alias("_h1"), F.col(h2).alias("_h2"), F.explode_outer(words).alias("term"))
            .distinct()
            .withColumn("salt", salted("_h2", self.salts))
        )
        spread = self.table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))
        hits = (
            terms.join(spread, ["term", "salt"])
            .groupBy("_h1", "_h2")
            .agg(F.collect_list(F.struct("term", "value")).alias("_hits"))
        )
        buckets = _by_bucket(F.col("_hits"), self.ROW_BUCKETS)
        hits = hits.select("_h1", "_h2", buckets.alias(helper), _heads(F.col("_hits")).alias(heads))
        joined = df.join(hits, (df[h1] == hits["_h1"]) & (df[h2] == hits["_h2"]), "left").drop("_h1", "_h2", h1, h2, words)
        return joined, _from_buckets(helper, self.ROW_BUCKETS), [helper, heads]

    def longest_key(self) -> int:
        return self.table.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 0


def mapping_table(entries: Mapping[str, Any], value_type: str) -> DataFrame:
    """A Python mapping as a table ``(term, value)``."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError("a dictionary of this size becomes a table and needs a running session")
    rows = [(k, json.dumps({"value": v}, ensure_ascii=False)) for k, v in entries.items()]
    table = spark.createDataFrame(rows, "term string, json string")
    return table.select("term", F.from_json("json", f"struct<value:{value_type}>")["value"].alias("value"))


Dictionary = InlineDictionary | BroadcastDictionary | TableDictionary


def dictionary(
    source: Mapping[str, Any] | DataFrame | Dictionary,
    key: str = "term",
    value: str | Column = "value",
    value_type: str = "string",
    form: str = "auto",
) -> Dictionary:
    """A dictionary in one of its ``FORMS``; all give the same results.

    ``auto`` is inline for up to 20,000 entries and 4 MB, found out by fetching
    one row more than that at most, and broadcast beyond. A dictionary over the
    bound of its form is refused. When a key occurs twice in a table the
    greatest value counts.
    """
    if form not in FORMS:
        raise ValueError(f"form is one of {FORMS}, not {form!r}")
    if isinstance(source, Dictionary):
        return source
    if isinstance(source, Mapping):
        if form == "inline" or form == "auto" and InlineDictionary.fits(source):
            return InlineDictionary(source, value_type)
        source, key, value = mapping_table(source, value_type), "term", "value"
    value_col = F.col(value) if isinstance(value, str) else value
    wanted = source.select(F.col(key).alias("term"), value_col.cast(value_type).alias("value")).where(
        F.col("term").isNotNull()
    )
    if form in ("auto", "inline"):
        probe = (
            wanted.groupBy("term")
            .agg(F.max("value").alias("value"))
            .select("term", F.to_json(F.struct("value")).alias("json"))
            .limit(MAX_INLINE_ENTRIES + 1)
            .collect()
        )
        entries = {r["term"]: json.loads(r["json"]).get("value") for r in probe}
        if form == "inline" or InlineDictionary.fits(entries):
            return InlineDictionary(entries, value_type)
    kind = TableDictionary if form == "joined" else BroadcastDictionary
    return kind(wanted, "term", F.col("value"), value_type)
