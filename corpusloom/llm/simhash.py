"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint has 64 bits: bit i is set if it is set in more than half of the
hashes of the text's word shingles. Two fingerprints link when they differ in
at most ``radius`` bits. Every distinct fingerprint emits all variants within
half the radius; two that link share a variant, the one half way between them.
The variants are shuffled, each bucket yields the edges to its least member,
and the edges are deduplicated and verified by counting differing bits.

A bucket holds distinct fingerprints within half the radius of its variant, at
most 65 for radius 2 whatever the input, so there is no hot bucket. Copies share one fingerprint and are one node. Components come from
star steps over the edges; only counts reach the driver.

Defined results: null and empty texts, and texts of separators only, have
fingerprint 0, which links like any other; fewer words than a shingle count as
one shingle; rows with the same id are separate documents. Null ids take part
but never name a component, unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_of, cut_lineage, in_bitmap, keyed, small_batches, unpacked, without, written
from .components import components
from .language_id import counted, merged
from .words import blocks, in_blocks

# Hashes of one text that are in memory at a time.
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned number."""
    # On bytes, both touch ASCII only: A-Z, and the blanks 09-0D and 20.
    return _fingerprint((text or "").encode("utf-8", "surrogatepass").lower().split(), size, seed)


def _fingerprint(words: list[bytes], size: int = 3, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    count = max(1, len(words) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, count, HASHES_AT_ONCE):
        stop = min(count, start + HASHES_AT_ONCE)
        part = words[start : stop + size - 1]
        shingles = map(b" ".join, zip(*[part[k : k + stop - start] for k in range(size)])) if len(words) >= size else [b" ".join(words)]
        hashes = np.array([xxh64_intdigest(s, seed) for s in shingles], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > count).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``id, th`` (a hash of the text) and ``fp``, the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def of_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        signed = lambda texts: np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64).tolist()
        yield from in_blocks(batches, signed, pa.int64())

    return keyed(docs, id_col, text_col).select("id", "th", of_texts("text").alias("fp"))


def variants(fp, radius: int):
    """All values within ``radius`` bits of ``fp``; each once."""
    one = F.array(fp)
    for k in range(radius):
        flipped = F.flatten(
            F.transform(one, lambda v: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: v.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
        )
        one = F.array_distinct(F.concat(one, flipped)) if k else F.concat(one, flipped)
    return one


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``a, b`` (a > b) between distinct fingerprints ``fp``: each differs in at most ``radius`` bits (an
    even number), and they connect just the fingerprints that such links connect.

    In a bucket all members are within half the radius of the variant, so all
    of them link to each other: the edges to the least one connect them.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be an even number of bits")
    balls = distinct.select("fp", F.explode(variants(F.col("fp"), radius // 2)).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    found = balls.select(F.col("fp").alias("a"), least.alias("b")).where("a != b").distinct()
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2
) -> DataFrame:
    """Per document ``id_col, text_hash, fingerprint`` (16 hexadecimal digits) and ``component_id``, the least id
    reachable by links."""
    return _components_of(cut_lineage(fingerprints(docs, id_col, text_col, size)), radius).select(
        F.col("id").alias(id_col), F.col("th").alias("text_hash"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def _components_of(prints: DataFrame, radius: int) -> DataFrame:
    """``prints`` (``id, th, fp``) with ``component_id``."""
    groups = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(groups.select("fp"), radius))
    linked = found.join(groups, F.col("node") == F.col("fp"))
    named = linked.groupBy("component").agg(F.min("least").alias("named"))
    of_node = linked.select("node", "component").join(named, "component")
    of_print = groups.join(of_node, F.col("fp") == F.col("node"), "left").select(
        "fp",
        F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("named")).alias("component_id"),
    )
    # A print that a third of all documents share is a hot key on the left only. Adaptive execution splits it
    # where both sides are shuffled for the join itself, so the right one is written first.
    return prints.join(written(of_print, "named"), "fp")


# --- one document of each group of similar ones -------------------------------

# For likeness of shingles a fingerprint of 64 bits is too long: texts that share 0.8 of their shingles differ in ten.
# Candidates come from the shingles themselves. Put the shingles of all texts in one order, whichever. Two sets of a
# likeness of 0.8 share that much of either, so their first common shingle is among the first fifth of both.

# Documents whose shingles are counted, so that common ones come last in the order, and the most that are kept of those.
# They only decide how many candidates there are: the pairs found are the same for any order.
COUNTED_DOCUMENTS, COMMON, COMMON_LEAST = 1 << 14, 1 << 18, 3
SIGNATURE = 1024  # bits that tell most sets that are not similar, up to some thousand shingles
HELD_HASHES = 1 << 20  # distinct shingles that a task counts before it passes them on


def _set_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` words, in order of hash; of all words if they are fewer; none of none."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*[words[k:] for k in range(size)])) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter((xxh64_intdigest(s) for s in runs), dtype=np.uint64))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _signature(hashes: np.ndarray) -> np.ndarray:
    """Of each of ``SIGNATURE`` residues, whether an odd number of the hashes has it: as 64-bit words.

    Two sets differ in at least as many shingles as their signatures do in bits.
    """
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % SIGNATURE, minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _class_of(words: list[bytes]) -> tuple[int, int]:
    """Two hashes of the words in order, as signed numbers."""
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(b" ".join(words), 7), dtype="<i8").tolist())


def _common(docs: DataFrame, size: int):
    """A broadcast of the shingles that many of some documents have, by hash, and how many have them."""
    share = min(1.0, COUNTED_DOCUMENTS / max(1, docs.count()))
    some = docs.select("text").sample(share, 7) if share < 1 else docs.select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the task's own texts; what it holds is passed on when it gets large."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def passed_on():
            hashes, numbers = merged(parts)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(numbers.astype(np.int64))], names=["h", "n"])

        for batch in batches:
            texts = batch.column("text")
            for first, stop in blocks(texts):
                sets = np.concatenate([_set_hashes(_words(t), size) for t in texts.slice(first, stop - first).to_pylist()])
                if len(sets):
                    parts.append(counted(sets))
                if len(parts) >= 16:
                    parts[:] = [merged(parts)]
                    if len(parts[0][0]) > HELD_HASHES:
                        yield passed_on()
        if parts:
            yield passed_on()

    counts = some.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    with small_batches(docs.sparkSession):
        most = counts.where(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    hashes, numbers = (most.column(c).to_numpy() for c in ("h", "n"))
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    return docs.sparkSession.sparkContext.broadcast((hashes[order], numbers[order]))


def first_shingles(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Of a set of shingles (hashes in order), those among which the first one shared with any similar set must be."""
    if not len(hashes):
        return hashes
    known, numbers = common
    counts = np.zeros(len(hashes), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        counts = np.where(known[at] == hashes, numbers[at], 0)
    least = int(np.ceil(similarity * len(hashes) - 1e-6))
    return hashes[np.lexsort((hashes, counts))[: len(hashes) - least + 1]]


def _described(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``id, th, c1, c2`` (hashes of the words in order), ``fp`` (the fingerprint), ``n`` (the number of shingles),
    ``firsts`` and ``signature``, of keyed documents."""
    common = _common(docs, size)

    @F.arrow_udf("struct<c1:long,c2:long,fp:long,n:int,firsts:array<long>,signature:array<long>>")
    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(words):
            hashes = _set_hashes(words, size)
            c1, c2 = _class_of(words)
            firsts = first_shingles(hashes, common.value, similarity).view(np.int64)
            fp = int(np.uint64(_fingerprint(words)).view(np.int64))
            return {"c1": c1, "c2": c2, "fp": fp, "n": len(hashes), "firsts": firsts, "signature": _signature(hashes)}

        lists = [(name, pa.list_(pa.int64())) for name in ("firsts", "signature")]
        kind = pa.struct([("c1", pa.int64()), ("c2", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), *lists])
        yield from in_blocks(batches, lambda texts: [one(_words(t)) for t in texts], kind)

    return docs.select("id", "th", describe("text").alias("d")).select("id", "th", "d.*")


def _ambiguous(described: DataFrame) -> DataFrame:
    """``c1`` of the classes that only ``c2`` tells apart: a handful in any corpus, and mostly none."""
    ends = described.groupBy("c1").agg(F.min("c2").alias("least"), F.max("c2").alias("greatest"))
    return written(ends.where("least != greatest").select("c1"), "ambiguous")


def _named_classes(df: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """``cid`` in place of ``c1, c2``: the first of them, or where that is ambiguous a hash of both."""
    twice = ambiguous.select("c1", F.lit(True).alias("twice"))
    cid = F.when(F.col("twice"), F.xxhash64("c1", "c2")).otherwise(F.col("c1"))
    return df.join(twice, "c1", "left").withColumn("cid", cid).drop("c1", "c2", "twice")


def _ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _shared(classes: DataFrame) -> DataFrame:
    """``bucket`` (a shingle), ``cid, n, place`` (of the shingle in the order of the text's) and ``members``, how many
    classes have it among their first ones, where that is more than one."""
    each = classes.select("cid", "n", F.posexplode("firsts").alias("place", "bucket"))
    buckets = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return written(each.join(written(buckets, "buckets"), "bucket"), "shared")


def _may_be_similar(a: str, b: str, n_a: str, n_b: str, similarity: float):
    """Whether two signatures leave room for a similarity. Always, where there is one."""
    apart = sum(F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(SIGNATURE // 64))
    return apart * F.lit(1 + similarity) <= F.lit(1 - similarity) * (F.col(n_a) + F.col(n_b)) + F.lit(1e-6)


def _stars(shared: DataFrame, signatures: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a > b`` of each class in a bucket and the one whose shingles are the most usual: of edited copies of a
    text that is mostly the text itself. No link need be here; it only leaves less for ``_rest``."""
    usual = F.sum("members").over(Window.partitionBy("cid")) / F.col("n")
    centres = shared.withColumn("usual", usual).groupBy("bucket").agg(F.max(F.struct("usual", F.col("cid").alias("c"), F.col("n").alias("m"))).alias("centre"))
    met = shared.join(written(centres.select("bucket", "centre.c", "centre.m"), "centres"), "bucket").where("cid != c")
    met = met.where(F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - F.lit(1e-6)).select(*_ordered("cid", "c")).distinct()
    return _possible(met, signatures, similarity)


def _possible(pairs: DataFrame, signatures: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose signatures leave room for a similarity."""
    for side in ("a", "b"):
        of_side = signatures.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.col("signature").alias(f"s_{side}"))
        pairs = pairs.join(of_side, side)
    return pairs.where(_may_be_similar("s_a", "s_b", "n_a", "n_b", similarity)).select("a", "b")


def _balls(classes: DataFrame, signatures: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a > b`` of classes by ball hashing: the least of each fingerprint with the others of it, and with the least
    ones of the fingerprints it links to."""
    prints = written(classes.groupBy("fp").agg(F.min("cid").alias("least")), "prints")
    same = classes.select("fp", "cid").join(prints, "fp").where("cid != least").select(*_ordered("cid", "least"))
    first, second = (prints.select(F.col("fp").alias(x), F.col("least").alias(f"least_{x}")) for x in ("a", "b"))
    near = links(prints.select("fp")).join(first, "a").join(second, "b").select(*_ordered("least_a", "least_b"))
    return _possible(same.union(near), signatures, similarity)


def _rest(shared: DataFrame, linked: DataFrame, signatures: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a > b`` of all classes that may be similar, but those that ``linked`` (``node, component``) connects already.

    In each bucket the classes of the largest component are met with those of
    others, and these with each other: no pairs within a component are made,
    and none whose signatures or places of the shingle rule a similarity out.
    """
    of_node = linked.select(F.col("node").alias("cid"), "component")
    shared = written(shared.join(of_node, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "placed")
    parts = shared.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "component")).alias("top"))
    largest = written(largest.where("parts > 1").select("bucket", F.col("top.component").alias("main")), "largest")
    split = shared.join(largest, "bucket").drop("members")
    split = written(split.join(signatures.select("cid", "signature"), "cid"), "split")
    x = split.where("component != main").select("bucket", *[F.col(c).alias(f"{c}_x") for c in ("cid", "n", "place", "component", "signature")])
    met = x.join(split, "bucket").where("component != component_x AND (component = main OR cid < cid_x)")
    # At the first shingle that a pair shares, what follows it must be enough for a similar pair.
    most = F.least(F.col("n_x") - F.col("place_x"), F.col("n") - F.col("place"))
    enough = most * F.lit(1 + similarity) >= F.lit(similarity) * (F.col("n_x") + F.col("n")) - F.lit(1e-6)
    alike = _may_be_similar("signature", "signature_x", "n", "n_x", similarity)
    return met.where(enough).where(alike).select(*_ordered("cid", "cid_x")).distinct()


def _sets(docs: DataFrame, described: DataFrame, pairs: DataFrame, ambiguous: DataFrame, size: int) -> DataFrame:
    """``cid, set``: the shingles of the classes in ``pairs`` (``a, b``).

    Texts stay in their tasks. Of each class one text hash is taken; a bitmap
    of fixed size tells nearly all other documents unread, and only hashes of
    shingles are shuffled.
    """
    cids = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    chosen = described.join(written(cids, "wanted"), "cid", "left_semi").groupBy("cid").agg(F.min("th").alias("th"))
    bitmap = bitmap_of(chosen, "th")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = in_bitmap(batch.column("th").to_numpy().view(np.uint64), bitmap.value)
            texts = batch.column("text").filter(pa.array(wanted))
            for first, stop in blocks(texts):
                words = [_words(t) for t in texts.slice(first, stop - first).to_pylist()]
                classes = [_class_of(w) for w in words]
                # 32 bits of each hash: sets of less than a billion are told apart well enough.
                sets = [np.unique(_set_hashes(w, size).astype(np.uint32)).view(np.int32) for w in words]
                columns = [pa.array([c[k] for c in classes], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.list_(pa.int32()))], names=["c1", "c2", "set"])

    sets = docs.select("th", "text").mapInArrow(shingles, "c1 long, c2 long, set array<int>")
    one = sets.groupBy("c1", "c2").agg(F.any_value("set").alias("set"))
    return written(_named_classes(one, ambiguous).select("cid", "set"), "sets")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of classes whose ``sets`` have a Jaccard similarity of ``similarity`` or more."""
    met = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("set_a")), "a")
    met = met.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    enough = common >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - common) - F.lit(1e-9)
    return written(met.where(enough).select("a", "b"), "similar")


def _groups(docs: DataFrame, described: DataFrame, classes: DataFrame, ambiguous: DataFrame, size: int, similarity: float) -> DataFrame:
    """``node, component`` of the classes (``cid, fp, n, firsts, signature``) that are similar to another."""
    shared, signatures = _shared(classes), classes.select("cid", "n", "signature")

    def similar(pairs: DataFrame) -> DataFrame:
        return _similar(pairs, _sets(docs, described, pairs, ambiguous, size), similarity)

    balls = _balls(classes, signatures, similarity)
    stars = written(_stars(shared, signatures, similarity).union(balls).distinct(), "stars")
    near = similar(stars)
    rest = written(_rest(shared, components(near), signatures, similarity).join(stars, ["a", "b"], "left_anti"), "rest")
    return components(near.union(similar(rest)))


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The rows of ``docs`` without all but one document of each group: the one with the least id (nulls last), then the
    least text hash. Of rows alike in id and text one stays.

    Groups are the components of the links between texts whose sets of shingles
    of ``size`` words have a Jaccard similarity of ``similarity`` or more.
    No link is missed: candidates are what ball hashing of the fingerprints
    links, and what shares one of its first shingles in an order of all. The
    former and stars around the most usual texts come first, then all pairs
    that these leave unconnected. Texts with the same words in order, by 128 bits of
    hash, are one class. Sets are compared by 32 bits of each shingle's hash:
    of 10,000 shingles two in a hundred pairs of sets have one that agrees by
    chance, which can only matter to a pair that is one shingle short. All
    texts without a word are one class, so one of them stays.
    """
    base = keyed(docs, id_col, text_col)
    described = written(_described(base, size, similarity), "described")
    ambiguous = _ambiguous(described)
    described = _named_classes(described, ambiguous)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    same = [F.any_value(c).alias(c) for c in ("fp", "n", "firsts", "signature")]
    classes = described.groupBy("cid").agg(F.min(place).alias("first"), *same)
    classes = written(classes, "classes")
    linked = _groups(base, described.select("cid", "th"), classes, ambiguous, size, similarity)
    of_group = linked.join(classes.select(F.col("cid").alias("node"), "first"), "node")
    heads = of_group.groupBy("component").agg(F.min("first").alias("head"))
    of_class = of_group.select("node", "component").join(heads, "component").select(F.col("node").alias("cid"), "head")
    head = classes.select("cid", "first").join(of_class, "cid", "left").select("cid", F.coalesce("head", "first").alias("head"))
    # A class that a third of all documents share is a hot key on the left only (see _components_of).
    named = described.select("id", "th", "cid").join(written(head, "heads"), "cid")
    gone = named.where(place != F.col("head")).select("id", "th").distinct()
    # The ones that stay, where rows are alike, are cut out and put back once.
    alike = named.where(place == F.col("head")).groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    alike = written(alike.select("id", "th"), "alike")
    kept = without(docs, gone.union(alike), id_col, text_col)
    again = alike.select(F.col("id").alias("a_id"), F.col("th").alias("a_th"))
    back = base.join(again, base["id"].eqNullSafe(F.col("a_id")) & (base["th"] == F.col("a_th")), "left_semi")
    return kept.union(unpacked(back.groupBy("id", "th").agg(F.any_value("row").alias("row"))))
