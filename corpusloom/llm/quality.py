"""Quality classifier: learned vectors of hashed words, word pairs and character n-grams, averaged per document.

Each word counts with its own bucket and those of its character n-grams (with
a mark before and after it), each pair of neighbouring words with one, where a
word that repeats the one before counts as "the same again", and the end of
the text with one. A document is the average of the vectors of all its
buckets; a softmax layer on top gives the probability of each class. Vectors
and layer are learned together by stochastic gradient descent in numpy.

The model is fit on a bounded sample: the ``sample`` labelled documents whose
ids have the least hashes, each with its whole text. Their buckets are counted
where the texts are; only the counts, for at most ``sample`` documents, meet
in the one task that trains. What leaves it is, for each bucket, what it adds
to each class: vectors and layer are linear up to the softmax, so their product
tells the same. That table (``1 << bits`` rows of two numbers, half a MB) is
broadcast, and scoring is a map over all documents without a shuffle. The task
that trains holds 8 bytes for each bucket a document has: some 20 kB for a
text of 3,000 characters, ``8 << bits`` bytes for one however long.

Defined results: a label is the mean over the rows of an id, 1 from a half on;
null labels and ids without a document are left out; of documents of one id the
text with the least hash is learned; null and empty texts consist of their end
only, and get the score of that; without any label all scores are one half, and
with one class only they lean to it. Scores depend on nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_hash, unpacked
from .words import gram_hashes, mapped_blocks, mixed

SAMPLE = 1 << 12
CLASSES = 2
BEFORE, AFTER = "\x02", "\x03"
SAME_AGAIN, TEXT_END = np.uint64(1), np.uint64(2)  # in place of the hash of a word pair, and of a word


@dataclass(frozen=True)
class Settings:
    bits: int = 16  # of a bucket's number
    shortest: int = 2  # characters of an n-gram, marks included
    longest: int = 4
    dims: int = 8
    epochs: int = 4
    rate: float = 4.0
    seed: int = 17


class Features:
    """The buckets of a block of texts: of each distinct word, and of each pair in order."""

    def __init__(self, texts: list[str | None], settings: Settings):
        bucket = lambda hashes: (mixed(hashes) >> np.uint64(64 - settings.bits)).astype(np.int64)
        numbers: dict[str, int] = {}
        split = [(t or "").split() for t in texts]
        # Of each text, the numbers of its words.
        self.sizes = np.array([len(words) for words in split], dtype=np.int64)
        self.words = np.array([numbers.setdefault(w, len(numbers)) for words in split for w in words], dtype=np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        # Of each distinct word, its characters between two marks, all words in a row.
        flat = "".join([f"{BEFORE}{w}{AFTER}" for w in numbers]).encode("utf-32-le", "surrogatepass")
        chars = np.frombuffer(flat, dtype="<u4").astype(np.uint64)
        lengths = np.fromiter(map(len, numbers), dtype=np.int64, count=len(numbers)) + 2
        owner = np.repeat(np.arange(len(numbers)), lengths)
        starts = np.cumsum(lengths) - lengths
        weights = np.uint64(0x9E3779B97F4A7C15) ** (np.arange(len(chars)) - np.repeat(starts, lengths)).astype(np.uint64)
        whole = np.add.reduceat(mixed(chars) * weights, starts) if len(numbers) else np.zeros(0, dtype=np.uint64)
        buckets, owners = [bucket(whole)], [np.arange(len(numbers))]
        for n in range(settings.shortest, settings.longest + 1):
            grams = gram_hashes(chars, n)
            inside = owner[: len(grams)] == owner[n - 1 :]
            buckets.append(bucket(grams[inside]))
            owners.append(owner[: len(grams)][inside])
        # Per distinct word its buckets, in one row from ``first`` on.
        owners = np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        self.buckets, self.owners = np.concatenate(buckets)[order], owners[order]
        self.counts = np.bincount(owners, minlength=len(numbers))
        self.first = np.cumsum(self.counts) - self.counts
        hashes = whole[self.words]
        same = self.words[1:] == self.words[:-1]
        pairs = np.where(same, SAME_AGAIN, hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:] + np.uint64(3))
        in_text = self.text[1:] == self.text[:-1]
        self.pairs, self.pair_text = bucket(pairs[in_text]), self.text[1:][in_text]
        self.end = int(bucket(np.array([TEXT_END]))[0])

    def bags(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text its buckets and how often it has each."""
        words = np.searchsorted(self.text, np.arange(len(self.sizes) + 1))
        pairs = np.searchsorted(self.pair_text, np.arange(len(self.sizes) + 1))
        for i in range(len(self.sizes)):
            distinct, times = np.unique(self.words[words[i] : words[i + 1]], return_counts=True)
            n = self.counts[distinct]
            place = np.repeat(self.first[distinct] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            all_buckets = np.concatenate([self.buckets[place], self.pairs[pairs[i] : pairs[i + 1]], [self.end]])
            all_times = np.concatenate([np.repeat(times, n), np.ones(pairs[i + 1] - pairs[i] + 1, dtype=np.int64)])
            buckets, at = np.unique(all_buckets, return_inverse=True)
            yield buckets, np.bincount(at, weights=all_times)

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Per text the probability of the last class, by a table of what each bucket adds to each class."""
        n = len(self.sizes)
        of_words = np.stack([np.bincount(self.owners, weights=table[self.buckets, c], minlength=len(self.counts)) for c in range(CLASSES)])
        total = np.bincount(self.text, weights=self.counts[self.words], minlength=n) + np.bincount(self.pair_text, minlength=n) + 1
        logits = [
            np.bincount(self.text, weights=of_words[c][self.words], minlength=n)
            + np.bincount(self.pair_text, weights=table[self.pairs, c], minlength=n)
            + table[self.end, c]
            for c in range(CLASSES)
        ]
        return 1 / (1 + np.exp(np.clip((logits[0] - logits[1]) / total, -60, 60)))


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> np.ndarray:
    """The table of what each bucket adds to each class, from bags with their label, in their order."""
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1 / settings.dims, 1 / settings.dims, (1 << settings.bits, settings.dims)).astype(np.float32)
    layer = np.zeros((settings.dims, CLASSES), dtype=np.float32)
    shares = [(buckets, (times / times.sum()).astype(np.float32), label) for buckets, times, label in bags]
    steps = max(1, settings.epochs * len(shares))
    step = 0
    for _ in range(settings.epochs):
        for k in rng.permutation(len(shares)):
            buckets, share, label = shares[k]
            rate = np.float32(settings.rate * (1 - step / steps))
            hidden = share @ vectors[buckets]
            logits = hidden @ layer
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            vectors[buckets] -= rate * share[:, None] * back
            step += 1
    # What was never seen says nothing.
    seen = np.zeros(len(vectors), dtype=bool)
    for buckets, _, _ in shares:
        seen[buckets] = True
    return np.where(seen[:, None], vectors @ layer, 0)


BAG = {"th": "long", "buckets": "array<int>", "times": "array<float>"}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE, settings: Settings = Settings()) -> np.ndarray:
    """The table that ``score`` needs, learned from ``sample`` labelled documents at most."""
    told = labels.select(F.col(id_col).alias("key"), F.col(label_col).alias("label")).where("key IS NOT NULL AND label IS NOT NULL")
    told = told.groupBy("key").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # An id without a document would take a place in the sample.
    known = told.join(texts.select(F.col("id").alias("key")).distinct(), "key", "left_semi")
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(sample)

    def bags(block: pa.RecordBatch) -> list[pa.Array]:
        found = list(Features(block.column("text").to_pylist(), settings).bags())
        offsets = pa.array(np.cumsum([0, *(len(b) for b, _ in found)]), pa.int32())
        lists = [pa.array(np.concatenate(part), kind) for part, kind in zip(zip(*found), (pa.int32(), pa.float32()))]
        return [block.column("th"), *[pa.ListArray.from_arrays(offsets, part) for part in lists]]

    # ``sample`` pairs of id and label: a fixed bound, whatever the tables.
    of_sample = texts.join(F.broadcast(chosen), F.col("id") == F.col("key")).select("key", "label", "text")
    counted = mapped_blocks(of_sample, "text", bags, BAG, keep=["key", "label"], th=text_hash("text"))
    one = F.struct("buckets", "times", F.col("row.label").alias("label"))
    each = counted.groupBy(F.col("row.key").alias("key")).agg(F.min_by(one, "th").alias("bag"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            buckets, times, label = (batch.column("bag").field(k) for k in range(3))
            for i, key in enumerate(batch.column("key").to_pylist()):
                rows.append((key, *[part[i].values.to_numpy(zero_copy_only=False) for part in (buckets, times)], label[i].as_py()))
        # The same order however the rows came.
        rows.sort(key=lambda r: r[0])
        table = train([r[1:] for r in rows], settings).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["model"])

    model = each.select(F.col("key").cast("string").alias("key"), "bag").repartition(1).mapInArrow(learn, "model binary").collect()
    if not model:
        return np.zeros((1 << settings.bits, CLASSES), dtype=np.float32)
    return np.frombuffer(model[0]["model"], dtype=np.float32).reshape(-1, CLASSES)


def score(docs: DataFrame, model: np.ndarray, text_col: str = "text", settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (their columns ``keep``, all by default) with ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(block: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(Features(block.column("text").to_pylist(), settings).scores(shared.value))]

    made = mapped_blocks(docs, text_col, work, {"score": "double"}, keep)
    return unpacked(made, score=F.col("score"))


def held_out(id_col: str = "doc_id"):
    """True for the quarter of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
