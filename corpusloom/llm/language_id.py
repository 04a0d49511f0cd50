"""Language identification by rank-order profiles.

A text's letters, in lower case, form words; a word with a blank before and
after it yields runs of one to three characters. The most frequent runs of a
text, in order, are compared with the most frequent ones of each language: each
run adds the difference of its two ranks, or the length of the profile if the
language lacks it. The language with the least sum wins.

Profiles are counted over all labelled texts: each task counts its own, counts
are summed by language and run, and only the ``size`` best of each language
come to the driver (languages times ``size`` rows). Prediction is a map over
the table, without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score
0; equal distances go to the first language by name; without any labelled text
all is ``und``. The score is 1 less the distance as a share of the largest
possible one. Texts of one script that no profile knows get the nearest
language with a score near 0.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import in_blocks

PROFILE_SIZE = 400
UNKNOWN = "und"
PIECE = 1 << 20  # characters whose runs are in memory at a time
FLUSH = 1 << 20  # distinct runs of a language a task keeps before it passes them on
BLANK = 32


class Letters:
    """For each character: 0 if it is in no word, 1 in a word, 2 a letter. Filled as characters turn up."""

    def __init__(self):
        self.kind = np.full(0x110000, 255, dtype=np.uint8)

    def of(self, chars: np.ndarray) -> np.ndarray:
        kinds = self.kind[chars]
        if (kinds == 255).any():
            for c in np.unique(chars[kinds == 255]):
                category = unicodedata.category(chr(c))[0]
                self.kind[c] = 2 if category == "L" else 1 if category == "M" else 0
            kinds = self.kind[chars]
        return kinds


def words_only(text: str, letters: Letters) -> np.ndarray | None:
    """Code points of the words, with one blank around each; None if there is no letter."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = letters.of(chars)
    if not (kinds == 2).any():
        return None
    padded = np.full(len(chars) + 2, BLANK, dtype=np.uint32)
    padded[1:-1] = np.where(kinds > 0, chars, BLANK)
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != BLANK) | (padded[:-1] != BLANK)
    return padded[keep]


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1)) if len(codes) else np.zeros(0, dtype=np.int64)
    return codes[first], np.diff(first, append=len(codes))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
    return codes[first], np.add.reduceat(counts, first)


def run_counts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of 1 to 3 characters, 21 bits each, in order of code, and how often each occurs."""
    parts = []
    for lo in range(0, len(words), PIECE):
        c = words[lo : lo + PIECE + 2].astype(np.int64)
        n = min(PIECE, len(words) - lo)
        one = c[:n]
        two = (c[:-1] << 21 | c[1:])[:n]
        three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[:n]
        parts.append(counted(np.concatenate([one[one != BLANK], two, three[c[1:-1][:n] != BLANK]])))
    return merged(parts)


def most_frequent(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Codes by falling count, then by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """Per language its most frequent runs, in order."""

    runs: dict[str, list[int]]
    size: int = PROFILE_SIZE

    def ranks(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, all runs in order of code, and each language's rank of each run (``size`` where it has none)."""
        names = sorted(self.runs)
        codes = np.unique(np.array([r for n in names for r in self.runs[n]], dtype=np.int64))
        table = np.full((len(names), len(codes)), self.size, dtype=np.int64)
        for i, n in enumerate(names):
            runs = np.array(self.runs[n], dtype=np.int64)
            table[i, np.searchsorted(codes, runs)] = np.arange(len(runs))
        return names, codes, table


def nearest(words: np.ndarray, codes: np.ndarray, table: np.ndarray, size: int) -> tuple[int, float]:
    """The language with the least out-of-place distance, and the score."""
    top = most_frequent(*run_counts(words), size)
    at = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
    known = codes[at] == top
    away = np.abs(table[:, at[known]] - np.arange(len(top))[known])
    away[table[:, at[known]] == size] = size
    distance = away.sum(axis=1) + size * (len(top) - int(known.sum()))
    best = int(distance.argmin())
    return best, 1 - float(distance[best]) / (size * len(top))


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE_SIZE) -> Profiles:
    """Profiles of the non-null languages, from all their texts."""
    schema = pa.schema([("lang", pa.string()), ("run", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held = Letters(), {}

        def passed_on(lang):
            codes, counts = merged(held.pop(lang))
            columns = [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                words = words_only(text.as_py(), letters)
                if words is None:
                    continue
                lang = lang.as_py()
                parts = held.setdefault(lang, [])
                parts.append(run_counts(words))
                if len(parts) >= 64:
                    parts[:] = [merged(parts)]
                    if len(parts[0][0]) > FLUSH:
                        yield passed_on(lang)
        for lang in list(held):
            yield passed_on(lang)

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(count, "lang string, run long, n long")
    summed = counts.groupBy("lang", "run").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "run"))
    best = summed.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "rank", "run").collect()
    runs: dict[str, list[int]] = {}
    for row in sorted(best):
        runs.setdefault(row["lang"], []).append(row["run"])
    return Profiles(runs, size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score`` after (or in place of) their columns."""
    names, codes, table = profiles.ranks()
    size = profiles.size

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters = Letters()

        def one(text):
            words = words_only(text, letters) if text and names else None
            if words is None:
                return {"lang_pred": UNKNOWN, "score": 0.0}
            best, score = nearest(words, codes, table, size)
            return {"lang_pred": names[best], "score": score}

        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
        yield from in_blocks(batches, lambda texts: [one(t) for t in texts], kind)

    row = docs.select(F.struct("*").alias("row"), predict(F.col(text_col)).alias("p"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return row.select(*kept, "p.lang_pred", "p.score")


def held_out(id_col: str = "doc_id"):
    """True for the third of the documents that no profile is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
