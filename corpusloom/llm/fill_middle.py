"""Fill-in-the-middle transformation with a sparse index of the characters that are longer than a byte.

A text is cut twice, at boundaries of its units, and its three parts change
places around three marks. Units are found over the UTF-8 bytes, and bytes are
what is cut; what is reported is counted in code points. The bridge between
the two is an index of exceptions only: where each multibyte character stands
and how many bytes it has in excess of one, summed up. A binary search in it
turns a byte place into a code point or back; in stretches of ASCII both differ
by a constant, so an ASCII text has an empty index and no text is decoded.

A map over the table without a shuffle: one block of texts at a time, and of a
long text a piece at a time but for the index, whose size is that of the
exceptions.

Cuts and form are drawn from the first four 32-bit numbers of the SHA-256 of
``seed`` and the id as text (nothing for a null id), so a rerun or another
partitioning gives the same rows.

Defined results: null and empty texts, texts that hold a mark, and a share of
the others stay ``plain``, whose output is the text (empty for null) and whose
counts of characters are null; parts may be empty; rows of the same id get the
same draws; columns of the same names are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unpacked
from .words import mapped_blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE = 1 << 20  # bytes whose units are in memory at a time


@dataclass
class Exceptions:
    """The multibyte characters of a text: ``at``, their first bytes; ``excess``, the bytes over one before each and in all."""

    at: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, text: np.ndarray) -> Exceptions:
        at = np.flatnonzero(text >= 0xC0)
        lead = text[at]
        excess = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), out=excess[1:])
        return cls(at, excess)

    def chars(self, byte):
        """Code points before a byte that begins a character (or ends the text)."""
        return byte - self.excess[np.searchsorted(self.at, byte, side="left")]

    def bytes(self, char):
        """Bytes before the code point of that number."""
        return char + self.excess[np.searchsorted(self.at - self.excess[:-1], char, side="left")]


def _unit_starts(text: np.ndarray, lo: int) -> np.ndarray:
    """Of the bytes from ``lo`` on, a piece long, those that begin a unit: a run of ASCII letters, or any other character."""
    part = text[max(0, lo - 1) : lo + PIECE]
    letter = (part | 32) - np.uint8(97) < 26
    starts = (part & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return starts if lo == 0 else starts[1:]


class Words:
    """Units of a text: runs of ASCII letters, and each other character by itself."""

    def __init__(self, text: np.ndarray):
        self.text = text
        counts = [int(np.count_nonzero(_unit_starts(text, lo))) for lo in range(0, len(text), PIECE)]
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.n = int(self.before[-1])

    def byte(self, unit: int) -> int:
        """Where the unit of that number begins."""
        if unit >= self.n:
            return len(self.text)
        piece = int(np.searchsorted(self.before, unit, side="right")) - 1
        return piece * PIECE + int(np.flatnonzero(_unit_starts(self.text, piece * PIECE))[unit - self.before[piece]])


class Characters:
    """Units of a text: its code points."""

    def __init__(self, text: np.ndarray):
        self.index = Exceptions.of(text)
        self.n = int(self.index.chars(len(text)))

    def byte(self, unit: int) -> int:
        return int(self.index.bytes(unit))


UNITS = {"word": Words, "char": Characters}


@dataclass(frozen=True)
class Rule:
    """How texts are cut and how often: shares are percent of the texts, and of those that are cut."""

    unit: str = "word"
    cut_percent: int = 90
    suffix_first_percent: int = 20
    seed: str = "1:"


def draws(seed: str, key: str) -> list[int]:
    digest = hashlib.sha256((seed + key).encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transform(text: bytes | memoryview, key: str, rule: Rule = Rule()) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, code points of prefix and of middle, and the output of one text."""
    raw = bytes(text)
    flat = np.frombuffer(raw, dtype=np.uint8)
    units = UNITS[rule.unit](flat)
    h = draws(rule.seed, key)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not raw or any(m in raw for m in marks) or h[2] % 100 >= rule.cut_percent:
        return units.n, "plain", None, None, raw
    first, second = (units.byte(k) for k in sorted((h[0] % (units.n + 1), h[1] % (units.n + 1))))
    index = Exceptions.of(flat)
    prefix_chars = int(index.chars(first))
    middle_chars = int(index.chars(second)) - prefix_chars
    head, middle, tail = (m + part for m, part in zip((marks[0], marks[2], marks[1]), (raw[:first], raw[first:second], raw[second:])))
    if h[3] % 100 < rule.suffix_first_percent:
        return units.n, "spm", prefix_chars, middle_chars, tail + head + middle
    return units.n, "psm", prefix_chars, middle_chars, head + tail + middle


ADDED = {"n_units": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(), keep: list[str] | None = None
) -> DataFrame:
    """The rows of ``docs`` (their columns ``keep``, all by default) with ``n_units, form, prefix_chars, middle_chars, output``."""

    def work(block: pa.RecordBatch) -> list[pa.Array]:
        texts = block.column("text").cast(pa.binary())
        keys = block.column("key").to_pylist()
        rows = [transform(t.as_buffer() if t.is_valid else b"", k or "", rule) for t, k in zip(texts, keys)]
        n, form, prefix, middle, output = zip(*rows)
        return [
            pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
            pa.array(output, pa.binary()).cast(pa.string()),
        ]

    made = mapped_blocks(docs, text_col, work, ADDED, keep, key=F.col(id_col).cast("string"))
    return unpacked(made, **{name: F.col(name) for name in ADDED})


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output of that form was made from. No cut text holds a mark, so the first one found is the mark."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def parts(first: str, second: str, third: str):
        rest = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, third, 1)
        return a, b, F.substr(rest, F.length(b) + len(third) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX, MIDDLE)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
