"""Phrases of any number of words, found in lists of words by one automaton.

The phrases become an Aho-Corasick automaton over words. It is made from a
broadcast table once per worker process and passes over each row's words once,
whatever the number of phrases and the length of the longest. Nothing is
shuffled, so it works on tables and streams alike.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .dictionary import BroadcastDictionary, mapping_table

# Automata of this Python process, by the key of their phrases: made once, used by all tasks a worker runs.
_AUTOMATA = "_corpusloom_automata"


class _Automaton:
    """Numbers of words, and the automaton over them. A word of no phrase has the number 0."""

    def __init__(self, phrases: Sequence[str]):
        import ahocorasick

        self.numbers: dict[str, int] = {}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, phrase in enumerate(phrases):
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in phrase.split(" "))
            self.found.add_word(words, (len(words), k))
        self.words = pa.array(list(self.numbers), pa.string())
        if len(phrases):
            self.found.make_automaton()

    def at_each_start(self, words: Sequence[str | None]) -> list[tuple[int, int, int]]:
        """``(start, words, phrase)`` of the longest phrase from each word on, by start."""
        return sorted((start, n, k) for start, (n, k) in self._longest(words).items())

    def leftmost_longest(self, words: Sequence[str | None]) -> list[tuple[int, int, int]]:
        """The same without those that begin inside one taken before."""
        out, end = [], 0
        for start, n, k in self.at_each_start(words):
            if start >= end:
                out.append((start, n, k))
                end = start + n
        return out

    def in_lists(self, lists: pa.Array) -> tuple[np.ndarray, list[int], list[int], list[int]]:
        """``(list, start, words, phrase)`` of the longest phrase from each word on, for many lists of words in order.

        Words become numbers in Arrow; Python meets only those that some phrase has, a gap between them as one 0.
        """
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.words, skip_nulls=True), -1)
        numbers = at.to_numpy(zero_copy_only=False) + 1
        known = np.flatnonzero(numbers)
        row, begins = np.repeat(np.arange(len(sizes)), sizes)[known], np.cumsum(sizes) - sizes
        gaps = np.flatnonzero((np.diff(known) > 1) | (np.diff(row) > 0)) + 1
        places = np.insert(known, gaps, -1)
        longest: dict[int, tuple[int, int]] = {}
        if len(known):
            for last, (n, k) in self.found.iter(tuple(np.insert(numbers[known], gaps, 0).tolist())):
                longest[last - n + 1] = (n, k)  # later ones from the same start are longer
        starts = sorted(longest)
        first = places[np.array(starts, np.int64)]
        rows = np.searchsorted(np.cumsum(sizes), first, side="right")
        return rows, (first - begins[rows]).tolist(), [longest[x][0] for x in starts], [longest[x][1] for x in starts]

    def _longest(self, words) -> dict[int, tuple[int, int]]:
        longest: dict[int, tuple[int, int]] = {}
        if self.numbers and any(w in self.numbers for w in words):
            for last, (n, k) in self.found.iter(tuple(self.numbers.get(w, 0) for w in words)):
                longest[last - n + 1] = (n, k)  # later ones from the same start are longer
        return longest


class Phrases:
    """``{phrase: value}`` or a table: phrases in the case of the words they are looked for in, single blanks between words.

    When a phrase occurs twice in a table the greatest value counts.
    """

    def __init__(self, source: Mapping[str, Any] | DataFrame, key: str = "phrase", value: str = "value", value_type: str = "string"):
        if isinstance(source, Mapping):
            source, key, value = mapping_table(source, value_type), "term", "value"
        held = BroadcastDictionary(source, key, F.col(value), value_type)
        self.table, self.value_type, self._sent, self.key = held.table, value_type, held._sent, uuid.uuid4().hex
        self.longest_key = held.longest_key

    def _mapped(self, kind: str, make: Callable[[_Automaton, pa.Array, pa.Array], pa.Array]) -> Callable:
        """An Arrow function of a column of words."""
        sent, key, name, schema = self._sent, self.key, _AUTOMATA, T.DataType.fromDDL(kind)

        @F.arrow_udf(schema)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            made = vars(sys).setdefault(name, {})
            if key not in made:
                made[key] = _Automaton(sent.value.column("term").to_pylist())
            values = sent.value.column("value").combine_chunks()
            for words in batches:
                # Some rows at a time.
                for first in range(0, len(words), 256):
                    yield make(made[key], values, words.slice(first, 256))

        return run

    def matches(self, words: Column, overlapping: bool = False) -> Column:
        """``array<struct<start:int,n:int,value>>``: from left to right the longest phrases, without overlap; or the longest
        one from every word on. A null list has none."""

        def make(automaton: _Automaton, values, lists):
            rows, starts, sizes, phrases = automaton.in_lists(lists)
            if not overlapping:
                free, kept, row = 0, [], -1
                for at, (r, start, n) in enumerate(zip(rows.tolist(), starts, sizes)):
                    free, row = (free if r == row else 0), r
                    if start >= free:
                        kept.append(at)
                        free = start + n
                rows = rows[np.array(kept, np.int64)]
                starts, sizes, phrases = ([x[at] for at in kept] for x in (starts, sizes, phrases))
            ends = np.searchsorted(rows, np.arange(len(lists) + 1))
            columns = [pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())]
            columns.append(values.take(pa.array(phrases, pa.int64())))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["start", "n", "value"]))

        return self._mapped(f"array<struct<start:int,n:int,value:{self.value_type}>>", make)(words)

    def replaced(self, words: Column) -> Column:
        """The words with the longest phrases from left to right replaced by the words of their value. Null stays null."""
        if self.value_type != "string":
            raise ValueError("phrases are replaced by texts")

        def make(automaton: _Automaton, values, lists):
            def one(row):
                out, at = [], 0
                for start, n, k in automaton.leftmost_longest(row):
                    out += row[at:start]
                    out += [w for w in (values[k].as_py() or "").split(" ") if w]
                    at = start + n
                return out + row[at:]

            return pa.array([None if row is None else one(row) for row in lists.to_pylist()], pa.list_(pa.string()))

        return self._mapped("array<string>", make)(words)


def synonym_rules(rules: Sequence[str]) -> dict[str, str]:
    """``{phrase: what it becomes}`` from rules as search services write them.

    ``a, b c => d e`` turns each phrase on the left into the words on the right
    (all of them, in order, if several phrases stand there); ``a, b c, d`` says
    that all mean the same, and the first stands for them. ``#`` begins a
    remark, a backslash keeps the next sign from being a comma. Phrases are
    taken in lowercase; of two rules for a phrase the later one counts.
    """
    out: dict[str, str] = {}
    for rule in rules:
        text = rule.strip()
        if not text or text.startswith("#"):
            continue
        left, arrow, right = text.partition("=>")
        phrases = [p for p in map(_phrase, _split(left)) if p]
        becomes = " ".join(p for p in map(_phrase, _split(right)) if p) if arrow else (phrases or [""])[0]
        if not phrases or not becomes or "=>" in right:
            raise ValueError(f"not a synonym rule: {rule!r}")
        out.update((p, becomes) for p in phrases if arrow or p != becomes)
    return out


def _split(text: str) -> list[str]:
    """At commas that no backslash keeps."""
    parts, kept = [""], False
    for c in text:
        if c == "," and not kept:
            parts.append("")
        elif c != "\\" or kept:
            parts[-1] += c
        kept = c == "\\" and not kept
    return parts


def _phrase(text: str) -> str:
    return " ".join(text.lower().split())
