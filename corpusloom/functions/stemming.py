"""Stemming of token arrays.

For English the rules are those of M. F. Porter, "An algorithm for suffix
stripping", Program 14(3), 1980; other languages have lighter tables of our own
(:mod:`.suffixes`). Words repeat a lot, so each Arrow batch is dictionary
encoded first and only its distinct words are stemmed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from .batches import in_pieces
from .suffixes import LIGHT

# The suffix tables of the paper, steps 2, 3 and 4.
STEP_2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous "
    "ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
)
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


# Stems a task remembers.
MEMO = 200_000


def _rules(table: str) -> list[tuple[str, str]]:
    pairs = [tuple(rule.split(":")) for rule in table.split()]
    return sorted(pairs, key=lambda p: -len(p[0]))


_RULES_2, _RULES_3 = _rules(STEP_2), _rules(STEP_3)
_RULES_4 = sorted(STEP_4.split(), key=lambda s: -len(s))


def _shape(word: str) -> str:
    """One letter per letter of the word: ``v`` vowel, ``c`` consonant."""
    shape = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and shape[-1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def _step_1(w: str) -> str:
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    return w


def _step_4(w: str) -> str:
    for suffix in _RULES_4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            ok = _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem if ok else w
    return w


def _step_5(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def porter(word: str) -> str:
    """Stem one lowercase English word."""
    if len(word) <= 2 or not word.isascii():
        return word
    word = _step_1(word)
    word = _swap(_swap(word, _RULES_2), _RULES_3)
    return _step_5(_step_4(word))


STEMMERS: dict[str, Callable[[str], str]] = {"english": porter, **{name: rules.stem for name, rules in LIGHT.items()}}


def stemmed(terms: Column, stemmer: Callable[[str], str] = porter) -> Column:
    """Stem every word of an ``array<string>`` column, in place and in order."""

    @F.arrow_udf("array<string>")
    def stem_batch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_pieces(batches, _stem_of(stemmer))

    return stem_batch(terms)


def stemmed_by_key(terms: Column, key: Column, stemmers: Mapping[str, Callable[[str], str]]) -> Column:
    """The same with a stemmer for each key; words of a row with another key stay. One worker does it for all keys."""

    @F.arrow_udf("array<string>")
    def stem_batch(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        stem = {k: _stem_of(s) for k, s in stemmers.items()}

        def work(arrays: pa.Array, keys: pa.Array) -> pa.Array:
            coded = keys.dictionary_encode()
            out, places = [], []
            for n, k in enumerate([*coded.dictionary.to_pylist(), None]):
                own = pc.is_null(coded.indices) if k is None else pc.fill_null(pc.equal(coded.indices, n), False)
                rows = arrays.filter(own)
                out.append(stem[k](rows) if k in stem and len(rows) else rows)
                places.append(pc.indices_nonzero(own))
            return pa.concat_arrays(out).take(pc.sort_indices(pa.concat_arrays(places)))

        yield from in_pieces(batches, work)

    return stem_batch(terms, key)


def _stem_of(stemmer: Callable[[str], str]) -> Callable[[pa.Array], pa.Array]:
    stem = lru_cache(maxsize=MEMO)(stemmer)

    def work(arrays: pa.Array) -> pa.Array:
        flat = arrays.flatten().dictionary_encode()
        stems = pa.array([stem(w) for w in flat.dictionary.to_pylist()], pa.string())
        values = pc.take(stems, flat.indices)
        lengths = pc.fill_null(pc.list_value_length(arrays), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(lengths.cast(pa.int64()))])
        return pa.ListArray.from_arrays(offsets.cast(pa.int32()), values, mask=arrays.is_null())

    return work
