"""Runs of repeating words: every maximal periodic stretch of every text, and the texts without the repeats.

A run of period q is a maximal stretch in which words q apart are identical.
The method: for each word, the longest Lyndon word that begins there, under the
order of the words and under its reverse. Each run has a root (one period of
it) that is such a longest Lyndon word under one of the two orders, so
extending every root to both sides as far as words one period apart agree
finds all runs. The two Lyndon arrays come from the grouping phase of a suffix
sorter alone, without sorting suffixes: groups of suffixes are worked off from
the greatest to the least, and each passes its context on to the nearest
earlier suffixes of lesser groups. When a group is reached, its context is the
longest Lyndon word of its suffixes. Extensions are longest common extensions
over ranks of stretches of 1, 2, 4, ... words, which are exact.

Only stretches that can hold a run are looked at: in a run of ``least`` words
or more, all words are covered by stretches of half that length which occur
twice, so what none such covers is left out, again and again until nothing
more falls. That loses no run.

A map over the table without a shuffle. A block of texts is worked on at a
time; a long text is a block, and time and memory grow with its words (times
the logarithm of the longest repeat).

Defined results: null and empty texts have no words and no runs; a word is a
run of characters other than the blanks 20 and 09-0D; words differ if their
bytes do; rows are independent of each other, repeated ones too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unpacked
from .words import gram_hashes, mapped_blocks, mixed

LEAST_LENGTH = 12


def lyndon_lengths(symbols: list[int], n_symbols: int) -> list[int]:
    """Length of the longest Lyndon word from each place on. The symbol 0 ends a sequence; it gets 0.

    Several sequences may follow each other; no word reaches beyond a 0.
    """
    n = len(symbols)
    found, before, done = [0] * n, [0] * n, bytearray(n)
    group = symbols.copy()
    # Groups in order, lesser and greater neighbours; first one group for each symbol.
    members: list[list[int]] = [[] for _ in range(n_symbols)]
    for place, symbol in enumerate(symbols):
        members[symbol].append(place)
    context = [1] * n_symbols
    lesser = list(range(-1, n_symbols - 1))
    greater = list(range(1, n_symbols + 1))
    now = n_symbols - 1
    while now > 0:
        length = context[now]
        parents: dict[int, int] = {}
        for place in members[now]:
            if group[place] != now:
                continue  # it has moved up since
            at = place - 1
            while at >= 0 and done[at]:
                up = before[at]
                if up >= 0 and done[up]:
                    before[at] = up = before[up]
                at = up
            before[place], done[place], found[place] = at, 1, length
            if at >= 0 and symbols[at]:
                parents[at] = parents.get(at, 0) + 1
        members[now] = []
        # A parent's context grows by this one as often as it follows; more often is greater.
        split: dict[tuple[int, int], list[int]] = {}
        for place, times in parents.items():
            split.setdefault((group[place], times), []).append(place)
        last: dict[int, int] = {}
        for old, times in sorted(split):
            below = last.get(old, old)
            new, above = len(context), greater[below]
            context.append(context[old] + times * length)
            members.append(split[old, times])
            lesser.append(below)
            greater.append(above)
            greater[below] = lesser[above] = new
            last[old] = new
            for place in members[new]:
                group[place] = new
        now = lesser[now]
    return found


class Extensions:
    """Longest common extensions in a sequence, by ranks of its stretches of 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.ranks = len(symbols), [np.unique(symbols, return_inverse=True)[1]]
        while True:
            last, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
            if len(last) <= step or int(last.max()) + 1 == len(last):
                return  # none of this length occurs twice, or none of twice this length fits in
            pairs = last[: len(last) - step].astype(np.int64) * len(last) + last[step:]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def _from(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        a, b = a.copy(), b.copy()
        total = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            step, ranks = 1 << level, self.ranks[level]
            x, y = (a, b) if way > 0 else (a - step, b - step)
            inside = (x >= 0) & (y < len(ranks))
            same = inside & (ranks[np.where(inside, x, 0)] == ranks[np.where(inside, y, 0)])
            total[same] += step
            a[same] += way * step
            b[same] += way * step
        return total

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on equal those from ``b`` (greater) on."""
        return self._from(a, b, 1)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` equal those before ``b`` (greater)."""
        return self._from(a, b, -1)


def all_runs(symbols: np.ndarray, bounds: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """Rows ``start, length, period`` of the runs in each of the sequences between ``bounds``, by start, then period."""
    names, ranked = np.unique(symbols, return_inverse=True)
    # A separator of its own after each sequence: 0 for the Lyndon words, unlike any other for extensions.
    ends = bounds[1:]
    k, at = len(names), np.arange(len(symbols)) + np.searchsorted(ends, np.arange(len(symbols)), side="right")
    plain = np.zeros(len(symbols) + len(ends), dtype=np.int64)
    plain[at] = ranked + 1
    apart = plain.copy()
    apart[ends + np.arange(len(ends))] = k + 1 + np.arange(len(ends))
    periods = [
        np.array(lyndon_lengths(order.tolist(), k + 1), dtype=np.int64) for order in (plain, np.where(plain > 0, k + 1 - plain, 0))
    ]
    start = np.concatenate([at, at[periods[0][at] != periods[1][at]]])
    period = np.concatenate([periods[0][at], periods[1][start[len(at) :]]])
    equal = Extensions(apart)
    left = equal.backward(start, start + period)
    length = left + period + equal.forward(start, start + period)
    enough = length >= np.maximum(least, 2 * period)
    # Start and period name a run; its roots have found it several times.
    _, once = np.unique((start - left)[enough] * (len(plain) + 1) + period[enough], return_index=True)
    runs = np.stack([start - left, length, period], axis=1)[enough][once]
    # Back to places without separators.
    back = np.full(len(plain), -1, dtype=np.int64)
    back[at] = np.arange(len(symbols))
    runs[:, 0] = back[runs[:, 0]]
    return runs


def candidates(symbols: np.ndarray, bounds: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(first, stop) of stretches that hold all runs of ``least`` symbols or more of the sequences between ``bounds``."""
    size = (least + 1) // 2
    first, stop = bounds[:-1], bounds[1:]
    while True:
        wide = stop - first >= least
        first, stop = first[wide], stop[wide]
        if not len(first):
            return first, stop
        # All stretches of ``size`` symbols within one sequence, by number of the sequence and hash: equal ones are never told apart.
        counts = stop - first - size + 1
        owner = np.repeat(np.arange(len(first)), counts)
        place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]
        grams = gram_hashes(mixed(symbols.astype(np.uint64)), size)[place] ^ mixed(owner.astype(np.uint64) + np.uint64(1))
        order = np.argsort(grams)
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(grams), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        steps = np.zeros(len(symbols) + 1, dtype=np.int64)
        np.add.at(steps, place[twice], 1)
        np.add.at(steps, place[twice] + size, -1)
        covered = np.concatenate([[0], (np.cumsum(steps)[:-1] > 0).astype(np.int8), [0]])
        # Sequences that touch stay apart.
        begins = np.flatnonzero(np.diff(covered) == 1)
        closes = np.flatnonzero(np.diff(covered) == -1)
        cuts = np.unique(np.concatenate([begins, first[(covered[first + 1] == 1)]]))
        closes = np.unique(np.concatenate([closes, stop[covered[stop] == 1]]))
        if len(cuts) == len(first) and (cuts == first).all() and (closes == stop).all():
            return first, stop
        first, stop = cuts, closes


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST_LENGTH) -> list[np.ndarray]:
    """Per text (a list of words) rows ``start, length, period`` of its runs, by start, then period."""
    numbers: dict[bytes, int] = {}
    symbols = np.array([numbers.setdefault(w, len(numbers)) for words in texts for w in words], dtype=np.int64)
    bounds = np.cumsum([0, *map(len, texts)])
    first, stop = candidates(symbols, bounds, least)
    if not len(first):
        return [np.zeros((0, 3), dtype=np.int64) for _ in texts]
    sizes = stop - first
    inner = np.cumsum([0, *sizes])
    place = np.repeat(first - inner[:-1], sizes) + np.arange(inner[-1])
    runs = all_runs(symbols[place], inner, least)
    runs[:, 0] = place[runs[:, 0]]
    text = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    runs[:, 0] -= bounds[text]
    split = np.searchsorted(text, np.arange(len(texts) + 1))
    return [runs[split[i] : split[i + 1]] for i in range(len(texts))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by a blank, but those that any run holds after its first period."""
    if len(runs):
        steps = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(steps)[:-1] == 0)]
    return b" ".join(words)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ADDED = {"n_words": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST_LENGTH, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (their columns ``keep``, all by default) with ``n_words, runs, collapsed``.

    ``runs`` are those of ``least`` words and of two periods or more, by start,
    then period; ``collapsed`` is the text with one period of each run.
    """

    def work(block: pa.RecordBatch) -> list[pa.Array]:
        texts = [(t or b"").split() for t in block.column("text").cast(pa.binary()).to_pylist()]
        runs = runs_of_texts(texts, least)
        flat = np.concatenate(runs)
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN))
        short = [collapsed(words, found) for words, found in zip(texts, runs)]
        return [
            pa.array([len(words) for words in texts], pa.int64()),
            pa.ListArray.from_arrays(offsets, rows),
            pa.array(short, pa.binary()).cast(pa.string()),
        ]

    made = mapped_blocks(docs, text_col, work, ADDED, keep)
    return unpacked(made, **{name: F.col(name) for name in ADDED})


def longest(runs: Column | str) -> Column:
    """The run of greatest length; of equal ones that of least start, then of least period. Null if there is none."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    key = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))
    best = F.array_max(F.transform(runs, key))
    return F.when(F.size(runs) > 0, F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))
