"""Annotating a text: tokens, sentences, word classes, entities, vector.

The result is one nested column (:data:`ANNOTATION`). Whatever made it, a
dictionary or a language model, the features of ``linguistics`` read it the
same way.

Two annotators are provided. :class:`DictionaryAnnotator` is a set of column
expressions. :class:`ModelAnnotator` runs a user's model in Arrow batches.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, fields
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.dictionary import BroadcastDictionary, InlineDictionary, dictionary
from ..functions.phrases import Phrases

TOKEN = "struct<i:int,sent:int,text:string,lemma:string,pos:string,dep:string>"
ENTITY = "struct<text:string,label:string,start:int,end:int>"
ANNOTATION = f"struct<tokens:array<{TOKEN}>,ents:array<{ENTITY}>,vector:array<float>>"

WORD_ENTRY = "struct<lemma:string,pos:string,dep:string>"


@dataclass(frozen=True)
class Parts:
    """Names of the columns an annotation is made of: parallel arrays of the
    tokens' texts, sentence numbers, lemmas, classes and roles; entities; vector;
    the number of sentences, which an annotator may leave out.

    Features read these rather than an array of structs: what no feature asks
    for is then never computed.
    """

    texts: str
    sents: str
    lemmas: str
    pos: str
    deps: str
    ents: str
    vector: str
    n_sents: str = ""

    @classmethod
    def named(cls, prefix: str) -> "Parts":
        return cls(*(f"{prefix}_{f.name}" for f in fields(cls)))

    def columns(self) -> list[str]:
        return [getattr(self, f.name) for f in fields(self)]

    def annotation(self) -> Column:
        """All parts as one nested value."""
        names = {"text": self.texts, "sent": self.sents, "lemma": self.lemmas, "pos": self.pos, "dep": self.deps}
        zipped = F.arrays_zip(*names.values())

        def token(t: Column, i: Column) -> Column:
            return F.struct(i.alias("i"), *[t[names[k]].alias(k) for k in ("sent", "text", "lemma", "pos", "dep")])

        return F.struct(
            F.transform(zipped, token).alias("tokens"), F.col(self.ents).alias("ents"), F.col(self.vector).alias("vector")
        )


class Annotator:
    """Adds annotations to a table, as parts or as one nested column."""

    def add_parts(self, df: DataFrame, text: Column, parts: Parts, id_col: str | None = None) -> DataFrame:
        raise NotImplementedError

    def add_all_parts(self, df: DataFrame, text: Column, parts: Parts, id_col: str | None = None) -> DataFrame:
        """The same where sentence numbers will be asked for."""
        return self.add_parts(df, text, parts, id_col)

    def annotate(self, df: DataFrame, text: Column, out_col: str, id_col: str | None = None) -> DataFrame:
        parts = Parts.named(f"_{out_col}")
        df = self.add_all_parts(df, text, parts, id_col)
        return df.withColumn(out_col, parts.annotation()).drop(*parts.columns())


class DictionaryAnnotator(Annotator):
    """Word classes by dictionary, entities by phrase list and token pattern.

    Parameters
    ----------
    words: ``{word: {"lemma":…, "pos":…, "dep":…}}`` or a table
        ``(term, lemma, pos, dep)``. Words are matched in lowercase. A word
        not listed keeps itself as lemma and has class ``X``; signs, numbers
        and white space get ``PUNCT``, ``NUM`` and ``SPACE``.
    phrases: ``{phrase: label}`` or a table ``(phrase, label)``: entities of one
        or more words, in lowercase with single blanks. From left to right the
        longest phrase is taken, and entities do not overlap. Phrases may have
        any number of words.
    patterns: ``{label: Java regex}`` for entities of a single token.
    form: how the dictionaries reach the rows, see
        :func:`~corpusloom.functions.dictionary.dictionary`; results are the
        same. Broadcast phrases are found by an automaton over words
        (:mod:`~corpusloom.functions.phrases`): many and long ones cost no more.
    """

    def __init__(
        self,
        words: Mapping[str, Mapping[str, str]] | DataFrame | None = None,
        phrases: Mapping[str, str] | DataFrame | None = None,
        patterns: Mapping[str, str] | None = None,
        form: str = "auto",
    ):
        entry = F.struct("lemma", "pos", "dep")
        self.words = self.phrases = None
        if words is not None:
            self.words = dictionary(words, value=entry, value_type=WORD_ENTRY, form=form)
        if phrases is not None:
            self.phrases = dictionary(phrases, key="phrase", value="label", form=form)
        self.patterns = dict(patterns or {})
        if isinstance(self.phrases, BroadcastDictionary):
            self.phrases = Phrases(phrases, key="phrase", value="label")
        # In words, the longest phrase there is.
        self.max_phrase = self.phrases.longest_key() if self.phrases is not None else 0

    def add_all_parts(self, df, text, parts, id_col=None):
        nested = f"{parts.texts}_nested"
        df = df.withColumn(nested, F.transform(tx.sentences(text), lambda s: tx.tokens(s)))
        numbered = F.transform(F.col(nested), lambda s, k: F.array_repeat(k, F.size(s)))
        df = df.withColumns({parts.texts: F.flatten(nested), parts.sents: F.flatten(numbered), parts.n_sents: F.size(nested)})
        return self._with_words(df.drop(nested), parts, id_col)

    def add_parts(self, df, text, parts, id_col=None):
        # Tokens and sentences are each found in one pass; numbers of sentences are another one, for those who ask.
        numbered = F.transform(tx.sentences(text), lambda s, k: F.array_repeat(k, F.size(tx.tokens(s))))
        sents = {parts.sents: F.flatten(numbered), parts.n_sents: F.size(tx.sentences(text))}
        return self._with_words(df.withColumns({parts.texts: tx.tokens(text), **sents}), parts, id_col)

    def _with_words(self, df: DataFrame, parts: Parts, id_col: str | None) -> DataFrame:
        low, entries, cand = (f"{parts.texts}_{x}" for x in ("low", "entries", "candidates"))
        df = df.withColumn(low, F.transform(F.col(parts.texts), lambda t: F.lower(t)))
        helpers, bare = [low], df
        # Parallel arrays meet in zip_with, never through a lambda that refers
        # to another column: the optimizer may put that column's whole
        # expression into the lambda, to be computed for every token.
        if isinstance(self.words, InlineDictionary):
            # Each part by itself: entries of all parts would be copied for each of them.
            given = {k: InlineDictionary(_parts_named(self.words.entries, k), "string").get for k in ("lemma", "pos", "dep")}
            merged = {
                parts.lemmas: F.transform(low, lambda w: F.coalesce(given["lemma"](w), w)),
                parts.pos: F.transform(low, lambda w: F.coalesce(given["pos"](w), _shape(w))),
                parts.deps: F.transform(low, lambda w: given["dep"](w)),
            }
        elif self.words is not None:
            df, entry, extra = self.words.bind(df, F.col(low), id_col)
            df = df.withColumn(entries, F.transform(F.col(low), lambda w: entry(w)))
            helpers += [entries, *extra]
            merged = {
                parts.lemmas: F.zip_with(entries, low, lambda e, w: F.coalesce(e["lemma"], w)),
                parts.pos: F.zip_with(entries, low, lambda e, w: F.coalesce(e["pos"], _shape(w))),
                parts.deps: F.transform(entries, lambda e: e["dep"]),
            }
        else:
            merged = {
                parts.lemmas: F.col(low),
                parts.pos: F.transform(low, lambda w: _shape(w)),
                parts.deps: F.transform(low, lambda w: F.lit(None).cast("string")),
            }
        df = df.withColumns({**merged, parts.vector: F.lit(None).cast("array<float>")})
        ents = F.array().cast(f"array<{ENTITY}>")
        if (self.phrases is not None and self.max_phrase) or self.patterns:
            df, extra = self._with_candidates(df, parts.texts, low, cand, id_col, bare)
            helpers += extra
            ents = _leftmost(F.col(cand))
        return df.withColumn(parts.ents, ents).drop(*helpers)

    def _with_candidates(self, df, texts, low, cand, id_col, bare):
        """The longest phrase starting at each token, as a possible entity. ``bare``: ``df`` before words were looked up."""
        if isinstance(self.phrases, Phrases):
            return self._with_matches(df, texts, low, cand)
        helpers = [cand]
        sizes = range(self.max_phrase, 0, -1) if self.phrases is not None else []
        phrase = lambda i, n: _run(low, i, n)
        start = F.sequence(F.lit(0), F.size(low) - 1)
        starts = F.when(F.size(low) > 0, start).otherwise(F.array().cast("array<int>"))
        label, fits = None, lambda i, n: i + n <= F.size(low)
        word = lambda i: F.get(F.col(low), i)
        if isinstance(self.phrases, InlineDictionary):
            ends, first = _phrase_ends(self.phrases.entries, self.max_phrase), set()
            for firsts, _ in ends.values():
                first |= firsts
            sizes = [n for n in sizes if ends[n][0]]
            opens = lambda i: word(i).isin(sorted(first))
            label = self.phrases.get

            def fits(i: Column, n: int) -> Column:
                # Its first and last word decide for most runs; only the others are joined and looked up.
                firsts, lasts = ends[n]
                may = (i + n <= F.size(low)) & word(i).isin(sorted(firsts))
                return may & word(i + (n - 1)).isin(sorted(lasts)) if n > 1 and lasts is not None else may

        elif self.phrases is not None:
            grams = _grams(low, self.max_phrase, self.phrases.may_open)
            df, label, extra = self.phrases.bind(df, grams, id_col, bare)
            helpers += extra
            heads = F.col(extra[1])
            opens = lambda i: F.array_contains(heads, word(i))

        def entity(i: Column) -> Column:
            def labelled(n: int) -> Column:
                # As lists of one they are joined and looked up once; what does not fit is not even that.
                value = _let(phrase(i, n), label) if n > 1 else label(word(i))
                found = _let(value, lambda x: F.when(x.isNotNull(), _entity(texts, i, n, x)))
                return F.when(fits(i, n), found)

            longest = [labelled(n) for n in sizes]
            found = F.coalesce(*longest) if longest else F.lit(None).cast(ENTITY)
            if not self.patterns:
                return found
            return F.coalesce(F.when(opens(i), found) if longest else found, self._by_pattern(texts, i))

        if label is not None and not self.patterns:
            starts = F.filter(starts, opens)
        # The size test also keeps the token array a column of its own (see add_parts).
        found = F.when(F.size(texts) > 0, F.filter(F.transform(starts, entity), lambda e: e.isNotNull()))
        return df.withColumn(cand, F.coalesce(found, F.array().cast(f"array<{ENTITY}>"))), helpers

    def _with_matches(self, df, texts, low, cand):
        """The same by the automaton; tokens where no phrase begins are left to the patterns."""
        found = f"{cand}_found"
        df = df.withColumn(found, self.phrases.matches(F.col(low), overlapping=True))
        taken = F.transform(F.col(found), lambda m: _entity(texts, m["start"], m["n"], m["value"]))
        if self.patterns:
            starts = F.transform(F.col(found), lambda m: m["start"])
            others = F.transform(F.col(texts), lambda t, i: F.when(~F.array_contains(starts, i), self._by_pattern(texts, i)))
            both = F.concat(taken, F.filter(others, lambda e: e.isNotNull()))
            taken = F.array_sort(both, lambda a, b: a["start"] - b["start"])
        return df.withColumn(cand, taken), [cand, found]

    def _by_pattern(self, texts: str, i: Column) -> Column:
        found = F
        for name, pattern in self.patterns.items():
            found = found.when(F.get(F.col(texts), i).rlike(pattern), _entity(texts, i, 1, F.lit(name)))
        return found.otherwise(F.lit(None).cast(ENTITY))


def _parts_named(words: Mapping[str, Mapping[str, Any] | None], part: str) -> dict[str, Any]:
    """One part of the entries of words; only of those that have it."""
    found = {word: (entry or {}).get(part) for word, entry in words.items()}
    return {word: value for word, value in found.items() if value is not None}


def _phrase_ends(phrases: Iterable[str], longest: int) -> dict[int, tuple[set[str], set[str] | None]]:
    """For each number of tokens the words with which a phrase of so many may begin and end; None where any may end it.

    A phrase with white space beside its blanks may have fewer tokens than words, as a token may hold blanks.
    """
    ends: dict[int, tuple[set[str], set[str] | None]] = {n: (set(), set()) for n in range(1, longest + 1)}
    for phrase in phrases:
        words = phrase.split(" ")
        plain = all(w.strip(" \t\r\n\f") for w in words)
        for n in (len(words),) if plain else range(1, len(words) + 1):
            firsts, lasts = ends[n]
            firsts.add(words[0])
            ends[n] = firsts, lasts | {words[-1]} if plain and lasts is not None else None
    return ends


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """What ``make`` makes of a value that is computed once."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _grams(words: str, longest: int, may_open: Callable[[Column], Column]) -> Column:
    """All runs of 1 to ``longest`` words that begin with a word phrases may begin with."""
    opening = F.transform(words, lambda w, i: F.when(may_open(w), i))
    size = F.size(words)

    def runs(i: Column) -> Column:
        return F.array(*[F.when(i + n <= size, _run(words, i, n)) for n in range(1, longest + 1)])

    found = F.flatten(F.transform(F.filter(opening, lambda i: i.isNotNull()), runs))
    # The size test also keeps the words a column of their own (see add_parts).
    return F.when(size > 0, F.filter(found, lambda g: g.isNotNull()))


def _shape(word: Column) -> Column:
    """The class of a word no dictionary knows."""
    return (
        F.when((word >= "a") & (word < "{"), "X")  # what begins with a to z, without a pattern
        .when(word.rlike(r"^\p{L}"), "X")
        .when(word.rlike(r"^\p{N}+$"), "NUM")
        .when(word.rlike(r"^\p{N}"), "X")
        .when(F.substring(word, 1, 1).isin(" ", "\t", "\r", "\n", "\f"), "SPACE")
        .otherwise("PUNCT")
    )


# Runs of up to so many words are written out word by word.
SHORT_RUN = 8


def _run(words: str, i: Column, n: int | Column) -> Column:
    """``n`` words from place ``i`` on, with blanks between them. Not by slice(), which copies the whole list each time."""
    if isinstance(n, int) and n <= SHORT_RUN:
        return F.concat_ws(" ", *[F.get(F.col(words), i + k) for k in range(n)])
    return F.array_join(F.transform(F.sequence(i, i + n - 1), lambda j: F.get(F.col(words), j)), " ")


def _entity(texts: str, i: Column, n: int | Column, label: Column) -> Column:
    return F.struct(
        _run(texts, i, n).alias("text"),
        label.cast("string").alias("label"),
        i.alias("start"),
        (i + n).alias("end"),
    )


def _leftmost(candidates: Column) -> Column:
    """Drop candidates that begin inside an entity already taken.

    A list of the entities would be copied with all they hold at every step; one sign for each candidate is little to copy.
    """
    state = lambda end, taken: F.struct(end.alias("end"), taken.alias("taken"))
    step = lambda acc, e: F.when(
        e["start"] >= acc["end"], state(e["end"], F.concat(acc["taken"], F.lit("1")))
    ).otherwise(state(acc["end"], F.concat(acc["taken"], F.lit("0"))))
    signs = F.split(F.aggregate(candidates, state(F.lit(0), F.lit("")), step)["taken"], "")
    return F.filter(F.zip_with(candidates, signs, lambda e, sign: F.when(sign == "1", e)), lambda e: e.isNotNull())


# Models of this Python process, by the key of their annotator: loaded once, used by all tasks a worker runs.
_MODELS = "_corpusloom_models"


class ModelAnnotator(Annotator):
    """Annotations from a Python model.

    ``factory`` is called once per Python worker process and returns a function
    from a list of texts to one dict per text, with ``tokens`` (dicts ``text,
    lemma, pos, dep, sent``), and optionally ``ents`` (dicts ``text, label,
    start, end``) and ``vector``. The model itself never crosses the network.
    """

    def __init__(self, factory: Callable[[], Callable[[list[str]], Iterable[dict[str, Any]]]]):
        self.factory = factory
        self.key = uuid.uuid4().hex

    def add_parts(self, df, text, parts, id_col=None):
        note = f"{parts.texts}_note"
        df = self.annotate(df, text, note)
        field = lambda name: F.transform(F.col(note)["tokens"], lambda t: t[name])
        names = {parts.texts: "text", parts.sents: "sent", parts.lemmas: "lemma", parts.pos: "pos", parts.deps: "dep"}
        columns = {out: field(name) for out, name in names.items()}
        columns |= {parts.ents: F.col(note)["ents"], parts.vector: F.col(note)["vector"]}
        return df.withColumns(columns).drop(note)

    def annotate(self, df, text, out_col, id_col=None):
        factory, key, models = self.factory, self.key, _MODELS

        @F.arrow_udf(ANNOTATION)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            # Functions are unpickled anew for each task; a module of the process keeps the models.
            cache = vars(sys).setdefault(models, {})
            if key not in cache:
                cache[key] = factory()
            for texts in batches:
                yield _annotation_array(cache[key](texts.to_pylist()))

        return df.withColumn(out_col, run(text))


_TOKEN = pa.struct(
    [("i", pa.int32()), ("sent", pa.int32()), ("text", pa.string()), ("lemma", pa.string()), ("pos", pa.string()), ("dep", pa.string())]
)
_ENTITY = pa.struct([("text", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _annotation_array(notes: Iterable[dict[str, Any]]) -> pa.Array:
    """Annotations as one Arrow array, from parallel lists of their parts."""
    tokens: dict[str, list] = {f.name: [] for f in _TOKEN}
    ents: dict[str, list] = {f.name: [] for f in _ENTITY}
    token_ends, ent_ends, vectors = [0], [0], []
    for note in notes:
        for i, t in enumerate(note.get("tokens", [])):
            row = (i, int(t.get("sent", 0)), t["text"], t.get("lemma", t["text"].lower()), t.get("pos", "X"), t.get("dep"))
            for values, value in zip(tokens.values(), row):
                values.append(value)
        for e in note.get("ents", []):
            for values, value in zip(ents.values(), (e["text"], e["label"], int(e.get("start", 0)), int(e.get("end", 0)))):
                values.append(value)
        token_ends.append(len(tokens["i"]))
        ent_ends.append(len(ents["text"]))
        vectors.append(note.get("vector"))
    lists = lambda ends, kind, parts: pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(parts[f.name], f.type) for f in kind], fields=list(kind))
    )
    columns = [
        lists(token_ends, _TOKEN, tokens),
        lists(ent_ends, _ENTITY, ents),
        pa.array([None if v is None else [float(x) for x in v] for v in vectors], pa.list_(pa.float32())),
    ]
    return pa.StructArray.from_arrays(columns, names=["tokens", "ents", "vector"])


def annotator(source: Annotator | Callable | None) -> Annotator:
    """An annotator from what the user gives: itself or a model factory."""
    if source is None:
        return DictionaryAnnotator()
    return source if isinstance(source, Annotator) else ModelAnnotator(source)
