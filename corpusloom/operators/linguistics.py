"""Linguistic features read off an annotation column: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays
from ..session import cut_lineage
from .annotate import Annotator, Parts, annotator
from .stages import Stage, as_list
from .vectors import WordVectors

# Labels that are counted as entities of their own column only.
EXCLUDED_LABELS = ["CARDINAL", "DATE", "MONEY", "ORDINAL", "PERCENT", "QUANTITY", "TIME"]
# Dependency labels of a subject (English and German models).
SUBJECT_DEPS = ["nsubj", "sb"]
# The universal part-of-speech tags, and white space.
POS_TAGS = (
    "ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X SPACE"
).split()
# What most tokens are where word classes come from a dictionary.
USUAL_TAGS = ("X", "PUNCT")


class LinguisticEnrichment(Stage):
    """Counts, entities, subjects, verbs, word classes and vectors of text columns.

    For a text column ``c``: ``c_wc``, ``c_sentence_count``, ``c_ents``,
    ``c_entities`` (label -> texts) or ``c_entity_LABEL``, ``c_subj``,
    ``c_verb``, ``c_num_POS``, ``c_vec``, ``c_vec_normalized``, ``c_doc``.

    An empty text has only the two counts. Entity columns and ``num_POS`` are
    null when there is nothing; ``subj`` and ``verb`` are then empty.

    Parameters
    ----------
    nlp: an annotator, a model factory, or none for the default.
    tags: any of ``ents``, ``subj``, ``verb``.
    pos_stats: true for all universal tags, false for none, or a list.
    entity_labels: labels to spread into columns; none keeps a map column.
        :func:`labels_seen` finds them in one aggregation.
    vec: true, ``"vec"``/``"unnormalized"`` or ``"vec_normalized"``/``"normalized"``.
    word_vectors: vectors for ``vec`` when the annotator gives none.
    return_doc: keep the annotation as ``c_doc``.
    fill_zero: count 0 instead of null for an absent part of speech.
    """

    def __init__(
        self,
        nlp: Annotator | Callable | None = None,
        cols: str | Sequence[str] = (),
        tags: Sequence[str] = ("ents", "subj", "verb"),
        pos_stats: bool | Sequence[str] = True,
        vec: bool | str = False,
        ents_exclude: Sequence[str] = tuple(EXCLUDED_LABELS),
        entity_labels: Sequence[str] | None = None,
        word_vectors: WordVectors | None = None,
        return_doc: bool = False,
        fill_zero: bool = False,
    ):
        super().__init__()
        self.annotator = annotator(nlp)
        self.cols = as_list(cols)
        self.tags = list(tags)
        self.pos = POS_TAGS if pos_stats is True else list(pos_stats or [])
        self.raw_vec = vec in (True, "vec", "unnormalized")
        self.unit_vec = vec in (True, "vec_normalized", "normalized")
        if vec and not (self.raw_vec or self.unit_vec):
            raise ValueError(f"vec: {vec!r} is not known")
        self.ents_exclude = list(ents_exclude)
        self.entity_labels = None if entity_labels is None else list(entity_labels)
        self.word_vectors = word_vectors
        self.return_doc = return_doc
        self.fill_zero = fill_zero

    def output_roles(self):
        tag = [f"{c}_{k}" for c in self.cols for k in self.tags]
        if "ents" in self.tags:
            tag += [f"{c}_entity_{label}" for c in self.cols for label in self.entity_labels or []]
        num = [f"{c}_{k}" for c in self.cols for k in ["wc", "sentence_count", *(f"num_{p}" for p in self.pos)]]
        transient = [f"{c}_{k}" for c in self.cols for k in ("doc", "vec", "vec_normalized")]
        return {"tag": tag, "num": num, "transient": transient}

    def transform(self, df, roles=None):
        id_col = roles.id if roles else None
        for c in self.cols:
            text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
            parts = Parts.named(f"_{c}")
            add_parts = self.annotator.add_all_parts if self.return_doc else self.annotator.add_parts
            df = add_parts(df, text, parts, id_col)
            if parts.n_sents not in df.columns:
                df = df.withColumn(parts.n_sents, F.array_max(parts.sents) + 1)
            counts, rest = f"_{c}_counts", [parts.pos, *(f"_{c}_but_{p}" for p in USUAL_TAGS)]
            if self.pos:
                # What most tokens are is taken away first, so that the others are looked for among few.
                for all_tags, others, p in zip(rest, rest[1:], USUAL_TAGS):
                    df = df.withColumn(others, F.array_remove(F.col(all_tags), p))
                # Counted once per text and then only picked from; a lambda,
                # since the optimizer would repeat an array of expressions.
                wanted = F.array(*[F.lit(p) for p in self.pos])
                df = df.withColumn(counts, F.transform(wanted, _occurrences_in(rest)))
            features = self.features(parts, F.col(counts))
            df = df.withColumns({f"{c}_{k}": v for k, v in features.items()})
            if self.raw_vec or self.unit_vec:
                df = self._with_vectors(df, c, parts, id_col)
            if self.return_doc:
                df = df.withColumn(f"{c}_doc", parts.annotation())
            df = df.drop(counts, *rest, *parts.columns())
        return df

    def features(self, parts: Parts, counts: Column) -> dict[str, Column]:
        ents, filled = F.col(parts.ents), F.size(parts.texts) > 0
        known = lambda value: F.when(filled, value)
        out = {
            "wc": F.size(parts.texts),
            "sentence_count": F.when(filled, F.col(parts.n_sents)).otherwise(0),
        }
        if "ents" in self.tags:
            if self.entity_labels is None:
                out["entities"] = known(entities_by_label(ents))
            else:
                for label in self.entity_labels:
                    out[f"entity_{label}"] = known(none_if_empty(entity_texts(ents, _labelled(label))))
            keep = lambda e: ~e["label"].isin(self.ents_exclude) if self.ents_exclude else F.lit(True)
            out["ents"] = known(none_if_empty(entity_texts(ents, keep)))
        if "subj" in self.tags:
            out["subj"] = known(lemmas_where(parts.lemmas, parts.deps, lambda d: d.isin(SUBJECT_DEPS)))
        if "verb" in self.tags:
            out["verb"] = known(lemmas_where(parts.lemmas, parts.pos, lambda p: p == "VERB"))
        for i, p in enumerate(self.pos):
            n = F.get(counts, F.lit(i))
            out[f"num_{p}"] = known(n) if self.fill_zero else F.when(n > 0, n)
        return out

    def _with_vectors(self, df: DataFrame, c: str, parts: Parts, id_col: str | None) -> DataFrame:
        vec, filled = f"{c}_vec", f"_{c}_filled"
        # Kept by itself, so that a join need not carry the tokens.
        df = df.withColumn(filled, F.size(parts.texts) > 0)
        if self.word_vectors is not None:
            lowered = F.transform(F.col(parts.texts), lambda t: F.lower(t))
            df = self.word_vectors.add_document_vector(df, lowered, vec, id_col)
        else:
            df = df.withColumn(vec, F.col(parts.vector).cast("array<double>"))
        df = df.withColumn(vec, F.when(F.col(filled), F.col(vec))).drop(filled)
        if self.unit_vec:
            df = df.withColumn(f"{c}_vec_normalized", arrays.unit(F.col(vec)))
        return df if self.raw_vec else df.drop(vec)


def _occurrences_in(rest: Sequence[str]) -> Callable[[Column], Column]:
    """How often a tag is in the first of these array columns; each has the tags before but one of the usual ones."""

    def occurrences(tag: Column) -> Column:
        n = F.size(rest[-1]) - F.size(F.array_remove(F.col(rest[-1]), tag))
        for values, others, p in zip(rest, rest[1:], USUAL_TAGS):
            n = F.when(tag == p, F.size(values) - F.size(others)).otherwise(n)
        return n

    return occurrences


def entity_texts(ents: Column, keep: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(ents, keep), lambda e: e["text"])


def _labelled(label: str | Column) -> Callable[[Column], Column]:
    return lambda e: e["label"] == label


def entities_by_label(ents: Column) -> Column:
    """Label -> entity texts in document order; null without entities."""
    labels = F.array_distinct(ents["label"])
    texts = F.transform(labels, lambda x: entity_texts(ents, _labelled(x)))
    return F.when(F.size(ents) > 0, F.map_from_arrays(labels, texts))


def lemmas_where(lemmas: str, marks: str, keep: Callable[[Column], Column]) -> Column:
    """Lemmas of the tokens whose mark, in a parallel array, is wanted."""
    kept = F.zip_with(lemmas, marks, lambda lemma, mark: F.when(keep(mark), lemma))
    return F.filter(kept, lambda lemma: lemma.isNotNull())


def none_if_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def labels_seen(df: DataFrame, map_col: str) -> list[str]:
    """All keys of a map column, sorted: one aggregation, the list to the driver.

    For keys that become columns. Where they are countless, keep the map.
    """
    keys = df.select(F.explode(F.map_keys(map_col)).alias("k")).distinct().collect()
    return sorted(r["k"] for r in keys)


def widen(df: DataFrame, map_col: str, prefix: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Spread a map column over one column per key; ``labels=None`` finds the keys first.

    The look for the keys and the result then both read the rows as they were made once.
    """
    if labels is None:
        if df.isStreaming:
            raise ValueError("on a stream the keys must be declared")
        df = cut_lineage(df)
        labels = labels_seen(df, map_col)
    added = {f"{prefix}{label}": F.try_element_at(F.col(map_col), F.lit(label)) for label in labels}
    return df.withColumns(added).drop(map_col)


def pos_value_counts(df: DataFrame, doc_col: str) -> DataFrame:
    """Tokens of the whole corpus by part of speech."""
    # explode() would have the optimizer test the array for emptiness below the columns it is made of, with their
    # expressions written out inside its lambdas. Texts without a token give one row without a place.
    tokens = df.select(F.posexplode_outer(F.col(doc_col)["tokens"]["pos"]).alias("place", "pos")).where("place IS NOT NULL")
    return tokens.groupBy("pos").agg(F.count("*").alias("n"))
