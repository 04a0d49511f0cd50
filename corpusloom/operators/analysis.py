"""Search-style text analysis: from a text to the terms it is counted and found by.

Order of the steps: possessive ending (English), lowercase, stop words,
stemming (off by default), synonyms.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.dictionary import Dictionary, dictionary
from ..functions.languages import ANALYZER_OF_CODE, stop_words
from ..functions.phrases import Phrases, synonym_rules
from ..functions.stemming import STEMMERS, stemmed, stemmed_by_key
from .stages import Stage


def without_possessive(term: Column) -> Column:
    """Drop a trailing ``'s`` from a lowercase term."""
    ending = F.endswith(term, F.lit("'s")) | F.endswith(term, F.lit("’s"))
    return F.when(ending, F.substring(term, F.lit(1), F.length(term) - 2)).otherwise(term)


class Analyzer:
    """A chain of term filters for one language, or for a language column.

    Parameters
    ----------
    lang: analyzer language (``"english"`` …). Ignored when ``lang_col`` is set.
    lang_col: column of two-letter codes; every row is treated by its own
        language, and rows of an unknown language keep all their words.
    stop, stem: switch stop-word removal and stemming.
    extra_stop: more words to remove, in any language.
    synonyms: ``{term: canonical}`` or a table ``(term, canonical)``, one word to
        one word; or a list of rules, whose phrases may have any number of
        words (:func:`~corpusloom.functions.phrases.synonym_rules`), or
        :class:`~corpusloom.functions.phrases.Phrases`. From left to right the
        longest phrase is replaced. Rules see the terms the steps before leave.
    stemmer: a Python function that stems, or ``{language: function}``, where
        the built-in ones are not meant (Porter's for English, light tables for
        the others). With ``lang_col`` every row is stemmed by its own
        language; a row of an unknown language keeps its words as they are.
    """

    def __init__(
        self,
        lang: str | None = "english",
        lang_col: str | None = None,
        stop: bool = True,
        stem: bool = False,
        extra_stop: tuple[str, ...] = (),
        synonyms: Mapping[str, str] | DataFrame | Dictionary | Sequence[str] | Phrases | None = None,
        stemmer: Callable[[str], str] | Mapping[str, Callable[[str], str]] | None = None,
    ):
        self.lang = lang
        self.lang_col = lang_col
        self.stop = stop
        self.extra_stop = list(extra_stop)
        if isinstance(synonyms, (list, tuple)):
            synonyms = Phrases(synonym_rules(synonyms))
        known = synonyms is None or isinstance(synonyms, Phrases)
        self.synonyms = synonyms if known else dictionary(synonyms, key="term", value="canonical", value_type="string")
        # Of the one language, or by language where rows have their own.
        self.stemmer: Callable[[str], str] | None = None
        self.stemmers: dict[str, Callable[[str], str]] = {}
        if stem and lang_col:
            if callable(stemmer):
                raise ValueError("with lang_col, give stemmers by language")
            self.stemmers = {**STEMMERS, **(stemmer or {})}
        elif stem:
            self.stemmer = stemmer if callable(stemmer) else {**STEMMERS, **(stemmer or {})}.get(lang or "")
            if self.stemmer is None:
                raise ValueError(f"no built-in stemmer for {lang!r}: pass stemmer=")

    def _filtered(self, terms: Column, lang: str | None) -> Column:
        if lang == "english":
            terms = F.transform(terms, without_possessive)
        drop = list(self.extra_stop) + (list(stop_words(lang)) if self.stop and lang else [])
        return F.filter(terms, lambda t: ~t.isin(drop)) if drop else terms

    def _filtered_by_row(self, terms: Column) -> Column:
        code = F.upper(F.col(self.lang_col))
        branch = F
        for c, analyzer in ANALYZER_OF_CODE.items():
            if analyzer:
                branch = branch.when(code == c, self._filtered(terms, analyzer))
        return branch.otherwise(self._filtered(terms, None))

    def add_terms(self, df: DataFrame, col: str, out_col: str, id_col: str | None = None) -> DataFrame:
        """``df`` with the analyzed terms of ``col`` in ``out_col``; null text has none."""
        raw = f"_{out_col}_raw"
        text = F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))
        df = df.withColumn(raw, tx.words(text))
        terms = self._filtered_by_row(F.col(raw)) if self.lang_col else self._filtered(F.col(raw), self.lang)
        if self.stemmer is not None:
            terms = stemmed(terms, self.stemmer)
        df = df.withColumn(out_col, terms).drop(raw)
        own = {code: self.stemmers[analyzer] for code, analyzer in ANALYZER_OF_CODE.items() if analyzer in self.stemmers}
        if own:
            df = df.withColumn(out_col, stemmed_by_key(F.col(out_col), F.upper(F.col(self.lang_col)), own))
        if isinstance(self.synonyms, Phrases):
            df = df.withColumn(out_col, self.synonyms.replaced(F.col(out_col)))
        elif self.synonyms is not None:
            df, canonical, helpers = self.synonyms.bind(df, F.col(out_col), id_col)
            mapped = F.transform(F.col(out_col), lambda t: F.coalesce(canonical(t), t))
            df = df.withColumn(out_col, mapped).drop(*helpers)
        return df

    def query_terms(self, query: str) -> list[str]:
        """Analyze a short query text the way documents are ."""
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        row = self.add_terms(spark.createDataFrame([(0, query)], "id long, q string"), "q", "t", "id").first()
        return row["t"]


class AnalyzeText(Stage):
    """Stage adding the analyzed terms of a text column as tags."""

    def __init__(self, col: str, out_col: str | None = None, analyzer: Analyzer | None = None):
        super().__init__()
        self.col = col
        self.out_col = out_col or f"{col}_terms"
        self.analyzer = analyzer or Analyzer()

    def output_roles(self):
        return {"tag": [self.out_col]}

    def transform(self, df, roles=None):
        return self.analyzer.add_terms(df, self.col, self.out_col, roles.id if roles else None)
