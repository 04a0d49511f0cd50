"""Lexicon sentiment of a text column.

Scoring follows C. J. Hutto and E. Gilbert, "VADER: A Parsimonious Rule-based
Model for Sentiment Analysis of Social Media Text", ICWSM 2014. Everything is
a row-wise expression: no token is ever shuffled, and the stage also runs on
streams. The lexicon is data; the built-in one is small and meant to be
replaced.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.dictionary import Dictionary, InlineDictionary, TableDictionary, dictionary
from .stages import Stage, as_list

# Fixed values of the paper.
BOOST = 0.293
DECAY = (1.0, 0.95, 0.9)
NEGATION = -0.74
ALPHA = 15.0

# Decimal places of the unit in which a word's value is added up, and the bounds within which that is exact.
UNIT_DIGITS, MOST_DIGITS, MOST_VALENCE = 6, 9, 1000.0

# A small lexicon of our own: word -> valence between -4 and 4.
LEXICON: dict[str, float] = {
    **dict.fromkeys("excellent outstanding superb wonderful love loved loves amazing brilliant".split(), 3.1),
    **dict.fromkeys("great happy beautiful delightful fantastic joy best win winner perfect".split(), 2.8),
    **dict.fromkeys("good nice pleasant helpful friendly glad fun enjoy enjoyed success like".split(), 1.9),
    **dict.fromkeys("better useful interesting safe easy fine hope thanks thank welcome clear".split(), 1.4),
    **dict.fromkeys("ok okay fair agree accept improve improved".split(), 0.9),
    **dict.fromkeys("slow boring doubt doubtful strange odd unclear tired late".split(), -0.9),
    **dict.fromkeys("bad wrong sad problem problems error errors fail failed lose lost weak".split(), -1.9),
    **dict.fromkeys("angry ugly poor worse hurt hate hated fear fraud stupid sick enemy".split(), -2.5),
    **dict.fromkeys("terrible horrible awful disaster worst murder war kill killed death evil".split(), -3.2),
}

# Words that change the weight of a later one: word -> boost (or dampening).
BOOSTERS: dict[str, float] = {
    **dict.fromkeys("very really extremely absolutely completely so totally especially incredibly".split(), BOOST),
    **dict.fromkeys("barely hardly slightly somewhat partly marginally almost".split(), -BOOST),
}

NEGATIONS: list[str] = (
    "not no never neither nor none nothing nowhere cannot without can't won't don't doesn't didn't isn't "
    "wasn't aren't weren't shouldn't wouldn't couldn't hasn't haven't hadn't ain't"
).split()


class LexiconSentiment(Stage):
    """Compound sentiment in [-1, 1]; 0.0 for null, empty and neutral texts.

    A lexicon word counts its valence ``v``. Each of the three words before it
    that is a booster adds ``sign(v) * weight`` decayed by distance; a negation
    among them multiplies by ``negation``. The sum ``s`` is squashed to
    ``s / sqrt(s*s + alpha)``. A word's value is the double nearest to its
    decimal value: it is added up in whole units and divided once.

    Parameters
    ----------
    lexicon: ``{word: valence}``, a table ``(term, valence)``, or a dictionary
        in the form one wants (:func:`~corpusloom.functions.dictionary.dictionary`).
    boosters, negations: the modifiers, ``{word: weight}`` and a word list.
    shares: also add ``{out_col}_pos``, ``_neu`` and ``_neg``, the shares of
        positive, neutral and negative weight.
    capitals, exclamation, but: the paper's further rules, off by default:
        weight 0.733 for an all-capitals word in a text of mixed case, 0.292
        for each of up to four ``!``, and words before and after the last
        ``but`` counting half and one and a half times.
    """

    CAPITALS = 0.733
    EXCLAMATION = 0.292
    BUT = (0.5, 1.5)

    def __init__(
        self,
        col: str,
        out_col: str = "sentiment",
        lexicon: Mapping[str, float] | DataFrame | Dictionary | None = None,
        boosters: Mapping[str, float] | None = None,
        negations: list[str] | None = None,
        shares: bool = False,
        capitals: bool = False,
        exclamation: bool = False,
        but: bool = False,
        decay: tuple[float, float, float] = DECAY,
        negation: float = NEGATION,
        alpha: float = ALPHA,
        id_col: str | None = None,
    ):
        super().__init__()
        self.col = as_list(col)[0]
        self.out_col = out_col
        self.lexicon = dictionary(
            LEXICON if lexicon is None else lexicon, key="term", value="valence", value_type="double"
        )
        self.boosters = InlineDictionary(BOOSTERS if boosters is None else boosters, "double")
        self.negations = list(NEGATIONS if negations is None else negations)
        self.shares = shares
        self.capitals, self.exclamation, self.but = capitals, exclamation, but
        self.decay, self.negation, self.alpha = decay, negation, alpha
        self.id_col = id_col
        self._in_units()

    def _in_units(self) -> None:
        """Weights and the negation as whole numbers of a power of ten; none if they are too fine for exact sums of them."""
        exact = lambda x: Decimal(repr(float(x)))
        decays, weights = [exact(d) for d in self.decay], {w: exact(x) for w, x in self.boosters.entries.items()}
        numbers = [d * x for d in decays for x in weights.values()] + [exact(self.CAPITALS)]
        factor = exact(self.negation)
        places = lambda x: max(0, -x.normalize().as_tuple().exponent) if x.is_finite() else MOST_DIGITS + 1
        digits, of_factor = max(UNIT_DIGITS, *map(places, numbers)), places(factor)
        most = max([*map(abs, numbers), Decimal(0)])
        self.unit = None
        if digits > MOST_DIGITS or of_factor > 3 or most > 100 or abs(factor) > 10:
            return
        self.unit, self.parts = 10.0**digits, 10.0**of_factor
        self.factor = float(factor * 10**of_factor)
        in_units = lambda x: float(x * 10**digits)
        self.steps = [InlineDictionary({w: in_units(d * x) for w, x in weights.items()}, "double") for d in decays]
        self.louder = in_units(exact(self.CAPITALS))

    def output_roles(self):
        extra = [f"{self.out_col}_{s}" for s in ("pos", "neu", "neg")] if self.shares else []
        return {"num": [self.out_col, *extra]}

    def _adjusted(self, hit: Column) -> Column:
        valence = hit["v"]
        sign = F.signum(valence)
        loud = hit["loud"] if self.capitals else None
        before = [hit[f"before{d}"] for d in (1, 2, 3)]
        negated = F.lit(False)
        for word in before if self.negations else ():
            negated = negated | F.coalesce(word.isin(self.negations), F.lit(False))

        def summed(value: Column, louder: float, boosts: list[Column]) -> Column:
            if loud is not None:
                value = value + F.when(loud, sign * louder).otherwise(0.0)
            for boost in boosts if self.boosters.entries else ():
                value = value + F.coalesce(sign * boost, F.lit(0.0))
            return value

        plain = summed(valence, self.CAPITALS, [self.boosters.get(w) * d for w, d in zip(before, self.decay)])
        plain = plain * F.when(negated, self.negation).otherwise(1.0) if self.negations else plain
        if self.unit is None:
            return plain
        whole = F.rint(valence * self.unit)
        units = summed(whole, self.louder, [step.get(w) for step, w in zip(self.steps, before)])
        exact = units / self.unit
        if self.negations:
            exact = F.when(negated, units * self.factor / (self.unit * self.parts)).otherwise(exact)
        return F.when((whole / self.unit == valence) & (F.abs(valence) <= MOST_VALENCE), exact).otherwise(plain)

    def transform(self, df, roles=None):
        out, text = self.out_col, F.coalesce(F.col(f"`{self.col}`").cast("string"), F.lit(""))
        tok, hit, val = f"_{out}_tokens", f"_{out}_hits", f"_{out}_values"
        helpers = [tok, hit, val]
        df = df.withColumn(tok, tx.words(text))
        cased = mixed = None
        if self.capitals:
            cased_name, mixed_name = f"_{out}_cased", f"_{out}_mixed"
            df = df.withColumn(cased_name, tx.extract_all(text, tx.WORD))
            loud = F.filter(F.col(cased_name), lambda w: (F.upper(w) == w) & (F.lower(w) != w))
            df = df.withColumn(mixed_name, (F.size(loud) > 0) & (F.size(loud) < F.size(cased_name)))
            cased, mixed = F.col(cased_name), F.col(mixed_name)
            helpers += [cased_name, mixed_name]
        size, last_but, total = f"_{out}_size", f"_{out}_last_but", f"_{out}_total"
        helpers += [size, last_but, total]

        def placed(word: Column, i: Column) -> list[Column]:
            """All that counts with a word but its valence."""
            fields = [word.alias("word"), i.alias("i"), *[F.get(F.col(tok), i - d).alias(f"before{d}") for d in (1, 2, 3)]]
            if cased is not None:
                shown = F.get(cased, i)
                fields.append((mixed & (F.upper(shown) == shown) & (F.lower(shown) != shown)).alias("loud"))
            return fields

        # The few words that are in the lexicon, each with what stands before it. A join meets these, not the texts' words.
        id_col, there = self.id_col or (roles.id if roles else None), lambda x: x.isNotNull()
        where_but = F.when(F.array_contains(F.col(tok), "but"), F.size(tok) - F.array_position(F.reverse(F.col(tok)), "but"))
        of_text = {size: F.size(tok), last_but: where_but}
        if isinstance(self.lexicon, TableDictionary):
            may = self.lexicon.may_hold
            maybe = F.filter(F.transform(F.col(tok), lambda w, i: F.when(may(w), F.struct(*placed(w, i)))), there)
            df = df.withColumns({hit: maybe, **of_text})
            df, valence, joined = self.lexicon.bind(df, F.transform(F.col(hit), lambda x: x["word"]), id_col, held=True)
            found = F.transform(F.col(hit), lambda x: F.when(valence(x["word"]).isNotNull(), x.withField("v", valence(x["word"]))))
            df = df.withColumn(hit, F.filter(found, there))
        else:
            df, valence, joined = self.lexicon.bind(df, F.col(tok), id_col)
            found = F.transform(
                F.col(tok), lambda w, i: F.when(valence(w).isNotNull(), F.struct(*placed(w, i), valence(w).alias("v")))
            )
            df = df.withColumns({hit: F.filter(found, there), **of_text})
        helpers += joined

        def adjusted(x: Column) -> Column:
            v = self._adjusted(x)
            if self.but:
                at = F.col(last_but)
                v = v * F.when(x["i"] < at, self.BUT[0]).when(x["i"] > at, self.BUT[1]).otherwise(1.0)
            return v

        df = df.withColumn(val, F.transform(F.col(hit), adjusted))
        df = df.withColumn(total, F.aggregate(F.col(val), F.lit(0.0), lambda s, v: s + v))
        total = F.col(total)
        bang = F.lit(0.0)
        if self.exclamation:
            bang = self.EXCLAMATION * F.least(F.lit(4), F.length(text) - F.length(F.replace(text, F.lit("!"))))
            total = total + F.signum(total) * bang
        added = {out: F.when(F.size(hit) > 0, total / F.sqrt(total * total + F.lit(self.alpha))).otherwise(0.0)}
        if self.shares:
            added.update(self._shares(F.col(val), F.col(size) - F.size(hit), bang))
        return df.withColumns(added).drop(*helpers)

    def _shares(self, values: Column, neutral: Column, bang: Column) -> dict[str, Column]:
        """Each scored word weighs its strength plus one, each other word one."""
        pos = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.when(v > 0, v + 1).otherwise(0.0))
        neg = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.when(v < 0, 1 - v).otherwise(0.0))
        neu = neutral + F.size(F.filter(values, lambda v: v == 0))
        stronger = F.signum(pos - neg)
        pos = pos + F.when(stronger > 0, bang).otherwise(0.0)
        neg = neg + F.when(stronger < 0, bang).otherwise(0.0)
        whole = pos + neg + neu
        share = lambda part: F.when(whole > 0, part / whole).otherwise(0.0)
        return {
            f"{self.out_col}_pos": share(pos),
            f"{self.out_col}_neu": share(neu),
            f"{self.out_col}_neg": share(neg),
        }
