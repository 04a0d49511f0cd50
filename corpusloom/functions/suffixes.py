"""Suffix stemming by tables, for the languages beside English.

A word has up to three regions: R1 begins after the first consonant that
follows a vowel, R2 is the R1 of R1, RV (of the Romance languages) begins a
little earlier. A rule takes a suffix off, or puts another in its place, only
if the suffix lies in the region of its step; of the suffixes of a step that
fit, the longest counts. Steps of a group are tried in order until one has
changed the word.

The tables are our own and light: inflection and the commonest derivations.
They bring forms of a word together; a stem need not be a word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Step:
    """``rules``: suffixes, or ``suffix>replacement``, with blanks between. ``before``: signs of which one must stand before
    the suffix; ``not_before``: endings that must not; ``least``: letters that must stay; ``inside``: the sign before
    the suffix lies in the region too."""

    region: str
    rules: str
    before: str = ""
    not_before: tuple[str, ...] = ()
    least: int = 2
    inside: bool = False
    _pairs: list = field(default_factory=list, compare=False)

    def __post_init__(self):
        pairs = [(s, r) for s, _, r in (rule.partition(">") for rule in self.rules.split())]
        self._pairs.extend(sorted(pairs, key=lambda p: -len(p[0])))

    def applied(self, word: str, start: int) -> str | None:
        for suffix, new in self._pairs:
            rest = word[: len(word) - len(suffix)]
            if not word.endswith(suffix) or len(rest) < max(start + self.inside, self.least):
                continue
            if self.before and rest[-1:] not in self.before or rest.endswith(self.not_before or ("\0",)):
                continue
            return rest + new
        return None


@dataclass(frozen=True)
class Language:
    vowels: str
    groups: tuple[tuple[Step, ...], ...]
    fold: bool = True  # accents go, before everything else
    letters: tuple[tuple[str, str], ...] = ()  # other letters that are read as one
    glides: str = ""  # vowels that are consonants between two vowels
    r1_least: int = 0  # letters before R1 at least
    finish: Callable[[str], str] | None = None

    def regions(self, word: str) -> dict[str, int]:
        first = self._after(word, 0)
        return {"all": 0, "r1": max(first, self.r1_least), "r2": self._after(word, first), "rv": self._rv(word)}

    def _after(self, word: str, start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in self.vowels and word[i - 1] in self.vowels:
                return i + 1
        return len(word)

    def _rv(self, word: str) -> int:
        if len(word) < 3:
            return len(word)
        vowel = [c in self.vowels for c in word]
        if not vowel[1]:
            found = next((i for i in range(2, len(word)) if vowel[i]), len(word))
        elif vowel[0]:
            found = next((i for i in range(2, len(word)) if not vowel[i]), len(word))
        else:
            found = 2
        return min(found + 1, len(word))

    def stem(self, word: str) -> str:
        for old, new in self.letters:
            word = word.replace(old, new)
        if self.fold:
            word = without_accents(word)
        if len(word) <= 3 or not word.isalpha():
            return word
        for i in range(1, len(word) - 1):
            if word[i] in self.glides and word[i - 1] in self.vowels and word[i + 1] in self.vowels:
                word = word[:i] + word[i].upper() + word[i + 1 :]
        regions = self.regions(word)
        for group in self.groups:
            for step in group:
                changed = step.applied(word, regions[step.region])
                if changed is not None:
                    word = changed
                    break
        word = word.lower()
        return self.finish(word) if self.finish else word


def without_accents(word: str) -> str:
    if word.isascii():
        return word
    parts = unicodedata.normalize("NFD", word)
    return unicodedata.normalize("NFC", "".join(c for c in parts if unicodedata.category(c) != "Mn"))


def _single_end(word: str) -> str:
    """A doubled last consonant once; a doubled vowel before it once (Dutch spelling of syllables)."""
    if len(word) > 3 and word[-1] == word[-2] and word[-1] not in "aeiou":
        word = word[:-1]
    if len(word) > 3 and word[-2] == word[-3] and word[-2] in "aeou" and word[-1] not in "aeiou":
        word = word[:-2] + word[-1]
    # v and z do not end a Dutch word.
    return word[:-1] + {"v": "f", "z": "s"}.get(word[-1], word[-1])


def _french_end(word: str) -> str:
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] and word[-1] in "nltrps" else word


GERMAN = Language(
    "aeiouy",
    (
        (Step("r1", "em ern er e en es nisse>nis nissen>nis nisses>nis", least=3), Step("r1", "s", before="bdfghklmnrt", least=3)),
        (Step("r1", "en er est", least=3), Step("r1", "st", before="bdfghklmnt", least=4)),
        (Step("r2", "end ung igung igend lichkeit igkeit erheit enheit erlich enlich heit lich keit"), Step("r2", "ig ik isch", not_before=("e",))),
    ),
    letters=(("ß", "ss"),),
    glides="uy",
    r1_least=3,
)

DUTCH = Language(
    "aeiouy",
    (
        (Step("r1", "heden>heid"), Step("r1", "en ene", not_before=("a", "e", "i", "o", "u", "gem")), Step("r1", "s se", before="bcdfghklmnpqrtvwxz")),
        (Step("r1", "e", before="bcdfghjklmnpqrstvwxz"),),
        (Step("r2", "heid", not_before=("c",)),),
        (Step("r2", "igend iging lijk baar bar end ing ig", not_before=("e",)),),
    ),
    r1_least=3,
    finish=_single_end,
)

_SPANISH_VERBS = (
    "ando iendo ar er ir aba abas abamos aban ia ias iamos ian aste aron ieron io iste imos amos emos ado ada ados adas ido ida idos "
    "idas are aras ara aremos aran ere eras era eremos eran ire iras ira iremos iran aria arias ariamos arian eria erias eriamos erian "
    "iria irias iriamos irian ase ases asen iese ieses iesen asteis isteis as an es en"
)
SPANISH = Language(
    "aeiou",
    (
        (
            Step("r1", "amente"),
            Step("r2", "mente anza anzas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos "
                 "adora ador acion adoras adores aciones ante antes ancia ancias logia>log logias>log ucion>u uciones>u encia>ent encias>ent "
                 "idad idades ico ica icos icas iva ivo ivas ivos"),
            Step("rv", _SPANISH_VERBS),
        ),
        (Step("rv", "os a o i e"),),
    ),
)

_PORTUGUESE_VERBS = (
    "ando endo indo ar er ir ava avas avamos avam ia ias iamos iam aste aram eram iram ou eu iu amos emos imos ado ada ados adas ido "
    "ida idos idas arei aras ara aremos arao erei eras era eremos erao irei iras ira iremos irao aria arias ariamos ariam eria erias "
    "eriamos eriam iria irias iriamos iriam asse asses assem esse esses essem isse isses issem as am es em"
)
PORTUGUESE = Language(
    "aeiou",
    (
        (
            Step("r1", "amente"),
            Step("r2", "mente eza ezas ismo ismos avel aveis ivel iveis ista istas oso osa osos osas amento amentos imento imentos adora ador "
                 "adoras adores acao acoes ante antes ancia ancias logia>log logias>log ucao>u ucoes>u encia>ent encias>ent idade idades ico ica "
                 "icos icas iva ivo ivas ivos eira>eir eiras>eir eiro>eir eiros>eir"),
            Step("rv", "oes>ao aes>ao " + _PORTUGUESE_VERBS),
        ),
        (Step("rv", "ais>al eis>el ois>ol"), Step("all", "ns>m"), Step("rv", "os a i o e")),
    ),
)

_ITALIAN_VERBS = (
    "ando endo are ere ire ava avi avamo avate avano eva evi evamo evate evano iva ivi ivamo ivate ivano ato ata ati ate uto uta uti ute "
    "ito ita iti ite iamo ete ono ano arono erono irono era ero ara aro ira iro erai arai irai eremo aremo iremo erete arete irete eranno "
    "aranno iranno erei arei irei erebbe arebbe irebbe asse assi essi esse isse issi"
)
ITALIAN = Language(
    "aeiou",
    (
        (
            Step("r1", "amente"),
            Step("r2", "mente anza anze ismo ismi abile abili ibile ibili ista iste isti oso osa osi ose amento amenti imento imenti atore atori "
                 "atrice atrici azione azioni ante anti logia>log logie>log uzione>u uzioni>u usione>u usioni>u enza>ent enze>ent ita ico ici "
                 "ica ice iche ichi ivo ivi iva ive"),
            Step("rv", _ITALIAN_VERBS),
        ),
        (Step("rv", "ie io ia ii"), Step("rv", "a e i o")),
        (Step("all", "ch>c gh>g"),),
    ),
)

_FRENCH_VERBS = "er ez ai as a ait ais aient ant ante ants antes e es ent ee ees erai eras era erons erez eront erais erait erions eriez eraient"
_FRENCH_I_VERBS = (
    "ir is it i issons issez issent issant issante issais issait issaient irai iras ira irons irez iront irais irait iraient"
)
FRENCH = Language(
    "aeiouy",
    (
        (
            Step("r1", "issement>i issements>i ement ements"),
            Step("r2", "ance isme able iste eux ances ismes ables istes euse>eux euses>eux atrice ateur ation atrices ateurs ations logie>log "
                 "logies>log usion>u ution>u usions>u utions>u ence>ent ences>ent ite ites if ive ifs ives ique iques ment ments"),
            Step("rv", _FRENCH_I_VERBS, before="bcdfghjklmnpqrstvwxz", inside=True),
            Step("r2", "ions iez"),
            Step("rv", _FRENCH_VERBS),
        ),
        (Step("all", "eaux>eau aux>al", least=2), Step("all", "s x", before="abcdefghijklmnopqrtuvwyz", least=3)),
        (Step("rv", "e"),),
        (Step("r2", "ier>i iere>i"),),
    ),
    finish=_french_end,
)

GREEK = Language(
    "αεηιουω",
    (
        (
            Step("all", "ματων>μ ματοσ>μ ματα>μ μα>μ", least=3),
            Step("all", "ουμε ειτε ουνε ομαι εσαι εται ομαστε ονται ησα ησεσ ησε ησαμε ησατε ησαν ουσα ουσεσ ουσε ουσαμε ουσατε ουσαν", least=3),
            Step("all", "οσ ου ον ε οι ων ουσ α η ησ εσ ασ ο ι ισ εισ εωσ εων υ υσ ω ειο ειου ειων ιου ιων ιο ια ιασ ιεσ ετε ουν ει", least=3),
        ),
    ),
    letters=(("ς", "σ"),),
)

LIGHT = {
    "german": GERMAN, "dutch": DUTCH, "spanish": SPANISH, "portuguese": PORTUGUESE, "italian": ITALIAN, "french": FRENCH, "greek": GREEK,
}
