"""Suffix tables: forms of a word meet in one stem, different words do not."""

import pytest

import corpusloom as cl
from corpusloom.functions.languages import LANGUAGES
from corpusloom.functions.stemming import STEMMERS
from corpusloom.functions.suffixes import LIGHT, Language, Step

# Forms of some words of each language; behind a bar forms that the light rules do not bring to the stem.
FORMS = {
"german":["haus häuser hauses häusern","katze katzen","kind kinder kindes kindern","frau frauen","freundlich freundliche freundlicher freundlichen freundlichkeit","wohnung wohnungen","schön schöne schöner schönsten","laufen laufe","fest feste festes","ergebnis ergebnisse","zeitung zeitungen","größe größen","möglich mögliche möglichkeit möglichkeiten","deutsch deutsche deutschen deutsches","politisch politische politischen"],
"dutch":["huis huizen","boek boeken","kat katten","mogelijk mogelijke","man mannen","loop lopen","vrijheid vrijheden","vriendelijk vriendelijke","groot grote","week weken","school scholen","brief brieven","werk werken","belangrijk belangrijke","tafel tafels"],
"spanish":["casa casas","niño niña niños niñas","hablar hablando hablado hablaba hablaron hablamos","comer comiendo comido comieron","libro libros","rápido rápida | rápidamente","nación naciones","vivir viviendo vivido","canción canciones","bueno buena buenos buenas","profesor profesora profesores","flor flores","importante importantes","trabajo trabajar trabajando","científico científica científicos"],
"portuguese":["casa casas","menino menina meninos meninas","falar falando falado falava falaram falamos","comer comendo comido comeram","livro livros","rápido rápida | rapidamente","nação nações","bom bons","canção canções","professor professora professores","flor flores","importante importantes","trabalho trabalhar trabalhando","animal animais","cientifico cientifica"],
"italian":["casa case","ragazzo ragazza ragazzi ragazze","parlare parlando parlato parlava parlano","libro libri","rapido rapida rapidamente","nazione nazioni","buono buona buoni buone","amico amici","lago laghi","vivere vivendo","canzone canzoni","importante importanti","lavoro lavorare lavorando","fiore fiori","scientifico scientifica scientifici"],
"french":["maison maisons","petit petite petits petites","parler parlant parlait parlez | parlons","finissent finissait | finir finissons","cheval chevaux","bateau bateaux","heureux heureuse heureuses","nation nations","important importante importants","rapide rapidement","chanson chansons","livre livres","grand grande grands grandes","ami amie amis amies","lent lente lentement"],
"greek":["λόγος λόγου λόγον λόγοι λόγων λόγους","σπίτι","θάλασσα θάλασσας θάλασσες","γράμμα γράμματα γράμματος γραμμάτων","δρόμος δρόμου δρόμοι δρόμων","καλός καλή καλό καλοί καλές","γυναίκα γυναίκες γυναίκας","βιβλίο βιβλία βιβλίου βιβλίων","παιδί παιδιά"],
}


@pytest.mark.parametrize("language", sorted(LIGHT))
def test_forms_of_a_word_have_one_stem(language):
    stem, stems = LIGHT[language].stem, {}
    words = 0
    for group in FORMS[language]:
        forms, _, others = group.partition(" | ")
        found = {stem(w) for w in forms.split()}
        assert len(found) == 1, (group, found)
        stems.setdefault(found.pop(), []).append(group)
        words += len(forms.split()) + len(others.split())
        for w in forms.split():
            assert len(stem(w)) >= 2 and len(stem(w)) <= len(w) + 1
    assert all(len(groups) == 1 for groups in stems.values()) and words >= 26


def test_regions():
    r = Language("aeiou", ())
    assert r.regions("beautiful") == {"all": 0, "r1": 5, "r2": 7, "rv": 3}
    assert r.regions("beau") == {"all": 0, "r1": 4, "r2": 4, "rv": 3} and r.regions("oliva")["rv"] == 3
    assert r.regions("trabajo")["rv"] == 3 and r.regions("aureo")["rv"] == 3 and r.regions("xy")["rv"] == 2


def test_steps():
    step = Step("r1", "ed ing>e inged", before="tg", not_before=("ut",))
    assert step.applied("busting", 3) == "buste" and step.applied("busting", 5) is None
    assert step.applied("cutting", 0) == "cutte" and step.applied("puting", 0) is None and step.applied("moved", 0) is None
    assert step.applied("stinged", 0) == "st"


@pytest.mark.parametrize("language", sorted(LIGHT))
def test_odd_words_pass(language):
    stem = LIGHT[language].stem
    for w in ("", "a", "12", "x1y2", "日本語", "ß", "s", "sss", "aaaa", "ενα", "ﬁne", "e\u0301te"):
        assert isinstance(stem(w), str)
    assert stem("12abcs") == "12abcs" and stem("") == ""


def test_every_language_has_a_stemmer():
    assert set(STEMMERS) == {analyzer for _, analyzer, _ in LANGUAGES if analyzer}


def test_rows_are_stemmed_by_their_language(spark):
    rows = [("de", "Häuser und Katzen"), ("es", "niñas hablando"), ("en", "running dogs"), ("xx", "running dogs"), (None, "dogs")]
    df = spark.createDataFrame(rows, "lang string, text string")
    out = cl.AnalyzeText("text", "t", cl.Analyzer(lang_col="lang", stem=True, stop=False)).transform(df).collect()
    assert {r["lang"]: r["t"] for r in out} == {
        "de": ["haus", "und", "katz"], "es": ["nin", "habl"], "en": ["run", "dog"], "xx": ["running", "dogs"], None: ["dogs"],
    }


def test_query_stem_by_language(spark):
    """Held against the tables, word by word."""
    import re

    import __spark_entry__ as entry_points

    sf = "/root/testdata/sf0.001"
    out = {r["doc_id"]: r["terms"] for r in entry_points.queries()["stem_by_language"](spark, sf).collect()}
    names = {code.lower(): analyzer for code, analyzer, _ in LANGUAGES}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        words = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", (d["text"] or "").lower())
        stem = STEMMERS.get(names.get(d["lang"]), lambda w: w)
        if names.get(d["lang"]) == "english":
            words = [re.sub("['’]s$", "", w) for w in words]
        assert out[d["doc_id"]] == " ".join(map(stem, words)), d["doc_id"]
