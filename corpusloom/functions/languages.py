"""Languages: analyzer names, model names and stop words."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Two-letter code, analyzer name (none for the multi-language
# entry), names of the published language models.
LANGUAGES = [
    ("DE", "german", ["de_core_news_sm", "de_core_news_md"]),
    ("EL", "greek", ["el_core_news_sm", "el_core_news_md"]),
    ("EN", "english", ["en_core_web_sm", "en_core_web_md", "en_core_web_lg", "en_vectors_web_lg"]),
    ("ES", "spanish", ["es_core_news_sm", "es_core_news_md"]),
    ("FR", "french", ["fr_core_news_sm", "fr_core_news_md"]),
    ("IT", "italian", ["it_core_news_sm"]),
    ("NL", "dutch", ["nl_core_news_sm", "nl_core_news_md"]),
    ("PT", "portuguese", ["pt_core_news_sm"]),
    ("XX", None, ["xx_ent_wiki_sm"]),
]

ANALYZER_OF_CODE = {code: analyzer for code, analyzer, _ in LANGUAGES}

# The usual English stop set of search analyzers.
ENGLISH_STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there "
    "these they this to was will with"
).split()

# Greek is missing from Spark's own lists.
GREEK_STOP_WORDS = (
    "ο η το οι τα του τησ τησ των τον την και κι κ ειμαι εισαι ειναι ειμαστε ειστε στο στον στη στην μα "
    "αλλα απο για προσ με σε ωσ παρα αντι κατα μετα θα να δε δεν μη μην επι ενω εαν αν τοτε που πωσ ποιοσ "
    "ποια ποιο ποιοι ποιεσ ποιων ποιουσ αυτοσ αυτη αυτο αυτοι αυτων αυτουσ αυτεσ αυτα εκεινοσ εκεινη "
    "εκεινο εκεινοι εκεινεσ εκεινα εκεινων εκεινουσ οπωσ ομωσ ισωσ οσο οτι"
).split()


def languages(spark: SparkSession) -> DataFrame:
    """The registry as a table ``(code, analyzer, models)``."""
    return spark.createDataFrame(LANGUAGES, "code string, analyzer string, models array<string>")


def _list_shipped_with_spark(language: str) -> list[str]:
    """Spark's stop word list, read from its own jar so that no session is needed."""
    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for jar in glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            text = z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode("utf-8")
            return [w for w in text.splitlines() if w]
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(language)


@lru_cache(maxsize=None)
def stop_words(language: str) -> tuple[str, ...]:
    """Lowercase stop words of an analyzer language, each once and sorted."""
    known = {a for _, a, _ in LANGUAGES if a}
    if language not in known:
        raise ValueError(f"no stop words for {language!r}; known: {sorted(known)}")
    if language == "english":
        words = ENGLISH_STOP_WORDS
    elif language == "greek":
        # Plain lowercasing keeps the final form of sigma.
        words = GREEK_STOP_WORDS + [w[:-1] + "ς" for w in GREEK_STOP_WORDS if w.endswith("σ")]
    else:
        words = _list_shipped_with_spark(language)
    return tuple(sorted({w.strip().lower() for w in words if w.strip()}))
