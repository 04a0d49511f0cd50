"""corpusloom: enrich and explore text corpora with Spark DataFrames."""

from .functions.dictionary import BroadcastDictionary, InlineDictionary, TableDictionary, dictionary
from .functions.languages import languages, stop_words
from .functions.phrases import Phrases, synonym_rules
from .operators.analysis import AnalyzeText, Analyzer
from .operators.annotate import Annotator, DictionaryAnnotator, ModelAnnotator
from .operators.cells import VectorCells
from .operators.html import parse_html, parse_html_files
from .operators.linguistics import LinguisticEnrichment, widen
from .operators.sentiment import LexiconSentiment
from .operators.stages import (
    MapToNamedTags,
    MapToSingle,
    MapToTags,
    RegexTag,
    Split,
    Stage,
    SynonymTags,
    TableStage,
)
from .operators.vectors import WordVectors, group_centroids, nearest_neighbours, pairwise_distances
from .plans.panels import DateHistogram, Histogram, HorizontalBar, Panel, TagCloud, dashboard, dashboard_table
from .plans.pipeline import Pipeline
from .roles import Roles
from .sources.index import Index
from .sources.tables import head, html_files, read_texts, union_by_name

__version__ = "0.1.0"

# Functions run by Python workers travel with the job: nothing has to be
# installed on the executors.
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_")]
