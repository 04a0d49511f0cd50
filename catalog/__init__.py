"""Queries over the test tables, each with the SQL that must give the same rows."""

import sys

from pyspark import cloudpickle

from .registry import ORACLES, QUERIES
from . import aggregates, corpus, searches, tables, texts, vectors  # noqa: F401  (fill the registry)

# Stages defined here in Python run on workers that do not know this folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ORACLES", "QUERIES"]
