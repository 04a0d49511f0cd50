import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from corpusloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        4, "tests", **{"spark.checkpoint.dir": str(shared), "spark.driver.memory": "6g"}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def edge_texts(spark):
    """Null, empty, blank, repeated and accented texts over several partitions."""
    rows = [
        (1, None),
        (2, ""),
        (3, " "),
        (4, "no match here"),
        (5, "a=1 b=2 a=1"),
        (6, "Café Ünïté café. It's Anna's book! Really?"),
        (7, "doi:10.1/x and doi:10.1/x"),
    ]
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def rows_by_id(df, col, key="id"):
    return {r[key]: r[col] for r in df.select(key, col).collect()}
