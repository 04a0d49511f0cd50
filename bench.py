"""Headline queries on the test tables; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores.
Each query is run to its last row, without collecting; the sum is the value.
``docs_per_sec`` relates the enrichment run to the 10,000 documents of sf0.1.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES, registry  # noqa: E402
from catalog.registry import table  # noqa: E402
from corpusloom.session import local_session  # noqa: E402

# The whole enrichment run comes first, as in an application of its own.
HEADLINE = [
    "enriched_index",
    "regex_tags_math",
    "analyzed_terms",
    "stop_by_language",
    "stem_terms",
    "tag_cloud_top20",
    "sentiment_compound",
    "nlp_counts",
    "nlp_entities",
    "nlp_pos_counts",
    "doc_vector",
    "dashboard_corpus",
    "dashboard_events",
    "date_histogram_2h",
    "histogram_auto",
    "upsert_latest",
    "html_body",
    "html_meta_unbox",
    "group_centroid",
    "knn_cosine",
    "term_match",
    "term_postings",
    "json_docs",
    "stream_date_histogram",
    "stream_enrich",
]


# The better of so many runs counts; the first one, which also compiles the plan's code, is given beside it.
RUNS = 2


def seconds(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, "bench")
    names = sys.argv[1:] or HEADLINE
    # Each test table is one row group, which would be one task.
    registry.PARTITIONS = int(cpus)
    # Start the JVM's compiler and the Python workers before the clock.
    QUERIES["custom_stage"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in names:
        runs = [round(seconds(spark, sf_dir, name), 3) for _ in range(RUNS)]
        first[name], took[name] = runs[0], min(runs)
        print(name, *runs, file=sys.stderr, flush=True)
    result = {"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took}
    result["first_runs"] = first
    if "enriched_index" in took:
        n = table(spark, sf_dir, "documents").count()
        result["docs_per_sec"] = round(n / took["enriched_index"], 1)
    result["sf"] = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
