"""The pipeline's near-copy stage takes candidates from ball hashing of the fingerprints, too."""

import corpus_pipeline
from corpusloom.llm import simhash


def test_stage_links_fingerprints(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(reversed(words)), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, *a: seen.append(prints.count()) or links(prints, *a))
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert {r["doc_id"] for r in kept} == {1, 3, 4}
    assert len(seen) == 1 and seen[0] >= 2


def test_fingerprint_pairs_are_candidates(spark):
    rows = [(1, 7, 10, [0] * 16), (2, 7, 10, [0] * 16), (3, 5, 10, [0] * 16), (4, 1 << 40, 10, [0] * 16)]
    classes = spark.createDataFrame(rows, "cid long, fp long, n int, signature array<long>")
    pairs = simhash._balls(classes, classes.select("cid", "n", "signature"), 0.8)
    # 5 and 7 differ in one bit, 2^40 in more than two.
    assert {tuple(r) for r in pairs.collect()} == {(2, 1), (3, 1)}
