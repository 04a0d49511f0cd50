"""The registered queries on the smallest tables: against SQL, or against plain Python."""

import numpy as np
import pytest

import __spark_entry__ as entry_points
import brute
from compare import differences, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
OURS = sorted(n for n in QUERIES if n.startswith("op") and n[2].isdigit())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


def test_all_operators_and_the_pipeline():
    assert {n.split("_")[0] for n in OURS} == {f"op{i}" for i in range(1, 14)} and "pipeline" in QUERIES


@pytest.mark.parametrize("name", [n for n in OURS if n in ORACLES])
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


def test_op3_equals_brute_force(spark, docs):
    import zlib

    out = {r["doc_id"]: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in docs}
    counts = {}
    for i, text, lang in docs:
        if not held[i] and lang is not None and text is not None:
            counts.setdefault(lang, brute.Counter()).update(brute.runs(text))
    profiles = {lang: {r: k for k, r in enumerate(brute.top_runs(c, 400))} for lang, c in counts.items()}
    assert len(out) == len(docs)
    for i, text, _ in docs:
        lang, score = brute.language(text, profiles, 400)
        assert (out[i]["lang_pred"], out[i]["held_out"]) == (lang, held[i])
        assert out[i]["score"] == pytest.approx(score)


def test_op3_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op3_language_id"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    right, n = out.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert n > 250 and right / n > 0.98


def test_op4_gives_the_articles(spark):
    """On these pages the article is an element of its own."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = QUERIES["op4_html_extraction"](spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", article)
        wanted = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks]
        assert r["text"] == "\n".join(b for b in wanted if b) and r["n_chars"] == len(r["text"])


def test_op6_equals_brute_force(spark, docs):
    out = {r["doc_id"]: r for r in QUERIES["op6_simhash_near_dedup"](spark, SF).collect()}
    prints = [brute.fingerprint(text) for _, text, _ in docs]
    least = brute.components(len(docs), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert len(out) == len(docs)
    for k, (i, _, _) in enumerate(docs):
        assert out[i]["fingerprint"] == f"{prints[k]:016x}" and out[i]["component_id"] == docs[least[k]][0]


def test_op7_packs_every_token_once(spark, docs):
    check_packing(QUERIES["op7_best_fit_packing"](spark, SF).collect(), {i: len((t or "").encode()) + 1 for i, t, _ in docs})


def check_packing(rows, lengths, capacities=(1024, 2048, 4096, 8192)):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["start"] + r["n_tokens"]))
        bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_tokens"], r["bin_fill"], r["capacity"]))
    assert pieces.keys() == lengths.keys()
    for i, spans in pieces.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == lengths[i] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for held in bins.values():
        held.sort()
        assert [h[0] for h in held] == list(np.cumsum([0] + [h[1] for h in held[:-1]]))
        fill = sum(h[1] for h in held)
        assert {(h[2], h[3]) for h in held} == {(fill, min(c for c in capacities if c >= fill))}


def test_op9_round_trip(spark, docs):
    import hashlib

    from corpusloom.llm import token_output as to

    made, index = to.write_shards(spark.read.parquet(f"{SF}/documents.parquet"), sequence=512, shard_sequences=64)
    rows = {r["number"]: r for r in index.collect()}
    assert sorted(rows) == list(range(made.sequences)) and sorted(r["slot"] for r in rows.values()) == list(range(made.sequences))
    assert [rows[n]["slot"] for n in range(made.sequences)] == to.permuted(np.arange(made.sequences), made.sequences, made.key).tolist()
    slots = list(to.read_slots(made, 0, made.sequences))
    assert len(slots) == made.sequences and all(len(s) == 512 for s in slots)
    stream = np.concatenate([slots[rows[n]["slot"]][: rows[n]["n_tokens"]] for n in range(made.sequences)])
    with open(to.VOCABULARY, "rb") as f:
        encoding = to.encoder(f.read())
    texts = [encoding.decode(part.tolist()) for part in np.split(stream, np.flatnonzero(stream == made.end) + 1)[:-1] for part in [part[:-1]]]
    assert sorted(texts) == sorted(t or "" for _, t, _ in docs)
    digest = lambda ids: hashlib.sha256(ids.tobytes()).hexdigest()
    read = to.read_index(made, index, "d", "string", digest).collect()
    assert all(r["d"] == digest(slots[r["slot"]]) for r in read)
    # From the middle on, over the border of a shard.
    assert [s.tolist() for s in to.read_slots(made, 60, 70)] == [s.tolist() for s in slots[60:70]]


def test_op9_query_gives_every_slot(spark):
    out = QUERIES["op9_token_shards"](spark, SF)
    n = out.count()
    assert n > 0 and out.where("n_tokens > 0 AND size(doc_ids) > 0").select("slot").distinct().count() == n


def test_pipeline_equals_brute_force(spark, docs, con):
    import zlib

    from corpusloom.llm.packing import bin_cost

    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in docs}
    counts = {}
    for i, text, lang in docs:
        if not held[i]:
            counts.setdefault(lang, brute.Counter()).update(brute.runs(text))
    profiles = {lang: {r: k for k, r in enumerate(brute.top_runs(c, 400))} for lang, c in counts.items()}
    kept = [(i, t) for i, t, _ in docs for lang, score in [brute.language(t, profiles, 400)] if lang != "und" and score >= 0.2]
    kept = [(i, t) for i, t in brute.dedup_lines(kept).items() if t.strip()]
    sets = [frozenset(brute.shingles(t, 5)) for _, t in kept]
    alike = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    kept = [kept[k] for k, least in enumerate(brute.components(len(kept), alike)) if k == least]
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    clean = []
    for i, t in kept:
        words, hit, _ = brute.contamination(t, items)
        if not (hit and 20 * hit >= words):
            clean.append((i, t))
    assert len(clean) < len(kept) < len(docs)
    rows = QUERIES["pipeline"](spark, SF).collect()
    check_packing(rows, {i: len(t.encode()) + 1 for i, t in clean})
    # One shard here, so the bins are those of the plain rule.
    lengths = sorted((r["n_tokens"] for r in rows), reverse=True)
    bins = {}
    for r in rows:
        bins.setdefault((r["bin_id"], r["capacity"]), []).append(r["n_tokens"])
    wanted = brute.best_fit(lengths, (1024, 2048, 4096, 8192), bin_cost)
    assert sorted((c, sorted(held)) for (_, c), held in bins.items()) == sorted((c, sorted(held)) for c, held in wanted)
