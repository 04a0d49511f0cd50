"""Quality classifier, fill in the middle, periodic runs: brute force, edge cases, held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_points
from corpusloom.llm import fill_middle as fm
from corpusloom.llm import periodic_runs as pr
from corpusloom.llm import quality as ql

QUERIES = entry_points.queries()
SF = "/root/testdata/sf0.01"
# Names the operators use themselves, as columns of the input.
SCHEMA = "doc_id long, text string, row int, key string, th string, form int, n_units string, runs string, score string"
LONG = " ".join(f"wörd{i % 977}" for i in range(40_000))
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "日本語 𝔘 Ünï ſ"), (6, "a <P> b"), (7, LONG), (8, "ab ab ab ab ab ab ab ab"),
    (8, "other text of the id"), (9, "one two"), (9, "one two"), (None, "no id at all"), (None, None), (10, "\n" * 40), (11, "é" * 50),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, 1, "k", "b", 2, "u", "r", "s") for i, t in EDGE], SCHEMA).repartition(3)


def pairs(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)


# --- 12: fill in the middle --------------------------------------------------


def plain_fim(text, key, unit="word", cut=90, first=20, seed="1:"):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text) if unit == "word" else list(text)
    n = len(units)
    digest = hashlib.sha256((seed + key).encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rule", [fm.Rule(), fm.Rule("char", 100, 50, "other"), fm.Rule("word", 0)])
def test_fim_edges(edge, rule):
    out = fm.fill_in_middle(edge, rule=rule)
    assert out.columns == [*edge.columns, "prefix_chars", "middle_chars", "output"]
    rows = out.select("*", fm.restored("output", "form").alias("back")).collect()
    assert pairs(rows) == sorted(EDGE, key=repr) and all((r["row"], r["key"], r["th"]) == (1, "k", "b") for r in rows)
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        want = plain_fim(r["text"], key, rule.unit, rule.cut_percent, rule.suffix_first_percent, rule.seed)
        assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["back"] == (r["text"] or "")
    assert fm.fill_in_middle(edge.where("false")).collect() == []


def test_fim_random_texts_and_pieces(monkeypatch):
    random.seed(3)
    monkeypatch.setattr(fm, "PIECE", 5)
    for k in range(2000):
        text = "".join(random.choice("abZ <éß日𝔘\n1") for _ in range(random.randrange(0, 40)))
        for unit in ("word", "char"):
            n, form, p, m, out = fm.transform(text.encode(), str(k), fm.Rule(unit))
            assert (n, form, p, m, out.decode()) == plain_fim(text, str(k), unit)


def test_exception_index():
    text = "aé日b𝔘c"
    index = fm.Exceptions.of(np.frombuffer(text.encode(), dtype=np.uint8))
    assert len(index.at) == 3 and index.excess.tolist() == [0, 1, 3, 6]
    for char in range(len(text) + 1):
        byte = len(text[:char].encode())
        assert index.chars(byte) == char and index.bytes(char) == byte
    assert len(fm.Exceptions.of(np.frombuffer(b"ascii only", dtype=np.uint8)).at) == 0


# --- 13: periodic runs -------------------------------------------------------


def plain_lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(words, least=12):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= 2 * q and not any(s <= i and s + m >= j + q for s, m, _ in found):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted((r for r in found if r[1] >= least), key=lambda r: (r[0], r[2]))


def test_lyndon_lengths():
    random.seed(5)
    for _ in range(1500):
        parts = [[random.randrange(random.choice([1, 2, 4])) + 1 for _ in range(random.randrange(30))] for _ in range(3)]
        found = pr.lyndon_lengths([x for p in parts for x in [*p, 0]], 6)
        assert found == [x for p in parts for x in [*plain_lyndon(p), 0]]


@pytest.mark.parametrize("least", [1, 5, 12])
def test_runs_equal_brute_force(least):
    random.seed(least)
    for _ in range(700):
        texts = []
        for _ in range(random.randrange(1, 5)):
            n, k = random.randrange(70), random.choice([1, 2, 3, 30])
            words = [b"%d" % random.randrange(k) for _ in range(n)]
            if n and random.random() < 0.6:
                a = random.randrange(n)
                p = random.randrange(1, n - a + 1)
                words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            texts.append(words)
        got = [[tuple(r) for r in rows.tolist()] for rows in pr.runs_of_texts(texts, least)]
        assert got == [plain_runs(w, least) for w in texts]


def test_strings_with_many_runs():
    fibonacci, morse = ["a", "ab"], [0]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    while len(morse) < 400:
        morse += [1 - x for x in morse]
    texts = [[c.encode() for c in fibonacci[-1]], [b"%d" % x for x in morse], [b"x"] * 400]
    got = [[tuple(r) for r in rows.tolist()] for rows in pr.runs_of_texts(texts, 4)]
    assert got == [plain_runs(w, 4) for w in texts] and got[2] == [(0, 400, 1)]


def test_runs_edges(edge):
    out = pr.periodic_runs(edge)
    assert out.columns == [*edge.columns, "n_words", "collapsed"]
    rows = out.select("*", pr.longest("runs").alias("best")).collect()
    assert pairs(rows) == sorted(EDGE, key=repr) and all((r["row"], r["key"], r["score"]) == (1, "k", "s") for r in rows)
    for r in rows:
        words = (r["text"] or "").encode().split()
        # The long text is one run from end to end.
        runs = [(0, len(words), 977)] if r["doc_id"] == 7 else plain_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(words), runs, b" ".join(kept).decode())
        assert (tuple(r["best"]) if r["best"] else None) == max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    assert pr.periodic_runs(edge.where("false")).collect() == []


# --- 11: quality -------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    out = QUERIES["op11_quality_classifier"](spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in out.collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
    told = [(r["quality"], rows[r["doc_id"]]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(q, r["predicted"]) for q, r in told if r["held_out"]]
    assert len(held) > 80 and np.mean([q == p for q, p in held]) > 0.95
    # Another partitioning learns and says the same.
    model = ql.fit(docs.where(~ql.held_out()).repartition(5), spark.read.parquet(f"{SF}/labels.parquet").repartition(3))
    again = ql.score(docs.repartition(7), model, keep=["doc_id"]).collect()
    assert all(r["score"] == pytest.approx(rows[r["doc_id"]]["score"], abs=1e-6) for r in again)


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = ql.held_out().alias("h")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = (ql.fit(docs.where(~ql.held_out()), x) for x in (labels, flipped))
    assert (a == b).all() and docs.select(held).distinct().count() == 2


def plain_buckets(text, settings):
    """Every bucket of a text, one for each time it counts, by the operator's own hashes of single texts."""
    out = []
    for w in (text or "").split():
        f = ql.Features([w], settings)
        out += f.buckets.tolist()
    f = ql.Features([text], settings)
    return sorted(out + f.pairs.tolist() + [f.end])


def test_quality_features_and_scores_of_blocks():
    settings = ql.Settings(bits=10)
    texts = ["a b a a", None, "", "Größe größe a", "x" * 300, "é è é"]
    features = ql.Features(texts, settings)
    table = np.random.default_rng(1).normal(size=(1 << 10, 2))
    scores = features.scores(table)
    for text, (buckets, times), score in zip(texts, features.bags(), scores):
        flat = np.repeat(buckets, times.astype(int)).tolist()
        assert flat == plain_buckets(text, settings)
        logits = table[flat].mean(axis=0)
        assert score == pytest.approx(1 / (1 + np.exp(logits[0] - logits[1])))
    # A word said again is one thing, whichever word.
    again = [set(ql.Features([f"{w} {w}"], settings).pairs.tolist()) for w in "ab"]
    assert again[0] == again[1]


def test_quality_edges(spark, edge):
    labels = spark.createDataFrame(
        [(4, 1), (4, 0), (4, 1), (8, 0), (9, 0), (7, 1), (None, 1), (2, None), (1, 1), (77, 0)], "doc_id long, quality int"
    )
    model = ql.fit(edge, labels)
    out = ql.score(edge, model)
    rows = out.collect()
    assert out.columns == edge.columns and pairs(rows) == sorted(EDGE, key=repr)
    assert all(0 <= r["score"] <= 1 and (r["row"], r["key"]) == (1, "k") for r in rows)
    same = {}
    for r in rows:
        same.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in same.values())
    none = ql.fit(edge, labels.where("false"))
    assert not none.any() and {r["score"] for r in ql.score(edge, none).collect()} == {0.5}
    one = {r["doc_id"]: r["score"] for r in ql.score(edge, ql.fit(edge, labels.where("quality = 1"))).collect()}
    assert min(one.values()) > 0.5
    assert not ql.fit(edge.where("false"), labels).any() and ql.score(edge.where("false"), model).collect() == []
    # The bound holds, whatever the number of labels and of documents of an id.
    many = ql.fit(edge.union(edge).union(edge), labels, sample=2)
    assert many.any()
