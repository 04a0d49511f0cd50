"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, operator by operator."""

import random
import re

import numpy as np
import pytest

import brute
from corpusloom.llm import chat_format as cf
from corpusloom.llm import html_extract as he
from corpusloom.llm import packing, simhash, topk
from corpusloom.llm import token_output as to
from corpusloom.llm.components import components
from corpusloom.llm.decontaminate import contamination, decontaminated
from corpusloom.llm.html_samples import labelled_pages
from corpusloom.llm.html_tree import parse_page
from corpusloom.llm.language_id import identify, learn_profiles
from corpusloom.llm.line_dedup import dedup_lines
from corpusloom.llm.secret_scan import find_secrets

# Names the operators use themselves, as columns of the input.
SCHEMA = "doc_id long, text string, row int, id string, th string, start int, n int, copies int, words string"
LINES = "one a\ntwo b\n\nthree c\nfour d"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EDGE = [
    (1, None), (2, ""), (3, "   \n\t "), (4, LINES), (5, "zero\n" + LINES + "\nfive"), (5, "other text\nof the same id\nas before"),
    (6, LINES), (6, LINES), (None, LINES), (None, None), (7, LONG), (8, "x"), (9, "ÄÖ École ſ 日本 𝔘"), (10, "\n\n\n"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, 1, "b", None, 2, None, 3, "w") for i, t in EDGE], SCHEMA).repartition(3)


def empty(edge):
    return edge.where("false")


def key(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


# --- 1 -----------------------------------------------------------------------


def test_line_dedup_edges(edge):
    out = dedup_lines(edge)
    assert out.columns == [*edge.columns, "n_lines_removed"]
    rows = out.collect()
    assert len(rows) == len(EDGE) and all((r["row"], r["id"], r["copies"]) == (1, "b", 3) for r in rows)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["text"], r["n_lines_removed"]))
    assert got[1] == [(None, 0)] and got[2] == [("", 0)] and got[10] == [("\n\n\n", 0)]
    assert got[4] == [(LINES, 0)]
    assert sorted(got[5]) == [("other text\nof the same id\nas before", 0), ("zero\nfive", 5)]
    # Rows alike in id and text are one document, and meet the same end.
    assert got[6] == [("", 5), ("", 5)]
    assert sorted(got[None], key=repr) == [("", 5), (None, 0)]
    assert dedup_lines(empty(edge)).count() == 0


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(3)
    docs = [(i, "\n".join(r.choice("abcde") * r.randint(1, 2) for _ in range(r.randint(0, 30)))) for i in range(60)]
    out = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {x["doc_id"]: x["text"] for x in out.collect()} == brute.dedup_lines(docs)


# --- 2 -----------------------------------------------------------------------


def spans_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [[tuple(s) for s in r["spans"]] for r in find_secrets(df).orderBy("doc_id").collect()]


def test_secret_spans(spark):
    hexes, access = "0123456789abcdef01234567", "AKIA" + "Q" * 16
    got = spans_of(
        spark,
        f"é𝔘 {access} ,{hexes}",
        "PassWord = 'abc' token:abcdef; api-key=abcdef apikey=\"abcdef",
        "password:token: abcdefgh",  # the first match fails for its length and takes the second keyword with it
        f"{access}{access} AKIA {hexes[:23]}",
        None,
        "ſecret=abcdefgh toKen=abcdefgh",  # only ASCII letters have two cases
    )
    assert got[0] == [("access", 3, 23), ("hex", 25, 49)]
    assert got[1] == [("assign", 17, 29), ("assign", 46, 60)]
    assert got[2] == [] and got[3] == [("access", 0, 40)] and got[4] == []
    assert got[5] == [("assign", 16, 30)]


def test_weak_parts_count_only_together(spark):
    weak = "Ab1" * 12
    got = spans_of(
        spark,
        f"{weak} and https://db.example.org:99/x",
        f"user: alice {weak} https://db.example.org:99/x",
        "user: alice" + " " * 300 + weak,
        "user: alice only",
        f"token={weak} user=bob",
    )
    assert got[0] == [] and got[2] == [] and got[3] == []
    assert got[1] == [("ident", 0, 11), ("opaque", 12, 48), ("endpoint", 49, 74)]
    assert got[4] == [("assign", 0, 42), ("ident", 43, 51)]


def test_the_scope_is_the_gap_between_spans(spark):
    long, ident, place = "secret=" + "x" * 400, "user: anna", "https://db.example.org"
    df = spark.createDataFrame(
        [(1, f"{ident} {long}{' ' * 200}{place}"), (2, f"{ident} {long}{' ' * 201}{place}"), (3, f"{place}{' ' * 200}{long} {ident}"),
         (4, f"{ident}{' ' * 200}{long}"), (5, f"{ident}{' ' * 201}{long}"), (6, f"{long}{' ' * 200}{ident}"), (7, f"{long}{' ' * 201}{ident}")],
        "doc_id long, text string",
    )
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in find_secrets(df).collect()}
    # The endpoint of 1 and 2 is more than 200 from the identifier; in 3 too.
    assert kinds == {1: ["ident", "assign"], 2: ["ident", "assign"], 3: ["assign", "ident"], 4: ["ident", "assign"], 5: ["assign"],
                     6: ["assign", "ident"], 7: ["assign"]}
    both = spark.createDataFrame([(1, f"{long} {ident} {place}"), (2, f"{place}{' ' * 189}{ident} {long}"), (3, f"{place}{' ' * 190}{ident} {long}")], "doc_id long, text string")
    assert {r["doc_id"]: len(r["spans"]) for r in find_secrets(both).collect()} == {1: 3, 2: 3, 3: 2}


def test_secret_edges(spark, edge):
    rows = find_secrets(edge).collect()
    assert len(rows) == len(EDGE) and all(r["spans"] == [] for r in rows)
    assert find_secrets(empty(edge)).count() == 0
    many = "token=abcdef " * 3000
    twice = spark.createDataFrame([(1, many), (1, many), (None, "secret:abcdef"), (None, "secret:abcdef")], "doc_id long, text string")
    got = find_secrets(twice).collect()
    assert [len(r["spans"]) for r in got if r["doc_id"] == 1] == [3000, 3000]
    assert [[tuple(s) for s in r["spans"]] for r in got if r["doc_id"] is None] == [[("assign", 0, 13)]] * 2
    last = next(r for r in got if r["doc_id"] == 1)["spans"][-1]
    assert tuple(last) == ("assign", 13 * 2999, 13 * 2999 + 12)


# --- 3 -----------------------------------------------------------------------


def test_language_edges(spark, edge):
    labelled = spark.createDataFrame(
        [("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "xx"), ("...", "yy"), ("no label", None)],
        "text string, lang string",
    )
    profiles = learn_profiles(labelled)
    assert sorted(profiles.runs) == ["de", "en"]
    out = identify(edge.selectExpr("*", "'old' AS score"), profiles)
    rows = out.collect()
    assert out.columns == [*edge.columns, "lang_pred", "score"] and len(rows) == len(EDGE)
    for r in rows:
        no_letter = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == no_letter and 0 <= r["score"] <= 1 and (r["score"] == 0 or not no_letter)
    assert identify(empty(edge), profiles).count() == 0
    nothing = learn_profiles(labelled.where("false"))
    assert {r["lang_pred"] for r in identify(edge, nothing).collect()} == {"und"}


# --- 4 -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return he.train()


def test_marginals_equal_enumeration():
    """Sum-product on a small forest against the sum over all labellings."""
    import itertools

    pages = [parse_page("<div><p>a<p>b<ul><li>c</ul></div>"), parse_page("<p>z")]
    forest = he.forest_of(pages)
    r = np.random.default_rng(5)
    node, edge = r.normal(size=(len(forest.parents), 2)), r.normal(size=(len(forest.parents), 2, 2))
    marginal, joint = he.sum_product(forest, node, edge)
    total, wanted, wanted_joint = 0.0, np.zeros_like(node), np.zeros_like(edge)
    for labels in itertools.product((0, 1), repeat=len(node)):
        weight = np.exp(
            sum(node[i, v] for i, v in enumerate(labels))
            + sum(edge[i, labels[p], labels[i]] for i, p in enumerate(forest.parents) if p >= 0)
        )
        total += weight
        for i, v in enumerate(labels):
            wanted[i, v] += weight
            if forest.parents[i] >= 0:
                wanted_joint[i, labels[forest.parents[i]], v] += weight
    assert np.allclose(marginal, wanted / total)
    inner = forest.parents >= 0
    assert np.allclose(joint[inner], wanted_joint[inner] / total)


def test_held_out_pages(model):
    pages = [parse_page(p, "data-label") for p in labelled_pages(150, seed=12345)]
    forest = he.forest_of(pages)
    got = model.marginals(forest) > 0.5
    wanted = np.concatenate([he.labels_of(p) for p in pages]) == 1
    has_text = np.concatenate([[bool(n.runs) for n in p.nodes] for p in pages])
    assert (got == wanted)[has_text].mean() > 0.98


def test_page_texts(model):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
      <div class="cookie-notice">We use cookies. Accept all of them now.</div>
      <article><h1>A  title</h1><p>First &amp; <b>bold</b>
      line&nbsp;here.<br>More of it, as it is told. <p>Second one &lt;x&gt; with &#233; in it.<script>var t="</p>";</script></p></article>
      <section id="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this at all.</p></div></section>
      <footer>&copy; example. All rights.</footer>"""
    assert he.extract_all([page, None, ""], model) == [
        "A title\nFirst & bold line here. More of it, as it is told.\nSecond one <x> with é in it.", "", ""
    ]


def runs_of(html):
    return [text for _, text, _ in parse_page(html).runs]


def test_a_head_without_end_and_unclosed_elements_hide_nothing_else():
    rest = "<article><p>First words.</p><p>More words.</p></article>"
    seen = ["First words.", "More words."]
    assert runs_of(f"<html><head><title>T</title><meta charset=x><style>p{{}}</style>{rest}") == seen
    assert runs_of(f"<head><title>T</title><noscript>N</noscript></head><body>{rest}") == seen
    assert runs_of("<head><script>s</script>Text <p>and more") == ["Text", "and more"]
    for tag in "select svg".split():
        assert runs_of(f"<div><p>A <{tag}>inside</p><p>B</p><div>C</div></div><p>D") == ["A", "B", "C", "D"], tag
        assert runs_of(f"<div>A <{tag}><div>inside</div> on</{tag}> B</div>") == ["A B"], tag
    # What stands in for something else, and formulas, are offered to the model.
    for tag in "object video audio canvas map noscript math".split():
        assert runs_of(f"<div><p>A <{tag}>inside</p><p>B</p><div>C</div></div><p>D") == ["A inside", "B", "C", "D"], tag
        assert runs_of(f"<div>A <{tag}><div>inside</div> on</{tag}> B</div>") == ["A", "inside", "on B"], tag
    assert runs_of("<div><button>a<button>b</button> C</div>") == ["C"]
    assert runs_of("<div>A <button>menu</button> B<p>See <button>the word</button> here</p></div>") == ["A B", "See the word here"]
    assert runs_of("<p>Let <math><mi>E</mi>=<mn>5</mn><annotation>\\E</annotation></math> be</p>") == ["Let E=5 be"]


def test_comments_and_content_that_is_no_markup():
    cases = {
        "<p>a<!-- <p>b</p> -->c</p>": ["ac"], "<p>a<!-->b<!--->c": ["abc"], "<p>a<!--x--!>b": ["ab"], "a <!-- open <p>b</p>": ["a"],
        "<p title='<!-- x'>a</p>b": ["a", "b"], "<p title=\"a>b\">c": ["c"], "<script>'<!--'</script><p>a": ["a"], "<style><p>x": [],
        "<textarea><!-- </textarea><p>a": ["a"], "<p>it's <b>5 < 6</b> \"q\"": ['it\'s 5 < 6 "q"'], "<p>a <b": ["a <b"], "<!--": [],
        "plain text &amp; no tag": ["plain text & no tag"], "<p a=b'c>d</p>e'": ["d", "e'"],
    }
    for html, runs in cases.items():
        assert runs_of(html) == runs, html


def test_a_page_without_elements_is_text(model):
    assert he.extract_all(["Just words, no tag at all.", "a <b>b</b>\n c"], model) == ["Just words, no tag at all.", "a b c"]


@pytest.mark.parametrize(
    "page", ["<!--" * 60_000, "<!-- -->" * 30_000, "<div>" * 40_000, "<p><table><tr><td>" * 10_000, "<!" * 100_000, '<a "' * 60_000,
             "<svg><div>" * 20_000 + "</p>" * 20_000, "<select>" * 30_000 + "</div>" * 30_000, "</p>" * 60_000, "<b a='" * 40_000 + ">", "<" * 200_000],
)
def test_hostile_pages_take_time_by_length(model, page):
    """A quarter of a megabyte; anything that grows with the square would take minutes."""
    import time

    start = time.process_time()
    assert isinstance(he.extract_all([page], model)[0], str)
    assert time.process_time() - start < 8


def test_unknown_declarations_and_long_numbers_do_not_cut_a_page():
    for odd in ("<![b]>", "<![ endif]>", "<![if !IE]>", "<![endif]>", "<![CDATA[x]]>", "<![>"):
        assert runs_of(f"<p>A{odd}<p>B</p><div>C</div>") == ["A", "B", "C"], odd
    assert runs_of(f"<p>A</p><p title='&#{'1' * 5000};'>B &#{'7' * 5000}; b</p><p>C") == ["A", "B \ufffd b", "C"]
    assert runs_of(f"<p>&#{'0' * 5000}65; b") == ["A b"]
    r = random.Random(5)
    bits = ["<!", "<![", "[", "]", ">", "<", "</", "p", "div ", "head", "<p>", "--", "&#", "&", "x", "=", "'", '"', " ", "<?", "script", "]]>"]
    for _ in range(5000):
        parse_page("".join(r.choices(bits, k=12)))


def test_broken_markup_and_long_pages(spark, model):
    deep = "<div>" * 3000 + "x"
    long = "<article>" + "<p>Some text that goes on. And on.</p>" * 20_000 + "</article>"
    pages = [deep, "<p", "</p></div>", "<!-- x", "<script>", "&#xD800; &bogus; &am", "<article><p>A &am"]
    assert all(isinstance(t, str) for t in he.extract_all(pages, model))
    assert he.extract_all([long], model)[0].count("\n") == 19_999
    df = spark.createDataFrame([(1, None, "a", 5), (1, long, "b", None), (None, "", None, 5)], "page_id long, html string, text string, row int")
    out = he.extract_text(df, model=model)
    assert out.columns == ["page_id", "html", "row", "text"]
    assert sorted(len(r["text"]) for r in out.collect())[:2] == [0, 0]
    assert he.extract_text(df.where("false"), model=model).count() == 0


# --- 5 -----------------------------------------------------------------------


def test_contamination_equals_brute_force(spark):
    r = random.Random(11)
    word = lambda: r.choice("abcd")  # noqa: E731  few words, so grams repeat and tie
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 120)))) for i in range(40)]
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 2, 5, 12, 13, 14, 20, 60])]
    items += [(20, docs[3][1][:60]), (21, docs[3][1][:60]), (22, None), (23, "Never!")]
    docs += [(100, None), (101, ""), (102, LONG), (103, "never")]
    out = contamination(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    rows = {x["doc_id"]: x for x in out.collect()}
    assert len(rows) == len(docs)
    for i, text in docs:
        words, hit, found = brute.contamination(text, items)
        x = rows[i]
        assert (x["n_words"], x["n_hit"], set(x["items"])) == (words, hit, found)
        assert x["contaminated"] == (hit > 0 and 20 * hit >= words)


def test_every_shared_window_is_found(spark):
    """The guarantee: a document that holds any one window of an item is hit there."""
    r = random.Random(5)
    item = [f"i{r.randint(0, 300)}" for _ in range(200)]
    docs = [(k, " ".join([f"x{k}", "y"] + item[k : k + 13] + ["z", f"x{k}"])) for k in range(188)]
    docs += [(1000 + k, " ".join(item[k : k + 12])) for k in range(0, 188, 9)]
    out = contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    )
    hits = {x["doc_id"]: x["n_hit"] for x in out.collect()}
    assert all(hits[k] == 13 for k in range(188)) and all(hits[k] == 0 for k in hits if k >= 1000)


def test_contamination_edges(spark, edge):
    items = spark.createDataFrame([(1, "word1 word2 word3"), (1, "word1 word2 word3"), (None, "x"), (3, None)], "item_id long, text string")
    rows = contamination(edge, items).collect()
    assert len(rows) == len(EDGE)
    assert {r["doc_id"]: r["items"] for r in rows}[8] == [None]
    assert contamination(edge, items.where("false")).where("n_hit > 0").count() == 0
    assert contamination(empty(edge), items).count() == 0
    kept = decontaminated(edge, items)
    assert kept.columns == edge.columns and key(kept.collect(), "doc_id", "text") == sorted((x for x in EDGE if x[0] != 8), key=repr)


# --- 6 -----------------------------------------------------------------------


def test_fingerprint_in_pieces(monkeypatch):
    whole = simhash.fingerprint(LONG)
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 1000)
    assert simhash.fingerprint(LONG) == whole == brute.fingerprint(LONG)


def test_links_connect_as_all_pairs_do(spark):
    r = random.Random(2)
    prints = set()
    for _ in range(40):
        base = r.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(6)}
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for radius in (2, 4) if len(prints) < 250 else (2,):
        if radius == 4:
            df = df.limit(20)
            some = [x["fp"] for x in df.collect()]
            chosen = [p for p in prints if signed(p) in some]
        else:
            chosen = prints
        found = {x["node"]: x["component"] for x in components(simhash.links(df, radius)).collect()}
        least = brute.components(len(chosen), lambda i, j: (chosen[i] ^ chosen[j]).bit_count() <= radius)
        groups, wanted = {}, {}
        for k, p in enumerate(chosen):
            groups.setdefault(found.get(signed(p), signed(p)), set()).add(p)
            wanted.setdefault(least[k], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(1299, 2000), (5, 5)]
    r = random.Random(1)
    r.shuffle(path)
    found = {x["node"]: x["component"] for x in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert {found[i] for i in range(301)} == {0} and {found[n] for n in (1000, 1150, 1299, 2000)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_edges(edge):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    blank = {("0" * 16, 1)}
    assert by_id[1] == by_id[2] == by_id[3] == by_id[10] == blank and blank < by_id[None]
    assert by_id[6] == by_id[4] and {c for _, c in by_id[4]} == {4}
    assert simhash.near_duplicates(empty(edge)).count() == 0


def test_one_of_each_edges(edge):
    out = simhash.one_of_each(edge)
    assert out.columns == edge.columns
    got = key(out.collect(), "doc_id", "text")
    # Blank texts are one group; so are all copies of the lines, and of the repeated rows one stays.
    assert got == sorted(((i, t) for i, t in EDGE if i in (1, 4, 7, 8, 9) or (i == 5)), key=repr)
    assert simhash.one_of_each(empty(edge)).count() == 0


def test_one_of_each_keeps_one_of_repeated_rows_and_near_copies(spark):
    r = random.Random(4)
    words = [f"w{r.randint(0, 5000)}" for _ in range(400)]
    near = words.copy()
    near[7] = "changed"
    far = words[:200] + [f"v{i}" for i in range(200)]
    docs = [(3, " ".join(words)), (3, " ".join(words)), (4, " ".join(near)), (5, " ".join(far)), (6, " ".join(words).upper())]
    out = simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in out) == [3, 5]


def brute_groups(texts, size=5, similarity=0.8):
    """How many components the links between all pairs of texts make."""
    shingles = [{tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (t.split() for t in texts)]
    number = {}
    ids = [np.array([number.setdefault(x, len(number)) for x in s]) for s in shingles]
    has = np.zeros((len(texts), len(number)), dtype=np.float32)
    for row, at in zip(has, ids):
        row[at] = 1
    common = has @ has.T
    sizes = has.sum(axis=1)
    near = common >= similarity * (sizes[:, None] + sizes - common) - 1e-4
    left, groups = set(range(len(texts))), 0
    while left:
        todo, groups = [left.pop()], groups + 1
        while todo:
            met = left & set(np.flatnonzero(near[todo.pop()]).tolist())
            left -= met
            todo += met
    return groups


def edited(r, words, n):
    """A text with ``n`` scattered words changed: each takes five shingles."""
    out = list(words)
    for k in r.sample(range(len(words) // 6), n):
        out[6 * k + 3] = f"x{r.random()}"
    return " ".join(out)


def test_one_of_each_tests_every_pair_of_many_edits_of_one_text(spark):
    r = random.Random(11)
    text = lambda name: [f"{name}{r.randint(0, 10**6)}" for _ in range(200)]
    # With the text itself all link to it, though hardly to each other; without it, only edits small enough do.
    one, other = text("p"), text("q")
    with_text = [" ".join(one)] + [edited(r, one, r.choice([2, 3, 4])) for _ in range(1000)]
    without_text = [edited(r, other, n) for n in r.choices([1, 2, 3, 4], [1, 5, 47, 47], k=400)]
    expected = brute_groups(with_text), brute_groups(without_text)
    assert expected[0] == 1 and 20 < expected[1] < 380
    docs = list(enumerate(with_text + without_text))
    kept = [x["doc_id"] for x in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert (sum(i < 1001 for i in kept), sum(i >= 1001 for i in kept)) == expected


# --- 7 -----------------------------------------------------------------------


def test_best_fit_equals_the_plain_rule():
    r = random.Random(8)
    for _ in range(30):
        lengths = sorted((r.randint(1, 64) for _ in range(r.randint(0, 120))), reverse=True)
        cost = lambda c: 5 + c + c * c / 200
        places, kept = packing.best_fit(lengths, (16, 32, 64), cost)
        bins = {}
        for n, (b, at) in zip(lengths, places):
            assert at == sum(bins.setdefault(b, []))
            bins[b].append(n)
        assert [(kept[b], held) for b, held in sorted(bins.items())] == brute.best_fit(lengths, (16, 32, 64), cost)


def test_packing_edges(spark, edge):
    from test_llm_queries import check_packing

    rows = packing.pack(edge, capacities=(16, 64, 4096), shard_pieces=8).collect()
    ids = [r["doc_id"] for r in rows]
    assert ids.count(6) == 2 and ids.count(None) == 2 and len({r["bin_id"] >> 32 for r in rows}) > 1
    unique = [(r, f"{i}") for i, r in enumerate(x for x in EDGE if x[0] not in (5, 6, None))]
    df = spark.createDataFrame([u[0] for u in unique], "doc_id long, text string")
    check_packing(
        packing.pack(df, capacities=(16, 64, 4096), shard_pieces=8).collect(),
        {i: len((t or "").encode()) + 1 for (i, t), _ in unique},
        (16, 64, 4096),
    )
    given = spark.createDataFrame([(1, None, None), (2, "a", -4), (3, "b", 100)], "doc_id long, text string, n int")
    assert key(packing.pack(given, length_col="n", capacities=(64,)).collect(), "doc_id", "n_tokens") == [(1, 0), (2, 0), (3, 36), (3, 64)]
    assert packing.pack(empty(edge)).count() == 0


def test_packing_keeps_large_ids_beside_null(spark):
    ids = [9007199254740993, None, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i, "text") for i in ids], "doc_id long, text string").coalesce(1)
    assert sorted((r["doc_id"] for r in packing.pack(df).collect()), key=repr) == sorted(ids, key=repr)
    names = spark.createDataFrame([("b", "text"), (None, "text"), ("a", "text")], "doc_id string, text string")
    assert {r["doc_id"] for r in packing.pack(names).collect()} == {"a", "b", None}


def test_packing_opens_a_larger_bin_where_that_is_cheaper():
    cost = packing.bin_cost
    spent = lambda lengths, sizes: sum(map(cost, packing.best_fit(lengths, sizes)[1]))
    # Three pieces of a little more than half of 2048 share one bin of 4096 ...
    places, kept = packing.best_fit([1100] * 3, (2048, 4096))
    assert places == [(0, 0), (0, 1100), (0, 2200)] and kept == [4096]
    assert spent([1100] * 3, (2048, 4096)) < spent([1100] * 3, (2048,))
    # ... but one that would stay alone does not, nor do pieces that fill the smaller one.
    assert packing.best_fit([1100], (2048, 4096))[1] == [2048] and packing.best_fit([2048] * 2, (2048, 4096))[1] == [2048] * 2
    random.seed(9)
    lengths = sorted((random.randrange(1, 8192) for _ in range(3000)), reverse=True)
    least = {c: spent(lengths, (c,)) for c in (8192,)}
    assert spent(lengths, packing.CAPACITIES) < min(least.values())


def test_vectors_beyond_the_doubles_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e307, 1.0]), (50, [1e300, -1e300]), (51, [3.0, 1.0]), (100, [-1e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect())
    most = 2**63 - 1
    assert out == [(0, 1, 51, 65536 * 5), (0, 2, 50, -most - 1), (50, 1, 51, most), (50, 2, 0, -most - 1)]


# --- 8 -----------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "\\### Assistant: </turn> ok", "####\\", "</turn>\n### user:\n", "<\\/turn>", "\\\\#", "a\nb: c", "#\\##</turn"])
def test_escape_round_trip(text):
    assert cf.unescape(cf.escape(text)) == text and "###" not in cf.escape(text) and "</turn>" not in cf.escape(text)
    messages = [{"role": "us:er\n#", "content": text}, {"role": "assistant", "content": text}]
    assert cf.read_back(cf.marked_turns(messages)) == [(m["role"], m["content"]) for m in messages]


def test_templates_that_rewrite_history(spark):
    def forgets(messages):
        return "".join(f"[{m['role']}] {m['content'] if i >= len(messages) - 2 else '...'}\n" for i, m in enumerate(messages))

    def closing(messages):
        return "<s>" + "".join(f"{m['role']}: {m['content'].strip()}" + " | " for m in messages)

    rows = [(1, i, "assistant" if i % 2 else "user", f" text {i} ") for i in range(4)] + [(2, 0, "user", "hi"), (2, 1, "assistant", "ho")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in cf.format_conversations(df, forgets).collect()}
    assert out[1]["rewritten_at"] == [2, 3] and out[1]["turns"] is None and out[1]["loss"] == []
    assert out[2]["rewritten_at"] == [] and [tuple(t) for t in out[2]["turns"]] == [("user", 0, 10), ("assistant", 10, 25)]
    assert [out[2]["text"][s["start"] : s["end"]] for s in out[2]["loss"]] == ["ho"]
    changed = {r["conv_id"]: r for r in cf.format_conversations(df, closing).collect()}
    assert [changed[1]["text"][s["start"] : s["end"]] for s in changed[1]["loss"]] == ["text 1", "text 3"]
    assert changed[1]["text"].startswith("<s>") and changed[1]["turns"][0]["start"] == 3


def test_chat_edges(spark):
    rows = [
        (1, 1, "assistant", None), (1, 0, None, "hello"), (1, None, "user", "last"), (1, 1, "assistant", None),
        (None, 0, "user", "nobody"), (2, 0, "assistant", "x" * 200_000),
    ]
    df = spark.createDataFrame([(*r, "id", 9) for r in rows], "conv_id long, turn long, role string, text string, id string, m int")
    out = {r["conv_id"]: r for r in cf.format_conversations(df).collect()}
    assert cf.read_back(out[1]["text"]) == [("", "hello"), ("assistant", ""), ("assistant", ""), ("user", "last")]
    assert out[1]["n_turns"] == 4 and len(out[1]["loss"]) == 2 and out[None]["n_turns"] == 1
    span = out[2]["loss"][0]
    assert out[2]["text"][span["start"] : span["end"]] == "x" * 200_000
    assert cf.format_conversations(df.where("false")).count() == 0


# --- 9 -----------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_permutation(n):
    out = to.permuted(np.arange(n), n, key=5)
    assert sorted(out.tolist()) == list(range(n))
    if n > 50:
        assert out.tolist() != to.permuted(np.arange(n), n, key=6).tolist()


def test_long_texts_encode_alike_in_pieces(monkeypatch):
    with open(to.VOCABULARY, "rb") as f:
        encoding = to.encoder(f.read())
    text = LONG[:40_000] + "  two blanks\n\n and 12 345\tx" + "é" * 50 + "!" * 3000 + LONG[:5000]
    monkeypatch.setattr(to, "PIECE", 100)
    assert np.concatenate(list(to.token_ids(text, encoding, 7, "<u2"))).tolist() == [*encoding.encode_ordinary(text), 7]


def test_shards_are_not_written_twice(spark, edge, tmp_path):
    made, index = to.write_shards(edge.select("doc_id", "text").coalesce(1), folder=str(tmp_path / "out"), sequence=64, shard_sequences=16)
    n = made.sequences
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("shard-*.bin")}
    assert len(before) == -(-n // 16) and sum(p.stat().st_size for p in (tmp_path / "out").glob("shard-*.bin")) == n * made.stride
    to.write_shards(edge.select("doc_id", "text").coalesce(1), folder=str(tmp_path / "out"), sequence=64, shard_sequences=16)
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("shard-*.bin")}
    made, index = to.write_shards(empty(edge))
    assert made.sequences == 0 and index.count() == 0


# --- 10 ----------------------------------------------------------------------


def best(vectors, queries, k):
    out = []
    for q, x in queries:
        scores = sorted((-sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(x, y)), i) for i, y in vectors if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread, dropped", [(0.3, 2), (0.3, 0), (0.01, 2), (40.0, 5)])
def test_top_k_equals_brute_force(spark, monkeypatch, spread, dropped):
    monkeypatch.setattr(topk, "DROPPED_BITS", dropped)
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=12) * spread).astype("f4").tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # one vector very often: ties go by id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 400)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    got = sorted(tuple(x) for x in topk.top_k(df, df.where("vec_id % 50 = 0"), k=5).collect())
    assert got == best(rows, [x for x in rows if x[0] % 50 == 0], 5)


def test_candidates_hold_the_best_and_not_all():
    r = np.random.default_rng(9)
    rows = np.floor(r.normal(size=(5000, 64)) * 32).astype(np.int64)
    block = topk.SlicedBlock(rows)
    for q in np.floor(r.normal(size=(5, 64)) * 32).astype(np.int64):
        at = block.candidates(q.tolist(), 5)
        scores = rows @ q
        assert set(np.argsort(-scores)[:5]) <= set(at.tolist()) and len(at) < 500


def test_top_k_edges(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [3.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]),
        (6, [1.0]), (7, []), (None, [9.0, 9.0]), (8, [1e30, -1e30]), (0, [1.0, 2.0]),
    ]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, id int, cells string")
    out = topk.top_k(df, df.where("vec_id in (0, 6, 7, 8)"), k=2)
    got = sorted(tuple(x) for x in out.collect())
    big = 256 * 256
    assert [g for g in got if g[0] == 0] == [(0, 1, 1, 5 * big), (0, 2, 1, 5 * big)]
    assert not [g for g in got if g[0] in (6, 7)]
    assert [g[:3] for g in got if g[0] == 8] == [(8, 1, 1), (8, 2, 0)] and got[-2][3] == 2**63 - 1 and got[-1][3] == -(2**63)
    assert topk.top_k(df.where("false"), df, k=2).count() == 0 and topk.top_k(df, df.where("false"), k=2).count() == 0


def test_nothing_else_imports_the_subpackage():
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder in ("corpusloom", "catalog"):
        for top, _, names in os.walk(os.path.join(root, folder)):
            for name in names:
                if name.endswith(".py") and os.sep + "llm" not in top:
                    with open(os.path.join(top, name)) as f:
                        assert not re.search(r"(from|import)\s+\S*\bllm\b", f.read()), name


