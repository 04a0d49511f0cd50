import pytest

import corpusloom as cl
from conftest import rows_by_id
from corpusloom.operators.html import parse_page, selector_steps, unbox
from corpusloom.sources import tables

PAGES = [
    """<!DOCTYPE html><html><head><title>One &amp; only</title><meta name="k" content="a"><meta name="k" content="b">
    <meta name="date" content="2020"><meta charset="utf-8"></head><body><!-- no --><script>var x = "<b>no</b>";</script>
    <p class="abstract big">First <b>bold <em>deep</em></b></p><ul><li class="author"><a href="/x">Ann</a></li>
    <li class="author"><a>No link</a></li><li id="last"><a href="/y">Bo</a></li></ul><br/></body></html>""",
    "<html><head><title>Two</title></head><body><p class=abstract>Second<h1>Head</h1><b>open</body></html>",
    "",
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(enumerate(PAGES)), "id long, html string").repartition(3)


def test_selectors_and_tags(pages):
    select = {"title": "title", "message": "p.abstract", "author": "li.author a", "direct": "ul > a", "last": "#last a", "both": "h1, em"}
    out = {r["id"]: r for r in cl.parse_html(pages, select=select, keep=["id"], autounbox=False, meta_names="all").collect()}
    one = out[0]
    assert one["title"] == ["One & only"] and one["message"] == ["First bold deep"]
    assert one["author"] == ["Ann", "No link"] and one["direct"] == [] and one["last"] == ["Bo"] and one["both"] == ["deep"]
    assert one["b"] == ["bold deep"] and one["em"] == ["deep"] and one["h2"] == []
    assert one["a"] == ["/x", "/y"]  # a link without target is skipped
    assert "no" not in one["body"].replace("No link", "") and "First bold deep" in one["body"]
    assert one["meta_k"] == ["a", "b"] and one["meta_date"] == ["2020"]
    assert out[1]["b"] == ["open"] and out[1]["meta_k"] is None and out[2]["body"] == ""


def test_unbox_looks_at_the_whole_table(pages):
    out = cl.parse_html(pages, select={"title": "title", "author": "li.author a"}, keep=["id"], meta_names="all")
    kinds = dict(out.dtypes)
    assert kinds["title"] == "string" and kinds["author"] == "array<string>" and kinds["meta_date"] == "string"
    assert kinds["meta_k"] == "array<string>" and kinds["h2"] == "array<string>"  # nothing to unbox
    assert rows_by_id(out, "title") == {0: "One & only", 1: "Two", 2: None}
    assert unbox(out, []) is out


def test_declared_metas_need_no_search(pages):
    out = cl.parse_html(pages, meta_names=["date"], autounbox=False, keep=["id"], meta_names_prefix="m_", tags=[])
    assert out.columns == ["id", "body", "a", "m_date"]
    kept = cl.parse_html(pages, meta_names="map", tags=[], keep=["id"])
    assert kept.where("id = 0").first()["meta"] == {"k": ["a", "b"], "date": ["2020"]} and kept.columns == ["id", "body", "a", "meta"]
    some = cl.parse_html(pages, meta_names=["date", "none"], tags=[], keep=["id"])
    assert dict(some.dtypes)["meta_date"] == "string" and dict(some.dtypes)["meta_none"] == "array<string>"
    assert cl.parse_html(pages, add_meta_names=False, tags=[], autounbox=False).columns == ["body", "a"]


def test_files_and_limit(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.html").write_text(f"<title>t{i}</title>\n<p>x</p>")
    out = cl.parse_html_files(spark, f"{tmp_path}/*.html", select={"title": "title"}, limit=2, tags=[])
    assert sorted(r["title"] for r in out.collect()) == ["t0", "t1"]
    assert out.columns[0] == "path" and out.first()["body"].endswith("x")
    with pytest.raises(ValueError):
        cl.parse_html(cl.html_files(spark, f"{tmp_path}/*.html"), limit=1)


def test_first_files_of_a_glob_are_found_folder_by_folder(spark, tmp_path, monkeypatch):
    for name in ("a/p-1", "a/p-0", "a-b/p-1", "a!/.p", "a!/_p-1", "aa/p-2", "b/q-1", "_c/p-9", "é/p-1", "a/p-1x/in", "a/p-1x/_out"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "a0").write_text("a file")
    for pattern in ("*/*p-*", "a*/p-*", "*/p-?", "[ab]*/*"):
        want = tables._listed(spark, f"{tmp_path}/{pattern}", 100)
        for n in range(1, len(want) + 2):
            assert tables.first_paths(spark, f"{tmp_path}/{pattern}", n) == want[:n], (pattern, n)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.first_paths(spark, f"{tmp_path}/none*/p", 1)

    def whole_listing(*_):
        raise AssertionError("all files were listed")

    monkeypatch.setattr(tables, "_listed", whole_listing)
    assert [x.rsplit("/", 2)[1:] for x in tables.first_paths(spark, f"{tmp_path}/*/p-?", 3)] == [["_c", "p-9"], ["a-b", "p-1"], ["a", "p-0"]]


def test_selector_syntax():
    assert selector_steps("div.a#b > p") == [("div", [("class", "a"), ("id", "b")], False), ("p", [], True)]
    assert selector_steps("a[href][rel='x']")[0][1] == [("href", None), ("rel", "x")]
    for bad in ("", "p:first", "a + b"):
        with pytest.raises(ValueError):
            selector_steps(bad)


def test_void_and_stray_tags():
    page = parse_page("<p>a<br>b</p></div>c<img src=x>d", {"p": [selector_steps("p")], "img": [selector_steps("img")]})
    assert page["p"] == ["ab"] and page["_body"] == "abcd" and page["img"] == [""]


def test_filter_reaches_below_the_parser(pages):
    out = cl.parse_html(pages, autounbox=False, keep=["id"], add_meta_names=False).where("id = 1")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")


def test_meta_names_that_differ_in_case_are_one_column(spark):
    pages = [(1, '<meta name="Keywords" content="a">'), (2, '<meta name="keywords" content="b">'), (3, "<p>none")]
    df = spark.createDataFrame(pages, "id int, html string")
    out = cl.parse_html(df, tags=[], keep=["id"], meta_names="all")
    assert rows_by_id(out, "meta_Keywords") == {1: ["a"], 2: ["b"], 3: None}
    by_default = cl.parse_html(df, tags=[], keep=["id"])
    assert rows_by_id(by_default, "meta") == {1: {"Keywords": ["a"]}, 2: {"keywords": ["b"]}, 3: {}}


def test_query_html_bold_texts(spark):
    """On the test pages an open ``<b>`` reaches to the end of the article."""
    import html
    import re

    import __spark_entry__ as entry_points

    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = entry_points.queries()["html_bold_texts"](spark, sf).collect()
    assert len(out) == len(pages)
    plain = lambda t: html.unescape(re.sub("<[^>]+>", "", t))
    for r in out:
        page = re.sub(r"(?s)<(script|style)\b.*?</\1>", "", pages[r["page_id"]])
        bold = [plain(re.split("</b>|</article>", page[m.end() :])[0]) for m in re.finditer("<b>", page)]
        assert "".join(r["b"].split()) == "".join("|".join(bold).split()), r["page_id"]
        assert r["em"] == ""
