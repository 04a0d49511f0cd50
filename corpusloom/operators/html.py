"""Web pages to table rows.

Each page is parsed once by the standard library's event parser, inside Arrow
batches; everything asked for is picked up in that one pass. Decisions that
concern the whole table (which lists unbox, which meta names exist) are
aggregations over the parsed rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.batches import in_pieces
from ..session import cut_lineage
from ..sources.tables import first_paths, html_files

# Tags whose texts become columns by default.
DEFAULT_TAGS = ["h1", "h2", "h3", "b", "em"]
# Elements that never have content, by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Text inside these is not part of the page's text.
SILENT = frozenset(["script", "style", "template"])

_STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:=[^\]]*)?\])*)$")
_PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]")


def selector_steps(selector: str) -> list[tuple[str, list[tuple], bool]]:
    """``"li.author > a"`` as steps ``(tag, conditions, must be a direct child)``.

    Tags, ``.class``, ``#id``, ``[attribute]``, ``[attribute=value]``, and the
    descendant and child relations are known.
    """
    steps, child = [], False
    for word in selector.replace(">", " > ").split():
        if word == ">":
            child = True
            continue
        m = _STEP.match(word)
        if not m:
            raise ValueError(f"selector not supported: {selector!r}")
        wanted = [
            ("class" if kind == "." else "id", value) if kind else (attr, given or None)
            for kind, value, attr, given in _PART.findall(m.group(2))
        ]
        steps.append(((m.group(1) or "*").lower(), wanted, child))
        child = False
    if not steps:
        raise ValueError("empty selector")
    return steps


def _fits(step: tuple, tag: str, attrs: Mapping[str, str]) -> bool:
    name, wanted, _ = step
    if name not in ("*", tag):
        return False
    for attr, value in wanted:
        have = attrs.get(attr)
        if have is None:
            return False
        if value is not None and (value not in have.split() if attr == "class" else value != have):
            return False
    return True


class _Page(HTMLParser):
    """Collects texts of the selected elements while a page streams by."""

    def __init__(self, selectors: dict[str, list[list[tuple]]]):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.open: list[tuple[str, dict, list]] = []  # tag, attributes, text buffers begun here
        self.buffers: list[list[str]] = []  # buffers of all open selected elements
        self.found: dict[str, list[list[str]]] = {k: [] for k in selectors}
        self.body: list[str] = []
        self.meta: dict[str, list[str]] = {}
        self.links: list[str] = []

    def _matches(self, steps: list[tuple]) -> bool:
        """Does the path of open elements end in these steps?"""
        path = self.open

        def reach(step: int, at: int) -> bool:
            # The element at ``at`` already fits ``step``; look for the steps before it.
            if step == 0:
                return True
            above = range(at - 1, at - 2 if steps[step][2] else -1, -1)
            return any(
                0 <= j and _fits(steps[step - 1], path[j][0], path[j][1]) and reach(step - 1, j) for j in above
            )

        last = len(path) - 1
        return _fits(steps[-1], path[last][0], path[last][1]) and reach(len(steps) - 1, last)

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "meta" and "name" in given and "content" in given:
            self.meta.setdefault(given["name"], []).append(given["content"])
        if tag == "a" and "href" in given:
            self.links.append(given["href"])
        begun: list[list[str]] = []
        self.open.append((tag, given, begun))
        for key, alternatives in self.selectors.items():
            if any(self._matches(steps) for steps in alternatives):
                text: list[str] = []
                begun.append(text)
                self.found[key].append(text)
        self.buffers += begun
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def _close(self):
        begun = self.open.pop()[2]
        if begun:
            del self.buffers[-len(begun) :]

    def handle_endtag(self, tag):
        if tag not in VOID and any(t == tag for t, _, _ in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        inside = self.open[-1][0] if self.open else ""
        if inside not in SILENT:
            self.body.append(data)
            for text in self.buffers:
                text.append(data)
        elif self.buffers and self.open[-1][2]:
            # A script or style that was itself selected keeps its content.
            for text in self.open[-1][2]:
                text.append(data)


def parse_page(html: str, selectors: dict[str, list[list[tuple]]]) -> dict:
    page = _Page(selectors)
    page.feed(html)
    page.close()
    row = {key: ["".join(t) for t in texts] for key, texts in page.found.items()}
    return {**row, "_meta": list(page.meta.items()), "_body": "".join(page.body), "_links": page.links}


def parsed(html: Column, select: Mapping[str, str], tags: Sequence[str]) -> Column:
    """A page as a struct: lists for ``select`` and ``tags``, ``meta``, ``body``, ``a``.

    A batch function rather than a table function, so that filters on other
    columns and column pruning still reach the scan.
    """
    wanted = {**{f"s{i}": css for i, css in enumerate(select.values())}, **{f"t{i}": t for i, t in enumerate(tags)}}
    lists = pa.list_(pa.string())
    kinds = [(k, lists) for k in wanted]
    kinds += [("_meta", pa.map_(pa.string(), lists)), ("_body", pa.string()), ("_links", lists)]
    ddl = [f"{k}:array<string>" for k in wanted]
    ddl += ["_meta:map<string,array<string>>", "_body:string", "_links:array<string>"]
    selectors = {k: [selector_steps(part) for part in css.split(",")] for k, css in wanted.items()}

    def parse_some(pages: pa.Array) -> pa.Array:
        rows = [None if p is None else parse_page(p, selectors) for p in pages.to_pylist()]
        return pa.array(rows, pa.struct(kinds))

    @F.arrow_udf(f"struct<{','.join(ddl)}>")
    def parse_batch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_pieces(batches, parse_some)

    return parse_batch(html)


def parse_html(
    pages: DataFrame,
    html_col: str = "html",
    select: Mapping[str, str] | None = None,
    limit: int | None = None,
    order_by: str | None = None,
    autounbox: bool = True,
    add_meta_names: bool = True,
    meta_names_prefix: str = "meta_",
    meta_names: Sequence[str] | str = "map",
    tags: Sequence[str] = tuple(DEFAULT_TAGS),
    keep: Sequence[str] = (),
) -> DataFrame:
    """A table of pages as a table of texts: one row per page.

    Parameters
    ----------
    pages: any table with the page source in ``html_col``.
    select: ``{column: CSS selector}``; alternatives are separated by commas.
    limit: only the first so many pages by ``order_by``.
    autounbox: list columns of at most one element in every row become plain
        values, as :func:`unbox` does.
    add_meta_names: add the named metas: as one map column ``meta``, or as
        columns ``meta_NAME`` for the ``meta_names`` given, or with
        ``meta_names="all"`` for all that occur (found by a look at the whole
        table). Names that differ only in case are one column, spelled as the
        first of them in order.
    keep: columns of ``pages`` to carry along.
    """
    select = dict(select or {})
    rows = pages
    if limit is not None:
        if order_by is None:
            raise ValueError("limit needs order_by, or the pages would be arbitrary ones")
        rows = rows.orderBy(order_by).limit(limit)
    carried = [F.col(c) for c in keep]
    rows = rows.select(*carried, parsed(F.col(html_col), select, tags).alias("_page"))
    page = F.col("_page")
    columns = [page[f"s{i}"].alias(c) for i, c in enumerate(select)]
    columns += [page["_body"].alias("body")]
    columns += [page[f"t{i}"].alias(t) for i, t in enumerate(tags)]
    columns += [page["_links"].alias("a")]
    if add_meta_names:
        columns.append(page["_meta"].alias("meta"))
    table = rows.select(*carried, *columns)
    lists = [c for c in table.columns if c not in (*keep, "body", "meta")]
    spread_metas = add_meta_names and meta_names != "map"
    names = None if meta_names == "all" else meta_names
    if not autounbox and (not spread_metas or names is not None):
        return _meta_columns(table, _spellings(names), meta_names_prefix) if spread_metas else table
    if table.isStreaming:
        raise ValueError("this looks at the whole table; on a stream name the metas and keep the lists")
    # Pages are parsed once: the look at the table and the result both read the parsed rows.
    table = cut_lineage(table)
    longest = _longest_lists(table, lists, "meta" if spread_metas else None, names)
    spellings: list[list[str]] = []
    if spread_metas:
        spellings = _spellings([n for m, n in longest if m] if names is None else names)
        table = _meta_columns(table, spellings, meta_names_prefix)
    if not autounbox:
        return table
    single = [n for (m, n), size in longest.items() if size == 1 and not m]
    single += [meta_names_prefix + s[0] for s in spellings if sum(longest.get((True, n), 0) for n in s) == 1]
    return _first_elements(table, [c for c in single if c in table.columns])


def _spellings(names: Sequence[str]) -> list[list[str]]:
    """Names that differ only in case, together."""
    groups: dict[str, list[str]] = {}
    for name in sorted(set(names)):
        groups.setdefault(name.lower(), []).append(name)
    return list(groups.values())


def _meta_columns(table: DataFrame, spellings: list[list[str]], prefix: str) -> DataFrame:
    """The map ``meta`` as one list column for each name; null where a page has none."""

    def values(names: list[str]) -> Column:
        each = [F.try_element_at(F.col("meta"), F.lit(n)) for n in names]
        found = F.filter(F.array(*each), lambda x: x.isNotNull())
        return each[0] if len(each) == 1 else F.when(F.size(found) > 0, F.flatten(found))

    return table.withColumns({prefix + names[0]: values(names) for names in spellings}).drop("meta")


def _longest_lists(
    table: DataFrame, lists: Sequence[str], map_col: str | None, keys: Sequence[str] | None = None
) -> dict[tuple[bool, str], int]:
    """Greatest length of each list column and of each (wanted) key of a map of lists."""
    if table.isStreaming:
        raise ValueError("this looks at the whole table; on a stream name the metas and keep the lists")
    item = lambda is_key, name, size: F.struct(is_key.alias("m"), name.alias("n"), size.alias("s"))
    sizes = F.array(*[item(F.lit(False), F.lit(c), F.size(F.col(f"`{c}`"))) for c in lists])
    if map_col:
        wanted = F.map_entries(map_col)
        if keys is not None:
            wanted = F.filter(wanted, lambda e: e["key"].isin(list(keys)))
        of_keys = F.transform(wanted, lambda e: item(F.lit(True), e["key"], F.size(e["value"])))
        sizes = F.concat(sizes, of_keys) if lists else of_keys
    found = table.select(F.explode(sizes).alias("x")).groupBy("x.m", "x.n").agg(F.max("x.s").alias("s"))
    return {(r["m"], r["n"]): r["s"] for r in found.collect()}


def _first_elements(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.get(F.col(f"`{c}`"), F.lit(0)) for c in cols}) if cols else df


def parse_html_files(spark: SparkSession, pattern: str, **options) -> DataFrame:
    """:func:`parse_html` over files; ``path`` is kept as a column.

    ``limit`` takes the first files by path: only their names are looked at
    before, and only these files are read.
    """
    limit = options.pop("limit", None)
    options.pop("order_by", None)
    keep = ("path", *options.pop("keep", ()))
    files = html_files(spark, pattern if limit is None else first_paths(spark, pattern, limit))
    return parse_html(files, html_col="html", keep=keep, **options)


def unbox(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Turn list columns with at most one element in every row into plain columns.

    One aggregation decides for all columns; an empty list becomes null. A
    column that is empty everywhere stays as it is.
    """
    if not cols:
        return df
    longest = _longest_lists(df, cols, None)
    return _first_elements(df, [c for c in cols if longest.get((False, c)) == 1])
