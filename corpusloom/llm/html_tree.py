"""A page as a tree of block elements with the runs of text they own. Character references are decoded."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
# Nothing in these is text of the page. What stands in for something that is not shown (noscript, object, canvas, audio,
# video) and formulas are text like any other: the model has to say whether they belong to the article.
UNSEEN = frozenset(
    "script style template head title svg iframe embed applet select option textarea datalist noframes noembed annotation "
    "annotation-xml".split()
)
# A button inside one of these is a word of it; elsewhere it is a control.
WITH_WORDS = frozenset("p li dd dt td th h1 h2 h3 h4 h5 h6 figcaption caption blockquote pre summary".split())
# What may stand in a head; anything else ends it, as both its tags may be left out.
IN_HEAD = frozenset("head title meta link base basefont bgsound script style noscript template noframes".split())
# Of the unseen, those that an enclosing block's end does not end, for all up to their own end is text or apart.
APART = frozenset("head title script style textarea iframe noframes noembed template".split())
# A second start inside one of these opens nothing.
FLAT = frozenset("head title button select option textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Starting one of these ends an open element of the second kind, if no element of the third kind is in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
# Decimal references that Python refuses to read as numbers. Any of eight digits or more means the same.
_LONG_NUMBER = re.compile("&#[0-9]{4000,}")
SCOPES = frozenset("table td th caption button html".split())
# Elements inside each other; what is deeper stands beside its parent, as in browsers.
DEEPEST = 512
# Their content is no markup and never shown.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in "script style textarea title iframe noframes noembed".split()}
_TAG_NAME = re.compile("[a-zA-Z][^\\s/>]*")
_QUOTE_OR_END = re.compile("[\"'>]")
_COMMENT_END = re.compile("--!?>")


def only_markup(html: str) -> str:
    """A page without comments and without the content of ``RAW`` elements, read once from left to right.

    One that is not closed reaches to the end of the page. Behind the last
    ``>`` nothing can be a tag any more, so every ``<`` there is text.
    """
    last = html.rfind(">") + 1
    quotes = {q: html.rfind(q) for q in "\"'"}
    out, kept, at = [], 0, html.find("<")
    while 0 <= at < last:
        if html.startswith("<!--", at):
            out.append(html[kept:at])
            if html.startswith((">", "->"), at + 4):
                kept = html.index(">", at) + 1
            elif end := _COMMENT_END.search(html, at + 4):
                kept = end.end()
            else:
                return "".join(out)
            at = html.find("<", kept)
            continue
        name = _TAG_NAME.match(html, at + 1)
        if name is None:
            at = html.find("<", at + 1)
            continue
        # The end of the tag: a sign that no quotes hold.
        end = name.end()
        while (sign := _QUOTE_OR_END.search(html, end)) and sign[0] != ">":
            # A quote begins a value behind an equals sign only, and only if it ends somewhere.
            is_value = html[end : sign.start()].rstrip().endswith("=") and quotes[sign[0]] > sign.start()
            end = html.index(sign[0], sign.end()) + 1 if is_value else sign.end()
        end = sign.end() if sign else len(html)
        raw = RAW.get(name[0].lower())
        if raw is not None:
            out.append(html[kept:end])
            close = raw.search(html, end)
            if close is None:
                return "".join(out)
            kept = end = close.start()
            end += 2
        at = html.find("<", end)
    tail = html[max(kept, last) :].partition("<!--")[0]
    return "".join([*out, html[kept:last], tail.replace("<", "&lt;")])


@dataclass
class Node:
    tag: str
    names: str  # class, id and role
    parent: int
    depth: int
    hidden: bool = False
    label: str | None = None
    runs: list[int] = field(default_factory=list)


@dataclass
class Page:
    """Nodes, parents first; runs of text in page order as (node, text, characters of it in links)."""

    nodes: list[Node]
    runs: list[tuple[int, str, int]]


class _Builder(HTMLParser):
    def __init__(self, label_attribute: str | None):
        super().__init__(convert_charrefs=True)
        self.label_attribute = label_attribute
        self.nodes = [Node("html", "", -1, 0)]
        self.open = [0]
        self.places: dict[str, list[int]] = {"html": [0]}  # of the open elements, by tag
        self.unseen: list[str] = []
        self.nothing_inner()  # blocks opened inside what is unseen
        self.in_link = False
        self.parts: list[str] = []
        self.linked = 0
        self.done: list[tuple[int, str, int]] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...`` is a comment up to the next ``>``, as in browsers; the parser itself gives up on unknown ones."""
        return self.parse_bogus_comment(i)

    def flush(self) -> None:
        """End the run of text of the element that is open."""
        text = " ".join("".join(self.parts).split())
        if text:
            self.done.append((self.open[-1], text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def close_to(self, position: int) -> None:
        self.flush()
        for node in self.open[position:]:
            self.places[self.nodes[node].tag].pop()
        del self.open[position:]
        self.in_link = False

    def nearest(self, tags, stop) -> int | None:
        """Place of the last open element of ``tags``, if none of ``stop`` is open inside it."""
        last = lambda names: max((self.places[t][-1] for t in names if self.places.get(t)), default=0)
        at = last(tags)
        return at if at > 0 and at >= last(stop) else None

    def left_inner(self, tag: str) -> bool:
        """Whether a block ``tag`` was open inside what is unseen; it and those in it are closed."""
        if not self.inner_counts.get(tag):
            return False
        while True:
            inner = self.inner.pop()
            self.inner_counts[inner] -= 1
            if inner == tag:
                return True

    def nothing_inner(self) -> None:
        self.inner, self.inner_counts = [], {}

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "body":
            self.unseen = []
            self.nothing_inner()
        if self.unseen == ["head"]:
            if tag not in IN_HEAD:
                self.unseen = []
            elif tag in UNSEEN and tag != "head" or tag == "noscript":
                self.unseen.append(tag)
        if self.unseen:
            if tag == self.unseen[-1] and tag not in FLAT and self.unseen[0] != "head":
                self.unseen.append(tag)
            elif tag in BLOCKS and tag not in VOID:
                self.inner.append(tag)
                self.inner_counts[tag] = self.inner_counts.get(tag, 0) + 1
            return
        if tag in UNSEEN or tag == "button" and self.nodes[self.open[-1]].tag not in WITH_WORDS:
            self.flush_word()
            if tag not in VOID:
                self.unseen.append(tag)
            return
        if tag == "a":
            self.in_link = True
        if tag in ("html", "body"):
            self.flush()
            if tag == "body" and len(self.open) > 1:
                return
            if tag == "html":
                return
        if tag not in BLOCKS:
            if tag in VOID:
                self.flush_word()
            return
        at = self.nearest({"p"}, SCOPES)
        if at is not None:
            self.close_to(at)
        if tag in HEADINGS and self.nodes[self.open[-1]].tag in HEADINGS:
            self.close_to(len(self.open) - 1)
        if tag in ENDS:
            at = self.nearest(*ENDS[tag])
            if at is not None:
                self.close_to(at)
        self.flush()
        if tag in VOID:
            return
        given = dict(attrs)
        names = " ".join(filter(None, (given.get("class"), given.get("id"), given.get("role"))))
        style = (given.get("style") or "").replace(" ", "").lower()
        hidden = "hidden" in given or "display:none" in style or given.get("aria-hidden") == "true"
        label = given.get(self.label_attribute) if self.label_attribute else None
        parent = self.open[-1] if self.nodes[self.open[-1]].depth < DEEPEST else self.nodes[self.open[-1]].parent
        self.nodes.append(Node(tag, names, parent, self.nodes[parent].depth + 1, hidden, label))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.nodes) - 1)
        self.in_link = False

    def handle_startendtag(self, tag: str, attrs) -> None:
        # The slash of <div/> means nothing in HTML.
        self.handle_starttag(tag, attrs)
        if tag in UNSEEN and self.unseen[-1:] == [tag] and tag in ("svg", "embed"):
            self.unseen.pop()

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.pop()
                if not self.unseen or self.unseen == ["head"]:
                    self.nothing_inner()
                return
            if tag == "head":
                self.unseen = []
                self.nothing_inner()
                return
            if self.left_inner(tag):
                return
            # The end of a block around them ends unseen elements that were left open. All of them but a head are alike.
            if not APART.isdisjoint(self.unseen[:2]) or tag not in BLOCKS or self.nearest({tag}, ()) is None:
                return
            self.unseen = []
            self.nothing_inner()
        if tag == "a":
            self.in_link = False
        if tag not in BLOCKS or tag in ("html", "body"):
            return
        at = self.nearest({tag} if tag not in HEADINGS else HEADINGS, () if tag not in ("p", "li") else SCOPES)
        if at is not None:
            self.close_to(at)

    def flush_word(self) -> None:
        self.parts.append(" ")

    def handle_data(self, data: str) -> None:
        if self.unseen == ["head"] and data.strip():
            self.unseen = []
        if self.unseen:
            return
        self.parts.append(data)
        if self.in_link:
            self.linked += len(" ".join(data.split()))


def parse_page(html: str | None, label_attribute: str | None = None) -> Page:
    """The tree of a page; null is an empty page. Nothing the parser reports is passed over: no page is cut short."""
    builder = _Builder(label_attribute)
    builder.feed(_LONG_NUMBER.sub(lambda m: "&#" + (m[0][2:].lstrip("0")[:8] or "0"), only_markup(html or "")))
    builder.close()
    builder.flush()
    for k, (node, _, _) in enumerate(builder.done):
        builder.nodes[node].runs.append(k)
    return Page(builder.nodes, builder.done)
