"""Labelled pages to train on: made from parts by a seed, so their number is the documented bound of the sample.

Every element of ``data-label="1"`` is article text, of ``data-label="0"`` none;
what has no label takes it from the element around it.
"""

from __future__ import annotations

import random
import re

PAGES = 360
SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi wo zu an el in or ust ent ing".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _phrase(r: random.Random, lo: int, hi: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(lo, hi)))


def _sentences(r: random.Random, n: int) -> str:
    if r.random() < 0.08:  # lines that shout or are full of signs are article text as well
        mark = r.choice(["!!", "***", "###", "%%%"])
        return " ".join(_word(r).upper() + mark for _ in range(8 * n))
    return " ".join(_phrase(r, 2, 18).capitalize() + r.choice(".....!?") for _ in range(n))


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{_word(r)}">{_phrase(r, 1, 3)}</a></li>' for _ in range(n))


def _attribute(r: random.Random, names: list[str]) -> str:
    name = r.choice(names)
    if r.random() < 0.3:
        name = r.choice(["l-", "site-", "c-", "js-", "block-"]) + name
    return f' {r.choice(["class", "id", "class"])}="{name}"' if name else ""


def _article(r: random.Random) -> list[str]:
    parts = []
    if r.random() < 0.75:
        parts.append(f"<h1>{_phrase(r, 2, 12)}</h1>")
    for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9])):
        kind = r.random()
        text = _sentences(r, r.randint(1, 7))
        if kind < 0.55:
            parts.append(f"<p>{text}</p>")
        elif kind < 0.62:
            parts.append(f"<p><b>{text}<br><p>{_sentences(r, 2)}</p>")
        elif kind < 0.68:
            parts.append(f'<h{(k := r.randint(2, 4))}>{_phrase(r, 1, 7)}</h{k}><p>{text}</p>')
        elif kind < 0.74:
            tag = r.choice(["ul", "ol"])
            parts.append(f"<{tag}>" + "".join(f"<li>{_sentences(r, 1)}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>")
        elif kind < 0.80:
            parts.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind < 0.85:
            cells = "".join(f"<tr><td>{_phrase(r, 1, 3)}</td><td>{_phrase(r, 1, 4)}</td></tr>" for _ in range(3))
            parts.append(f"<table>{cells}</table>")
        elif kind < 0.89:
            parts.append(f"<figure><img src=x><figcaption>{_phrase(r, 3, 10)}</figcaption></figure>")
        elif kind < 0.94:
            parts.append(f'<p>{text} <a href="/x">{_phrase(r, 1, 4)}</a> {_sentences(r, 1)}</p>')
        else:
            parts.append(f"<pre>{text}</pre>")
        if r.random() < 0.12:
            parts.append(r.choice([_advert, _share, _side, _notice])(r))
    if r.random() < 0.1:
        parts.append(_comments(r))
    if not any("<p>" in part for part in parts[:2]):
        parts.append(f"<p>{_phrase(r, 1, 6)}.</p>")
    return parts


def _menu(r: random.Random) -> str:
    tag = r.choice(["nav", "nav", "div", "div", "ul"])
    inner = _links(r, r.randint(3, 9))
    if tag != "ul":
        inner = f"<ul>{inner}</ul>"
    return f'<{tag}{_attribute(r, ["menu", "nav", "navbar", "main-nav", "breadcrumb", "topnav", "tabs", ""])} data-label="0">{inner}</{tag}>'


def _header(r: random.Random) -> str:
    tag = r.choice(["header", "header", "div"])
    names = ["header", "masthead", "site-header", "topbar", "branding", "logo"]
    return f'<{tag}{_attribute(r, names)} data-label="0"><h2>{_phrase(r, 1, 3)}</h2><p>{_sentences(r, 1)}</p></{tag}>'


def _footer(r: random.Random) -> str:
    tag = r.choice(["footer", "footer", "div"])
    text = f"&copy; {_word(r)}.example &middot; {_sentences(r, r.randint(1, 3))}"
    more = f"<ul>{_links(r, 3)}</ul>" if r.random() < 0.4 else ""
    return f'<{tag}{_attribute(r, ["footer", "foot", "site-footer", "copyright", "legal", "colophon"])} data-label="0">{text}{more}</{tag}>'


def _side(r: random.Random) -> str:
    tag = r.choice(["aside", "aside", "div", "section"])
    names = ["sidebar", "widget", "related", "recommended", "rail", "secondary", "more-stories", "popular", "trending"]
    inner = r.choice([f"<h3>{_phrase(r, 1, 3)}</h3><ul>{_links(r, 5)}</ul>", f"<p>{_sentences(r, 2)}</p>", _sentences(r, 3)])
    return f'<{tag}{_attribute(r, names)} data-label="0">{inner}</{tag}>'


def _advert(r: random.Random) -> str:
    names = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "adbox", "sponsor"]
    inner = r.choice([_sentences(r, 1), _sentences(r, 3), f'<a href="/x">{_phrase(r, 3, 8)}</a>', f"<p>{_sentences(r, 2)}</p>"])
    return f'<div{_attribute(r, names)} data-label="0">{inner}</div>'


def _share(r: random.Random) -> str:
    return f'<div{_attribute(r, ["share", "social", "sharing", "follow-us", "social-links"])} data-label="0"><ul>{_links(r, 3)}</ul></div>'


def _notice(r: random.Random) -> str:
    names = ["cookie", "cookie-banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "paywall"]
    tag = r.choice(["div", "section", "dialog", "div", "p"])
    inner = _sentences(r, r.randint(1, 4))
    return f'<{tag}{_attribute(r, names)} data-label="0">{inner if tag == "p" else r.choice([inner, f"<p>{inner}</p>"])}</{tag}>'


def _form(r: random.Random) -> str:
    names = ["search", "login", "signup", "contact-form", "register", ""]
    return f'<form{_attribute(r, names)} data-label="0"><label>{_phrase(r, 1, 4)}</label><input><p>{_phrase(r, 3, 12)}.</p></form>'


def _comments(r: random.Random) -> str:
    item = r.choice(["li", "div", "article"])
    one = "".join(
        f'<{item}{_attribute(r, ["comment", "comment-body", "reply"])}><h4>{_word(r)}</h4><p>{_sentences(r, r.randint(1, 5))}</p></{item}>'
        for _ in range(r.randint(1, 5))
    )
    tag = r.choice(["section", "div"])
    names = ["comments", "disqus_thread", "comment-list", "discussion", "respond", "replies"]
    return f'<{tag}{_attribute(r, names)} data-label="0"><h3>{_phrase(r, 1, 3)}</h3>{one}</{tag}>'


def _page(r: random.Random) -> str:
    body = f'<{(t := r.choice(["article", "article", "main", "div", "div", "section", "td", "none"]))}'
    parts = _article(r)
    text = "".join(parts)
    names = ["content", "post", "entry-content", "article-body", "story", "main", "text", "page-content", "post-body"]
    if t == "none":
        # No element of its own: paragraphs beside the rest.
        marked = lambda part: re.sub(r"<(p|h\d|ul|ol|blockquote|table|figure|pre)>", r'<\1 data-label="1">', part)
        article = "".join(part if "data-label" in part else marked(part) for part in parts)
    else:
        given = _attribute(r, names) if t in ("div", "section", "td") or r.random() < 0.4 else ""
        article = f'{body}{given} data-label="1">{text}</{t}>'
        if t == "td":
            article = f"<table><tr>{article}<td data-label=\"0\">{_side(r)}</td></tr></table>"
    comments = _comments(r) if r.random() < 0.4 else ""
    before = [f(r) for f in (_menu, _header, _advert, _notice, _form) if r.random() < 0.55]
    after = [f(r) for f in (_side, _advert, _share, _notice, _menu) if r.random() < 0.4]
    r.shuffle(before)
    r.shuffle(after)
    middle = article + comments if r.random() < 0.5 else article
    rest = "" if middle != article else comments
    inner = "".join(before) + middle + rest + "".join(after) + (_footer(r) if r.random() < 0.85 else "")
    if r.random() < 0.4:
        inner = f'<div{_attribute(r, ["wrapper", "page", "container", "site", "outer", ""])}>{inner}</div>'
    if r.random() < 0.05:
        inner = f"<form>{inner}</form>"
    return f'<html><head><title>{_phrase(r, 2, 5)}</title></head><body data-label="0">{inner}</body></html>'


def labelled_pages(count: int = PAGES, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    return [_page(r) for _ in range(count)]
