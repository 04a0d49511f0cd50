"""Tokens, sentences and regular expressions as plain column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

SPACE = r" \t\r\n\f"
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
# Words, single other signs, and runs of white space; a single blank at the very start only.
TOKEN = WORD + rf"|[^{SPACE}\p{{L}}\p{{N}}]|[\t\r\n\f][{SPACE}]*| [{SPACE}]+|\A "
# Up to closing punctuation followed by white space, or to the end of the text: other signs, and punctuation that
# something else follows, are passed over a run at a time.
SENTENCE = rf"(?s).(?:[^.!?]+|[.!?]++(?![{SPACE}]|\z))*+(?:[.!?]+[{SPACE}]*|\z)"


def extract_all(text: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def words(text: Column) -> Column:
    """Lowercased word tokens; an apostrophe inside a word does not split it."""
    return extract_all(F.lower(text), WORD)


def sentences(text: Column) -> Column:
    return extract_all(text, SENTENCE)


def tokens(text: Column) -> Column:
    """Words, punctuation signs and notable white space, in order.

    A single blank only separates tokens; any other white space, and a blank
    at the very start, is a token of its own. Sentences end behind white space,
    so those of a text are those of its sentences one after another.
    """
    return extract_all(text, TOKEN)


def group_count(regex: str) -> int:
    """Number of capturing groups."""
    try:
        return re.compile(regex).groups
    except re.error:
        # A pattern only Java understands: count plain and named groups.
        bare = re.sub(r"\\.|\[[^\]]*\]", "", regex)
        return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


def python_regex(regex: str) -> str:
    """A Python pattern in Java's dialect.

    Python's ``\\w \\d \\s \\b`` know all of Unicode, so does its ignoring of
    case, and only ``\\n`` ends a line; Java needs flags for these. Named groups,
    references to them and ``\\Z`` are spelled differently. What Java lacks is
    refused: conditional groups, ``\\N{name}``, the flags ``a`` and ``L``.
    """
    bare = re.sub(r"\\\\", "  ", regex)
    ignores_case = re.search(r"\(\?[a-zA-Z]*i[a-zA-Z]*[-:)]", bare)
    unknown = re.search(r"\(\?\(|\\N\{|\(\?[a-zA-Z]*[aL][a-zA-Z]*[-:)]", bare)
    if unknown:
        raise ValueError(f"no Java form of {unknown[0]!r} in {regex!r}")
    flags = "d" + ("U" if re.search(r"\\[wWdDsSbB]", bare) else "") + ("u" if ignores_case else "")

    def translated(m: re.Match) -> str:
        if m[0].startswith("\\"):
            return r"\z" if m[0] == r"\Z" else m[0]
        name = (m[1] or m[2]).replace("_", "x5f")  # no Java name has this sign
        return rf"\k<{name}>" if m[1] else f"(?<{name}>"

    # An escaped character is passed over as a whole.
    java = re.sub(r"\\.|\(\?P=(\w+)\)|\(\?P<(\w+)>", translated, regex, flags=re.DOTALL)
    return f"(?{flags})" + java


def find_all(text: Column, regex: str, dialect: str = "python") -> Column:
    """All non-overlapping matches, as ``re.findall`` gives them.

    Without groups the whole matches, with one group its contents, with more
    an array of structs ``g1, g2, …``. Null text gives an empty array.
    """
    groups = group_count(regex)
    java = python_regex(regex) if dialect == "python" else regex
    text = F.coalesce(text.cast("string"), F.lit(""))
    if groups <= 1:
        return extract_all(text, java, groups)
    parts = [extract_all(text, java, g).alias(f"g{g}") for g in range(1, groups + 1)]
    names = [f"g{g}" for g in range(1, groups + 1)]
    zipped = F.arrays_zip(*parts)
    fields = ", ".join(f"{n}: string" for n in names)
    return zipped.cast(f"array<struct<{fields}>>")


def split_clean(text: Column, separator: str) -> Column:
    """Pieces between occurrences of ``separator``, trimmed, empties dropped; null gives none."""
    pieces = F.split(F.coalesce(text.cast("string"), F.lit("")), re.escape(separator))
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")


def highlight(text: Column, terms: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """Mark whole-word occurrences of ``terms``, ignoring case."""
    if not terms:
        return text
    # Longest first, so that a term is not shadowed by one of its prefixes.
    alternatives = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    pattern = rf"(?iu)(^|[^\p{{L}}\p{{N}}])({alternatives})(?![\p{{L}}\p{{N}}])"
    quote = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, pattern, f"$1{quote(before)}$2{quote(after)}")
