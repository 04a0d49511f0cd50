"""Secret scans: spans of credentials, and of weaker parts that only count beside each other.

Three kinds are reported wherever they match (``assign``, ``access``, ``hex``).
Three weaker kinds are candidates only: ``ident`` (a user or client name),
``opaque`` (a long run of mixed letters and digits) and ``endpoint`` (a
service address). An identifier counts beside a secret, an opaque run beside
an identifier, an endpoint beside both; beside means that the gap between the
two spans, from the end of the earlier to the start of the later, is ``scope``
code points at most, however long they are.

The interval join of the parts is made by range frames over each document's
parts in order of their start: of each role every part sees the furthest end
before it and the first start after it, and no pairs are made. Texts never leave their task; only the places of matches are
shuffled, by document.

Defined results: null text counts as empty; a text without matches has an
empty list; rows alike in id and text are each reported. A weak candidate that
starts inside a span of the first three kinds is not reported again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed

KINDS = ["assign", "access", "hex", "ident", "opaque", "endpoint"]
BASE = 3  # the first three kinds need no company


def either_case(word: str) -> str:
    """ASCII letters in either case, without a flag that engines fold differently."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


def _any(*words: str) -> str:
    return "(?:" + "|".join(either_case(w) for w in words) + ")"


LINKED = r"""["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    "assign": _any("password", "passwd", "secret", "token", "api_?key") + LINKED + "([A-Za-z0-9+/_.=-]+)",
    # Runs below the least length fail as a whole, so the length can stand in the pattern.
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "ident": _any("username", "user", "login", "client_?id", "account") + LINKED + "[A-Za-z0-9._@-]{3,}",
    "opaque": "[A-Za-z0-9+/]{32,}",
    "endpoint": "(?:https?|ftps?|sftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqps?|s3)://[A-Za-z0-9.-]+(?::[0-9]+)?",
}
# A text without any of these (in lower case) has no match of the kind.
HINTS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "ident": ["user", "login", "client", "account"],
    "endpoint": ["://"],
}
ASSIGN_LEAST = 6
OPAQUE_HAS = ["[A-Z]", "[a-z]", "[0-9]"]


def _holds(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, PATTERNS[kind], 1)) >= ASSIGN_LEAST
    if kind == "opaque":
        return F.regexp_like(match, F.lit(OPAQUE_HAS[0])) & F.regexp_like(match, F.lit(OPAQUE_HAS[1])) & F.regexp_like(
            match, F.lit(OPAQUE_HAS[2])
        )
    return F.lit(True)


def _pieces(kind: str) -> Column:
    """Each match with the gap before it, in code points, from left to right; null for a text that cannot have one.

    Splitting and extracting by the same pattern give gaps and matches in step.
    """
    pattern, number = PATTERNS[kind], KINDS.index(kind)
    both = F.zip_with(
        F.split("text", pattern, -1),
        F.regexp_extract_all("text", F.lit(pattern), F.lit(0)),
        lambda gap, match: F.struct(
            F.lit(number).alias("kind"),
            F.length(gap).alias("gap"),
            F.length(match).alias("size"),
            _holds(kind, match).alias("holds"),
        ),
    )
    matched = F.filter(both, lambda x: x["size"].isNotNull())
    numbered = F.transform(matched, lambda x, i: F.struct(x["kind"], i.alias("i"), x["gap"], x["size"], x["holds"]))
    if kind == "access":
        possible = F.col("text").contains("AKIA")
    elif kind in HINTS:
        possible = F.lit(False)
        for hint in HINTS[kind]:
            possible = possible | F.col("low").contains(hint)
    else:
        return numbered
    return F.when(possible, numbered)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """Per document its id and ``spans``: array of (kind, start, end) by start, then kind as in ``KINDS``."""
    base = keyed(docs, id_col, text_col).select(
        "id", "th", F.coalesce("text", F.lit("")).alias("text"), F.lower(F.coalesce("text", F.lit(""))).alias("low")
    )
    document = F.array(
        F.struct(
            F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(True).alias("holds")
        )
    )
    found = [F.coalesce(_pieces(kind), F.slice(document, 1, 0)) for kind in KINDS]
    parts = base.select("id", "th", F.concat(document, *found).alias("parts")).select("id", "th", F.inline("parts"))

    # Places: running sums by document and kind. Rows alike in id and text come as peers, and are divided out.
    near = parts.repartition("id", "th")
    same = Window.partitionBy("id", "th", "kind").orderBy("i")
    peers = F.count(F.lit(1)).over(same.rangeBetween(0, 0))
    total = F.sum(F.col("gap") + F.col("size")).over(same.rangeBetween(Window.unboundedPreceding, 0))
    placed = (
        near.withColumn("copies", peers)
        .withColumn("end", (total / F.col("copies")).cast("long"))
        .withColumn("peer", F.row_number().over(same))
        .withColumn("peer", F.col("peer") % F.col("copies"))
        .where("holds AND peer = 0")
        .withColumn("start", F.col("end") - F.col("size"))
    )

    order = Window.partitionBy("id", "th").orderBy("start")
    before = order.rangeBetween(Window.unboundedPreceding, 0)
    after = order.rangeBetween(0, Window.unboundedFollowing)

    def sees(*kinds: str) -> Column:
        role = F.col("kind").isin([KINDS.index(k) for k in kinds])
        earlier = F.max(F.when(role, F.col("end"))).over(before) >= F.col("start") - scope
        later = F.min(F.when(role, F.col("start"))).over(after) <= F.col("end") + scope
        return F.coalesce(earlier, F.lit(False)) | F.coalesce(later, F.lit(False))

    inside = F.max(F.when(F.col("kind").between(0, BASE - 1), F.col("end"))).over(before)
    linked = placed.select(
        "*",
        sees("access", "ident").alias("by_identifier"),
        sees("assign", "hex", "opaque").alias("by_secret"),
        F.coalesce(inside, F.lit(0)).alias("covered_to"),
    )
    company = (
        F.when(F.col("kind") == KINDS.index("ident"), F.col("by_secret"))
        .when(F.col("kind") == KINDS.index("opaque"), F.col("by_identifier"))
        .when(F.col("kind") == KINDS.index("endpoint"), F.col("by_secret") & F.col("by_identifier"))
    )
    reported = (F.col("kind") < BASE) | (company & (F.col("covered_to") <= F.col("start")))
    span = F.struct("start", "kind", "end")
    per_doc = linked.groupBy("id", "th").agg(
        F.max(F.when(F.col("kind") == -1, F.col("copies"))).alias("copies"),
        F.array_sort(F.collect_list(F.when((F.col("kind") >= 0) & reported, span))).alias("found"),
    )
    name = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(
        "found", lambda x: F.struct(F.get(name, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    )
    once = per_doc.select(F.col("id").alias(id_col), spans.alias("spans"), "copies")
    return once.select(id_col, "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
