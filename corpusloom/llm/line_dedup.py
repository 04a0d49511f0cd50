"""Line dedup: repeated windows of three lines are removed wherever they occur again.

Each document is cut at ``\\n``; a window is a run of ``window`` lines that are
not blank, taken at every line, so windows overlap. The first occurrence of a
window is the one with the smallest (id, text hash, line); ids that are null
come last. Every later occurrence covers the lines from its first to its last
one, blank lines between them too, and covered lines go.

Two shuffles carry hashes and positions only: counts per window (combined
before the shuffle), then the occurrences against the windows that repeat. The
texts move once, to meet the covered lines. A window that a third of all
documents hold is a hot key of the second shuffle: its occurrences, hashes and
positions only, meet in one task.

Defined results: null text stays null and empty text stays empty; a document
with fewer than ``window`` lines that are not blank is never touched; rows
alike in id and text are one document; a document all of whose lines are
covered has the text ``''``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, unpacked

# Lines are compared without these at their ends; a line of nothing else is blank.
BLANKS = " \t\r"


def window_occurrences(docs: DataFrame, window: int = 3) -> DataFrame:
    """``id, th, k1, k2, start, stop``: one row per window of each keyed document.

    The key has 128 bits: at 10^12 windows 64 would confuse some.
    """
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.struct(
            i.alias("pos"),
            F.btrim(line, F.lit(BLANKS)).alias("line"),
        ),
    )
    full = F.transform(
        F.filter(lines, lambda x: x["line"] != ""),
        lambda x: F.struct(
            x["pos"].alias("pos"),
            F.xxhash64(x["line"]).alias("a"),
            F.xxhash64(F.lit("second"), x["line"]).alias("b"),
        ),
    )
    per_doc = docs.select("id", "th", full.alias("full"))
    at = lambda i, k: F.get("full", i + k)
    starts = F.when(F.size("full") >= window, F.sequence(F.lit(0), F.size("full") - window))
    windows = F.transform(
        starts,
        lambda i: F.struct(
            F.xxhash64(*[at(i, k)["a"] for k in range(window)]).alias("k1"),
            F.xxhash64(*[at(i, k)["b"] for k in range(window)]).alias("k2"),
            at(i, 0)["pos"].alias("start"),
            at(i, window - 1)["pos"].alias("stop"),
        ),
    )
    return per_doc.select("id", "th", F.inline(windows))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out, and ``n_lines_removed`` (int) after the other columns."""
    base = keyed(docs, id_col, text_col)
    found = window_occurrences(base, window)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th", "start")
    repeated = (
        found.groupBy("k1", "k2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("k1", "k2", "first")
    )
    later = found.join(repeated, ["k1", "k2"]).where(place != F.col("first"))
    covered = later.groupBy(F.col("id").alias("c_id"), F.col("th").alias("c_th")).agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence("start", "stop")))).alias("covered")
    )
    met = base.join(covered, base["id"].eqNullSafe(F.col("c_id")) & (base["th"] == F.col("c_th")), "left")
    # A column of its own: inside the lambda below the text would be split again for each line.
    met = met.withColumn("lines", F.when(F.col("covered").isNotNull(), F.split("text", "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    text = F.when(F.col("covered").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    )
    return unpacked(met, **{text_col: text, "n_lines_removed": F.coalesce(F.size("covered"), F.lit(0)).cast("int")})
