"""Dashboard panels: the aggregations one looks at first.

Every panel is a lazy DataFrame. Counts are counts of rows: a value repeated
inside one row counts once, and nulls and NaNs fall in no bucket. All counts
are combined on the map side, so a value holding a large part of the rows is
no heavier than another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from decimal import Decimal
from math import isfinite

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.nulls import without_nan
from ..operators.analysis import Analyzer
from ..operators.search import time_range
from ..roles import Roles

# Size of a panel and interval of a histogram where none is given.
DEFAULT_SIZE = 20
DEFAULT_INTERVAL = 0.1
BINS = 100
FILL_CHUNK = 1 << 16
# Parts in which the keys of a panel compete first, so that no task ranks them all.
RANK_PARTS = 64

# The steps an automatic date histogram chooses from: (seconds, name).
DATE_STEPS = [
    (1, "1 second"),
    (10, "10 seconds"),
    (60, "1 minute"),
    (600, "10 minutes"),
    (3600, "1 hour"),
    (7200, "2 hours"),
    (43200, "12 hours"),
    (86400, "1 day"),
    (604800, "7 days"),
    (None, "month"),
    (None, "year"),
]


# --- ranges ----------------------------------------------------------------


def _number_or_time(df: DataFrame, col: str) -> Column:
    kind = df.schema[col].dataType
    return finite(F.col(f"`{col}`")) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(f"`{col}`")


def finite(number: Column) -> Column:
    """Null for NaN and the infinities: they have no bucket and no place in a range."""
    number = without_nan(number)
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def range_columns(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """The aggregates ``c_min`` and ``c_max`` of each column, NaN and infinities left out."""
    return [
        f(_number_or_time(df, c)).alias(f"{c}_{n}") for c in cols for n, f in (("min", F.min), ("max", F.max))
    ]


def column_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Least and greatest value of every column in one row, from one pass."""
    return df.agg(*range_columns(df, cols))


def ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    row = column_ranges(df, cols).first() if cols else {}
    return {c: (row[f"{c}_min"], row[f"{c}_max"]) for c in cols}


def histogram_interval(lo, hi) -> float:
    """A hundredth of a known range of numbers, else the default."""
    known = all(isinstance(x, (int, float, Decimal)) and isfinite(x) for x in (lo, hi))
    return (float(hi) - float(lo)) / BINS if known and hi > lo else DEFAULT_INTERVAL


def date_step(lo, hi, max_buckets: int = BINS) -> str:
    """The smallest step that covers the range with at most ``max_buckets`` buckets."""
    if lo is None or hi is None:
        return "2 hours"
    lo, hi = _instant(lo), _instant(hi)
    for seconds, name in DATE_STEPS:
        if seconds:
            n = hi // seconds - lo // seconds + 1
        elif name == "month":
            a, b = _utc(lo), _utc(hi)
            n = (b.year - a.year) * 12 + b.month - a.month + 1
        else:
            n = 0
        if n <= max_buckets:
            return name
    return "year"


_EPOCH = datetime(1970, 1, 1)


def _instant(x) -> int:
    if isinstance(x, date) and not isinstance(x, datetime):
        x = datetime(x.year, x.month, x.day)
    return int((x.replace(tzinfo=None) - _EPOCH).total_seconds() // 1)


def _utc(seconds: int) -> datetime:
    return _EPOCH + timedelta(seconds=seconds)


# --- panels ----------------------------------------------------------------


@dataclass(frozen=True)
class Panel:
    """What to show of one column, and the metric of each bucket.

    ``metric`` is ``"count"`` or one of ``avg sum min max
    approx_count_distinct``; the latter need ``metric_col``.
    """

    field: str
    metric: str = field(default="count", kw_only=True)
    metric_col: str | None = field(default=None, kw_only=True)


@dataclass(frozen=True)
class HorizontalBar(Panel):
    size: int = DEFAULT_SIZE


@dataclass(frozen=True)
class TagCloud(Panel):
    size: int = DEFAULT_SIZE


@dataclass(frozen=True)
class Histogram(Panel):
    interval: float | None = None


@dataclass(frozen=True)
class DateHistogram(Panel):
    interval: str = "auto"


METRICS = {
    "avg": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "approx_count_distinct": F.approx_count_distinct,
}


def _metrics(panel: Panel) -> list[Column]:
    out = [F.count("*").alias("n")]
    if panel.metric != "count":
        if panel.metric not in METRICS or panel.metric_col is None:
            raise ValueError(f"metric {panel.metric!r} of {panel.metric_col!r} is not known")
        out.append(METRICS[panel.metric](F.col(panel.metric_col)).alias(panel.metric))
    return out


def _buckets(df: DataFrame, panel: Panel, key: Column, array: bool = False) -> DataFrame:
    """Group rows by a key, or by each distinct element of an array key."""
    extra = [F.col(panel.metric_col)] if panel.metric_col else []
    distinct = F.explode(F.array_distinct(key)) if array else key
    rows = df.select(distinct.alias("key"), *extra).where(F.col("key").isNotNull())
    return rows.groupBy("key").agg(*_metrics(panel))


def terms(df: DataFrame, panel: HorizontalBar) -> DataFrame:
    """The values of a tag column that most rows have."""
    array = isinstance(df.schema[panel.field].dataType, T.ArrayType)
    counted = _buckets(df, panel, F.col(f"`{panel.field}`"), array)
    return counted.orderBy(F.desc("n"), F.asc("key")).limit(panel.size)


def tag_cloud(df: DataFrame, panel: TagCloud, analyzer: Analyzer | None = None, id_col: str | None = None) -> DataFrame:
    """The analyzed terms of a text column that most rows have."""
    analyzer = analyzer or Analyzer()
    with_terms = analyzer.add_terms(df, panel.field, "_terms", id_col)
    counted = _buckets(with_terms, panel, F.col("_terms"), array=True)
    return counted.orderBy(F.desc("n"), F.asc("key")).limit(panel.size)


def histogram(df: DataFrame, panel: Histogram, interval: float | None = None, fill: bool = False) -> DataFrame:
    """Numbers by ``floor(value / interval) * interval``; ``fill`` adds the empty buckets between."""
    step = F.lit(float(panel.interval or interval or DEFAULT_INTERVAL))
    bucket = F.floor(finite(F.col(f"`{panel.field}`").cast("double")) / step)
    counted = _buckets(df, panel, bucket)
    if fill:
        ends = counted.agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        # Two steps, so that no task ever holds one long array of keys.
        starts = ends.select("hi", F.explode(F.sequence("lo", "hi", F.lit(FILL_CHUNK).cast("long"))).alias("at"))
        last = F.least(F.col("at") + FILL_CHUNK - 1, F.col("hi"))
        keys = starts.repartition("at").select(F.explode(F.sequence("at", last)).alias("key"))
        counted = keys.join(counted, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.withColumn("key", F.col("key") * step).orderBy("key")


NTZ_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def without_zone(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.TimestampNTZType)


def seconds_of(ts: Column, no_zone: bool = False) -> Column:
    """Whole seconds since the epoch; those of a clock without a zone do not depend on the session's."""
    if not no_zone:
        return F.unix_seconds(ts.cast("timestamp"))
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def instant_of(seconds: Column, no_zone: bool = False) -> Column:
    if not no_zone:
        return F.timestamp_seconds(seconds)
    return F.expr(NTZ_EPOCH) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def date_bucket(ts: Column, step: str, no_zone: bool = False) -> Column:
    """Start of the step an instant falls in; fixed steps count from the epoch.

    With ``no_zone``, for ``timestamp_ntz`` columns, steps follow the clock
    itself; others follow UTC, and months and years the session's zone.
    """
    if step in ("month", "year"):
        start = F.date_trunc(step, ts)
        return start.cast("timestamp_ntz") if no_zone else start
    seconds = next((s for s, name in DATE_STEPS if name == step), None) or _seconds(step)
    whole = seconds_of(ts, no_zone)
    return instant_of(whole - F.pmod(whole, F.lit(seconds)), no_zone)


def _seconds(step: str) -> int:
    count, unit = step.split()
    size = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    return int(count) * size[unit.rstrip("s")]


def date_histogram(df: DataFrame, panel: DateHistogram, span: tuple | None = None) -> DataFrame:
    """Rows by time step, non-empty buckets only.

    An automatic step depends on the range of the column: pass it as ``span``
    when it is known, or one aggregation finds it.
    """
    step = panel.interval
    if step == "auto":
        lo, hi = span or ranges(df, [panel.field])[panel.field]
        step = date_step(lo, hi)
    key = date_bucket(F.col(f"`{panel.field}`"), step, without_zone(df, panel.field))
    return _buckets(df, panel, key).orderBy("key")


def metric_by(df: DataFrame, field: str, metric: str, metric_col: str) -> DataFrame:
    """A metric per value of a column."""
    return _buckets(df, Panel(field, metric=metric, metric_col=metric_col), F.col(f"`{field}`"))


# --- the default dashboard -------------------------------------------------


def default_panels(roles: Roles) -> dict[str, Panel]:
    """Date column: date histogram; tags: bars; texts: clouds; numbers: histograms."""
    panels: dict[str, Panel] = {}
    if roles.date:
        panels[roles.date] = DateHistogram(roles.date)
    panels.update({c: HorizontalBar(c) for c in roles.tag})
    panels.update({c: TagCloud(c) for c in roles.text})
    panels.update({c: Histogram(c) for c in roles.num})
    return panels


def _all_panels(roles: Roles, extra: Sequence[Panel | str]) -> dict[str, Panel]:
    panels = default_panels(roles)
    for p in extra:
        p = HorizontalBar(p) if isinstance(p, str) else p
        panels[p.field if p.field not in panels else f"{p.field}_{type(p).__name__}"] = p
    return panels


def _ranged(panels: Mapping[str, Panel]) -> list[str]:
    wants = lambda p: isinstance(p, (Histogram, DateHistogram)) and p.interval in (None, "auto")
    return list(dict.fromkeys(p.field for p in panels.values() if wants(p)))


def _known_spans(df: DataFrame, panels: Mapping[str, Panel], spans: Mapping[str, tuple] | None) -> dict[str, tuple]:
    spans = dict(spans or {})
    missing = [c for c in _ranged(panels) if c not in spans]
    return {**spans, **ranges(df, missing)} if missing else spans


def dashboard(
    df: DataFrame,
    roles: Roles,
    spans: Mapping[str, tuple] | None = None,
    extra: Sequence[Panel | str] = (),
    analyzer: Analyzer | None = None,
    time_from=None,
    time_to=None,
) -> dict[str, DataFrame]:
    """One lazy table per panel. A bare column name in ``extra`` means a bar panel.

    Ranges that are needed and not in ``spans`` are found in a single pass.
    ``time_from`` and ``time_to`` keep the rows of a time range of the date
    column; the filter reaches the scan. Use :func:`dashboard_table` to
    evaluate all panels in one pass instead.
    """
    df, spans = _in_time(df, roles, spans, time_from, time_to)
    panels = _all_panels(roles, extra)
    spans = _known_spans(df, panels, spans)
    analyzer = analyzer or Analyzer(roles.lang)
    out = {}
    for name, p in panels.items():
        if isinstance(p, DateHistogram):
            out[name] = date_histogram(df, p, spans.get(p.field))
        elif isinstance(p, TagCloud):
            out[name] = tag_cloud(df, p, analyzer, roles.id)
        elif isinstance(p, Histogram):
            out[name] = histogram(df, p, histogram_interval(*spans.get(p.field, (None, None))))
        else:
            out[name] = terms(df, p)
    return out


def _in_time(df: DataFrame, roles: Roles, spans, time_from, time_to):
    """The rows of a time range; spans of the whole table do not hold for them."""
    if time_from is None and time_to is None:
        return df, spans
    if roles.date is None:
        raise ValueError("a time range needs a date column")
    return time_range(df, roles.date, time_from, time_to), None


def _keyed(panel: str):
    return lambda v: F.struct(F.lit(panel), v.cast("string"), F.lit(None).cast("long"), F.lit(None).cast("double"))


ENTRY = "array<struct<panel:string,key:string,bucket:bigint,raw:double>>"


def _date_step_of(first: Column, last: Column, no_zone: bool) -> Column:
    """:func:`date_step` as an expression of the first and the last second: a place in ``DATE_STEPS``."""
    choice = F
    for k, (seconds, name) in enumerate(DATE_STEPS):
        if seconds:
            steps = F.floor(last / seconds) - F.floor(first / seconds) + 1
        elif name == "month":
            a, b = (instant_of(x, no_zone) for x in (first, last))
            steps = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) + 1
        else:
            steps = F.lit(0)
        choice = choice.when(steps <= BINS, k)
    return choice


def _in_date_step(seconds: Column, step: Column, no_zone: bool) -> Column:
    """The second in which the step begins that holds a second."""
    instant, out = instant_of(seconds, no_zone), F
    for k, (size, name) in enumerate(DATE_STEPS):
        start = seconds - F.pmod(seconds, F.lit(size)) if size else seconds_of(date_bucket(instant, name, no_zone), no_zone)
        out = out.when(step == k, start)
    return out


def _folded(counts: DataFrame, numbers: list[str], dates: dict[str, bool]) -> DataFrame:
    """Counts by single value, of panels whose range is not known, as counts by bucket; with ``width``.

    The ranges come from the counts themselves. All rows pass through both
    branches and ``n`` is used in both, so the plan below them is the same and
    runs once: its exchange is read twice.
    """
    of = lambda names, c: F.when(F.col("panel").isin(list(names)), F.col(c))
    ends = counts.groupBy(F.col("panel").alias("p")).agg(
        F.min(of(numbers, "raw")).alias("lo"), F.max(of(numbers, "raw")).alias("hi"),
        F.min(of(dates, "bucket")).alias("first"), F.max(of(dates, "bucket")).alias("last"), F.sum("n").alias("rows"),
    )
    lo, hi, first, last = (F.col(c) for c in ("lo", "hi", "first", "last"))
    width = F.when(lo.isNotNull(), F.when(hi > lo, (hi - lo) / BINS).otherwise(DEFAULT_INTERVAL))
    step = F.lit(None).cast("int")
    for name, no_zone in dates.items():
        step = F.when(F.col("p") == name, _date_step_of(first, last, no_zone)).otherwise(step)
    # As many rows as panels.
    ends = F.broadcast(ends.where("rows > 0").select("p", width.alias("width"), step.alias("step")))
    bucket = F.when(F.col("raw").isNotNull(), F.floor(F.col("raw") / F.col("width"))).otherwise(F.col("bucket"))
    for name, no_zone in dates.items():
        bucket = F.when(F.col("panel") == name, _in_date_step(F.col("bucket"), F.col("step"), no_zone)).otherwise(bucket)
    placed = counts.join(ends, F.col("panel") == F.col("p")).select("panel", "key", bucket.alias("bucket"), "width", "n")
    return placed.groupBy("panel", "key", "bucket", "width").agg(F.sum("n").alias("n"))


def dashboard_table(
    df: DataFrame,
    roles: Roles,
    spans: Mapping[str, tuple] | None = None,
    extra: Sequence[Panel | str] = (),
    analyzer: Analyzer | None = None,
    time_from=None,
    time_to=None,
) -> DataFrame:
    """All count panels from a single scan, lazily; only counts are shuffled.

    A histogram whose step depends on a range that ``spans`` does not have is
    counted by single value first; the range and the buckets come from these
    counts, not from another look at the rows.

    Columns ``panel``, ``key`` (bars and clouds), ``value`` (start of a number
    bucket), ``ts`` (start of a time bucket) and ``n``. Panels with another
    metric than the count have no place here: :func:`dashboard` has them.
    """
    df, spans = _in_time(df, roles, spans, time_from, time_to)
    panels = _all_panels(roles, extra)
    other = [name for name, p in panels.items() if p.metric != "count"]
    if other:
        raise ValueError(f"only counts fit in one table; use dashboard() for {other}")
    spans = dict(spans or {})
    open_fields = {c for c in _ranged(panels) if c not in spans}
    open_numbers, open_dates = [], {}
    analyzer = analyzer or Analyzer(roles.lang)
    entries, steps, clocks, sizes, zones = [], {}, [], {}, set()
    fields = [p.field for p in panels.values()]
    df = df.select(*dict.fromkeys([*fields, *([roles.id] if roles.id else [])]))
    for i, (name, p) in enumerate(panels.items()):
        none = lambda kind: F.lit(None).cast(kind)
        col = F.col(f"`{p.field}`")
        if isinstance(p, (HorizontalBar, TagCloud)):
            sizes[name] = p.size
            if isinstance(p, TagCloud):
                df = analyzer.add_terms(df, p.field, f"_terms_{i}", roles.id)
                values = F.col(f"_terms_{i}")
            else:
                is_array = isinstance(df.schema[p.field].dataType, T.ArrayType)
                values = col if is_array else F.array(col.cast("string"))
            present = F.filter(F.array_distinct(values), lambda v: v.isNotNull())
            entry = F.transform(present, _keyed(name))
        else:
            by_range = p.field in open_fields and p.interval in (None, "auto")
            bucket, raw = none("long"), none("double")
            if isinstance(p, DateHistogram):
                clocks.append(name)
                no_zone = without_zone(df, p.field)
                zones.add(no_zone)
                if by_range:
                    open_dates[name] = no_zone
                    bucket = seconds_of(col, no_zone)
                else:
                    step = date_step(*spans[p.field]) if p.interval == "auto" else p.interval
                    bucket = seconds_of(date_bucket(col, step, no_zone), no_zone)
            elif by_range:
                open_numbers.append(name)
                raw = finite(col.cast("double"))
            else:
                steps[name] = float(p.interval or histogram_interval(*spans[p.field]))
                bucket = F.floor(finite(col.cast("double")) / F.lit(steps[name]))
            one = F.array(F.struct(F.lit(name), none("string"), bucket.cast("long"), raw))
            entry = F.when(F.coalesce(bucket.cast("double"), raw).isNotNull(), one)
        entries.append(F.coalesce(entry.cast(ENTRY), F.array().cast(ENTRY)))
    counts = (
        df.select(F.explode(F.concat(*entries)).alias("e"))
        .groupBy("e.panel", "e.key", "e.bucket", "e.raw")
        .agg(F.count("*").alias("n"))
    )
    if open_numbers or open_dates:
        counts = _folded(counts, open_numbers, open_dates)
    else:
        counts = counts.drop("raw").withColumn("width", F.lit(None).cast("double"))
    # A bar panel's keys compete with each other; each histogram bucket stands alone.
    # They do so in parts first, whatever the size of the panel.
    order = [F.desc("n"), "key"]
    largest = max(sizes.values(), default=1)
    counts = counts.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(RANK_PARTS)))
    first = F.row_number().over(Window.partitionBy("panel", "bucket", "part").orderBy(*order))
    counts = counts.withColumn("rank", first).where(F.col("rank") <= largest)
    rank = F.row_number().over(Window.partitionBy("panel", "bucket").orderBy(*order))
    limit, width = F.lit(1), F.col("width")
    for name, size in sizes.items():
        limit = F.when(F.col("panel") == name, size).otherwise(limit)
    for name, step in steps.items():
        width = F.when(F.col("panel") == name, step).otherwise(width)
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= largest).where(F.col("rank") <= limit)
    return kept.select(
        "panel",
        "key",
        (F.col("bucket") * width).alias("value"),
        F.when(F.col("panel").isin(clocks), instant_of(F.col("bucket"), zones == {True})).alias("ts"),
        "n",
    )
