"""A pipeline: declared roles, a chain of stages, an index to write to."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.stages import Stage, TableStage
from ..operators.vectors import vector_dims
from ..roles import Roles
from ..session import shared_folder
from ..sources.index import Index, prepared
from ..sources.tables import dealt
from . import panels as pn


class Pipeline:
    """Enrich a table of texts, write it, and summarise it.

    >>> p = Pipeline("news", text_cols=["message"], tag_cols=["newsgroup"])
    >>> p += RegexTag(r"doi:[^ ]+", ["message"], "doi")
    >>> p += LexiconSentiment("message", "sentiment")
    >>> enriched = p.process(news, write=True, if_index_exists="overwrite")
    >>> panels = p.dashboard()

    Stages are declared, not run: ``transform`` composes one lazy plan.
    Indexes live below ``root``, by default in the shared folder of the session.
    """

    def __init__(
        self,
        index: str,
        text_cols: Sequence[str] | None = None,
        tag_cols: Sequence[str] | None = None,
        num_cols: Sequence[str] | None = None,
        vec_cols: Sequence[str] | None = None,
        timestamp_cols: Sequence[str] | None = None,
        geopoint_cols: Sequence[str] | None = None,
        id_col: str | None = None,
        date_col: str | None = None,
        suggests: str | None = None,
        lang: str = "english",
        root: str | None = None,
        format: str = "parquet",
        partition_by: Sequence[str] = (),
        buckets: int = 0,
    ):
        self.index_name = index
        self.declared = Roles(
            text=tuple(text_cols or ()),
            tag=tuple(tag_cols or ()),
            num=tuple(num_cols or ()),
            vec=tuple(vec_cols or ()),
            timestamp=tuple(timestamp_cols or ()),
            geopoint=tuple(geopoint_cols or ()),
            id=id_col,
            date=date_col,
            suggest=suggests,
            lang=lang,
        )
        self.stages: list[Stage] = []
        self.root = root
        self.format = format
        self.partition_by = tuple(partition_by)
        self.buckets = buckets
        #: ``{column: (min, max)}`` of the index, ``{column: dims}`` and row count of the last write
        self.spans: dict[str, tuple] = {}
        self.dims: dict[str, int] = {}
        self.rows_written: int | None = None

    # -- building

    def add(self, stage: Stage | Callable[[DataFrame], DataFrame]) -> "Pipeline":
        self.stages.append(stage if isinstance(stage, Stage) else TableStage(stage))
        return self

    def __iadd__(self, stage):
        return self.add(stage)

    @property
    def roles(self) -> Roles:
        """Declared roles and those of the stages' outputs."""
        return reduce(lambda r, s: r.extended(**s.output_roles()), self.stages, self.declared)

    def index(self, spark: SparkSession) -> Index:
        root = self.root or shared_folder(spark) + "/indexes"
        return Index(spark, root, self.index_name, self.format, self.buckets)

    # -- running

    def transform(self, df: DataFrame) -> DataFrame:
        """The enriched table, lazily; batch or streaming."""
        self.declared.validate(df)
        roles = self.roles
        return reduce(lambda d, s: s.transform(d, roles), self.stages, df)

    def process(
        self,
        df: DataFrame,
        write: bool = False,
        if_index_exists: str | None = "error",
        return_processed: bool = True,
        partitions: int | None = None,
    ) -> DataFrame | None:
        """Run all stages; with ``write`` also store the rows in the index.

        With ``partitions`` the rows are dealt over so many tasks before the
        first stage, which a table of few large pieces may need.

        Writing is one job. Row count and column ranges are observed while the
        rows pass by and kept beside them, so the dashboard needs no further
        look at them, after an append either; where rows were replaced, ranges
        are found when they are needed.
        With ``if_index_exists="upsert"`` rows replace those of the same id.
        """
        enriched = self.transform(dealt(df, partitions))
        if write:
            index = self.index(df.sparkSession)
            if (if_index_exists or "").lower() != "upsert":
                index.check(if_index_exists)
            if self.roles.vec:
                self.dims = vector_dims(enriched, *self.roles.vec)
            self._write(index, enriched, if_index_exists)
        return enriched if return_processed else None

    def _ranged(self) -> list[str]:
        roles = self.roles
        return list(dict.fromkeys([*roles.num, *([roles.date] if roles.date else [])]))

    def _write(self, index: Index, enriched: DataFrame, if_exists: str | None) -> None:
        seen = Observation(f"write {self.index_name}")
        cols = self._ranged()
        rows = prepared(enriched, self.roles)
        watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *pn.range_columns(rows, cols))
        if (if_exists or "error").lower() == "upsert":
            if self.roles.id is None:
                raise ValueError("to replace rows by id, declare id_col")
            index.upsert(watched, self.roles, self.partition_by)
        else:
            index.write(watched, self.roles, if_exists, self.partition_by, spans=lambda: seen.get)
        self.rows_written = seen.get["rows"]
        self.spans = index.spans(cols)

    # -- looking at the result

    def ranges(self, df: DataFrame) -> dict[str, tuple]:
        """Ranges of the number columns and the date column."""
        return pn.ranges(df, self._ranged())

    def dashboard(
        self, df: DataFrame | None = None, extra: Sequence = (), analyzer=None, time_from=None, time_to=None
    ) -> dict[str, DataFrame]:
        """The default panels, over ``df`` or, without it, over the written index; of a time range, if one is given."""
        df, spans = self._source(df)
        return pn.dashboard(df, self.roles, spans, extra, analyzer, time_from, time_to)

    def dashboard_table(
        self, df: DataFrame | None = None, extra: Sequence = (), analyzer=None, time_from=None, time_to=None
    ) -> DataFrame:
        """All panels in one table from one pass."""
        df, spans = self._source(df)
        return pn.dashboard_table(df, self.roles, spans, extra, analyzer, time_from, time_to)

    def _source(self, df: DataFrame | None):
        if df is not None:
            return self.roles.typed(df), None
        index = self.index(SparkSession.getActiveSession())
        return index.read(), index.spans(self._ranged())
