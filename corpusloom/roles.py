"""What each column of a corpus table means."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

ROLE_KEY = "role"

# Role name -> the type a column of that role has in an index.
ROLE_TYPES = {
    "text": "string",
    "timestamp": "timestamp",
    "vec": "array<float>",
    "geopoint": "struct<lat:double,lon:double>",
}

LIST_ROLES = ("text", "tag", "num", "vec", "timestamp", "geopoint")


@dataclass(frozen=True)
class Roles:
    """Column roles, declared by the user and extended by stages.

    Nothing is inferred from a column's type: a string may be a text or a tag,
    and only the user knows which.
    """

    text: tuple[str, ...] = ()
    tag: tuple[str, ...] = ()
    num: tuple[str, ...] = ()
    vec: tuple[str, ...] = ()
    timestamp: tuple[str, ...] = ()
    geopoint: tuple[str, ...] = ()
    id: str | None = None
    date: str | None = None
    suggest: str | None = None
    lang: str = "english"
    #: computed, but left out when rows are written to an index
    transient: tuple[str, ...] = field(default=())

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name in LIST_ROLES + ("transient",):
                value = [value] if isinstance(value, str) else list(value or ())
                object.__setattr__(self, f.name, tuple(dict.fromkeys(value)))

    def extended(self, **added) -> "Roles":
        """These roles plus more columns for the list-valued ones."""
        merged = {k: tuple(getattr(self, k)) + tuple(v) for k, v in added.items()}
        return replace(self, **merged)

    def columns(self) -> list[str]:
        named = [c for role in LIST_ROLES for c in getattr(self, role)]
        named += [c for c in (self.id, self.date, self.suggest) if c]
        return list(dict.fromkeys(named))

    def validate(self, df: DataFrame) -> None:
        missing = [c for c in self.columns() if c not in df.columns]
        if missing:
            raise ValueError(f"roles name columns the table does not have: {missing}")

    def of(self, column: str) -> str | None:
        for role in LIST_ROLES:
            if column in getattr(self, role):
                return role
        return "id" if column == self.id else "date" if column == self.date else None

    def typed(self, df: DataFrame) -> DataFrame:
        """Cast role columns to their index types and note the role in the schema.

        Columns already of the right type are passed through, so filters on
        them still reach the scan.
        """
        out = []
        for f in df.schema.fields:
            role = self.of(f.name)
            col = F.col(f"`{f.name}`")
            if role == "geopoint" and not isinstance(f.dataType, T.StructType):
                col = geo_point(col)
            elif role == "timestamp" and isinstance(f.dataType, T.StringType):
                col = F.try_to_timestamp(col)
            elif role in ROLE_TYPES and f.dataType.simpleString() != ROLE_TYPES[role]:
                col = col.cast(ROLE_TYPES[role])
            out.append(col.alias(f.name, metadata={ROLE_KEY: role}) if role else col)
        return df.select(*out)


def roles_from_schema(schema: T.StructType) -> dict[str, str]:
    """The roles noted by :meth:`Roles.typed`, as column -> role."""
    return {f.name: f.metadata[ROLE_KEY] for f in schema.fields if ROLE_KEY in f.metadata}


def geo_point(point: Column, lon: Column | None = None) -> Column:
    """``"lat,lon"`` text, or two number columns, as a struct; null when not on the globe."""
    if lon is None:
        parts = F.split(point.cast("string"), ",")
        lat = F.trim(F.get(parts, F.lit(0))).try_cast("double")
        lon = F.trim(F.get(parts, F.lit(1))).try_cast("double")
        complete = F.size(parts) == 2
    else:
        lat, lon, complete = point.cast("double"), lon.cast("double"), F.lit(True)
    valid = complete & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(valid, F.struct(lat.alias("lat"), lon.alias("lon")))
