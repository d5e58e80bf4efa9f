"""Logical field mapping of a download log and its registry of presets."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANONICAL = [
    "geo_location", "country", "city", "usr", "accession", "filename", "method", "ts", "year",
]


@dataclass(frozen=True)
class LogSchema:
    """Names of the physical fields plus the thresholds the feature jobs read."""

    location_field: str = "geo_location"
    country_field: str = "country"
    city_field: str | None = "geoip_city_name"
    user_field: str = "user"
    project_field: str | None = "accession"
    method_field: str | None = None
    filename_field: str | None = "filename"
    timestamp_field: str = "timestamp"
    year_field: str | None = "year"
    min_location_downloads: int = 1
    min_year: int = 2020
    working_hours_start: int = 9
    working_hours_end: int = 17
    night_hours_start: int = 22
    night_hours_end: int = 6

    def with_options(self, **changes: Any) -> "LogSchema":
        """Copy with changed fields; every other mapping is kept."""
        return replace(self, **changes)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> "LogSchema":
        return cls(**data)

    def _optional(self, name: str | None, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name else F.lit(None).cast(kind)

    def ts(self) -> Column:
        return F.col(self.timestamp_field).cast("timestamp")

    def year(self) -> Column:
        if self.year_field:
            return F.col(self.year_field).cast("bigint")
        return F.year(self.ts()).cast("bigint")

    def canonical(self, log: DataFrame) -> DataFrame:
        """Project a physical log onto the canonical columns (only those are read from disk)."""
        return log.select(
            F.col(self.location_field).alias("geo_location"),
            F.col(self.country_field).alias("country"),
            self._optional(self.city_field).alias("city"),
            F.col(self.user_field).alias("usr"),
            self._optional(self.project_field).alias("accession"),
            self._optional(self.filename_field).alias("filename"),
            self._optional(self.method_field).alias("method"),
            self.ts().alias("ts"),
            self.year().alias("year"),
        )

    def is_working_hour(self, hour: Column) -> Column:
        return (hour >= self.working_hours_start) & (hour < self.working_hours_end)

    def is_night_hour(self, hour: Column) -> Column:
        """Night band; wraps around midnight when its start is later than its end."""
        after, before = hour >= self.night_hours_start, hour < self.night_hours_end
        if self.night_hours_start <= self.night_hours_end:
            return after & before
        return after | before


_REGISTRY: dict[str, LogSchema] = {}


def register_schema(name: str, schema: LogSchema) -> None:
    _REGISTRY[name] = schema


def get_schema(name: str) -> LogSchema:
    if name not in _REGISTRY:
        raise ValueError(f"unknown schema {name!r}; available: {schema_names()}")
    return _REGISTRY[name]


def schema_names() -> list[str]:
    return sorted(_REGISTRY)


register_schema("default", LogSchema())
# The production archive log: protocol known, year taken from the timestamp.
register_schema("archive", LogSchema(method_field="method", year_field=None))
# Canonical column names, as built by logtide.sources.fixtures.
register_schema(
    "canonical",
    LogSchema(city_field="city", user_field="usr", method_field="method",
              timestamp_field="ts", year_field=None, min_year=1900),
)
