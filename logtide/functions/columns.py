"""Small Column builders shared by the feature jobs. Everything here stays inside codegen."""

from __future__ import annotations

from functools import reduce
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOC = "geo_location"
EPS = 1e-10


def d(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def clip(col: Column, low: float, high: float) -> Column:
    """Bound a number; NULL stays NULL (greatest/least alone would skip it)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(float(low))), F.lit(float(high))))


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """num/den as double; a zero or NULL denominator gives ``empty``."""
    out = F.try_divide(d(num), d(den))
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))


def positive(den: Column, value: Column, otherwise: float) -> Column:
    """``value`` where ``den`` > 0, else a constant."""
    return F.when(den > 0, value).otherwise(F.lit(float(otherwise)))


def flag(cond: Column) -> Column:
    """1.0 / 0.0 flag; NULL counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def true_only(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def all_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def hour_of(ts: Column) -> Column:
    return F.hour(ts).cast("bigint")


def weekday(ts: Column) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return (F.dayofweek(ts) - 1).cast("bigint")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = (F.pow(F.sin(dlat / 2), F.lit(2.0))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0)))
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def coordinates(geo: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a ``"lat,lon"`` text; NULL where it does not parse."""
    parts = F.split(geo, ",")
    two = F.size(parts) == 2
    return tuple(F.when(two, F.trim(F.get(parts, F.lit(i))).try_cast("double")) for i in (0, 1))


def fill(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Replace NULLs by the per-column default, keeping each column's type."""
    kinds = dict(df.dtypes)
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v).cast(kinds[c]))
        for c, v in defaults.items() if c in kinds
    })


def left_features(locations: DataFrame, features: DataFrame,
                  defaults: dict[str, float]) -> DataFrame:
    """Left join one keyed feature group onto the locations and fill its defaults."""
    return fill(locations.join(features, LOC, "left"), defaults)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round double columns (negative zero becomes zero) and widen integers to bigint."""
    def tidy(c: str, kind: str) -> Column:
        if kind in ("double", "float"):
            return (F.round(F.col(c), special.get(c, digits)) + F.lit(0.0)).alias(c)
        return F.col(c).cast("bigint").alias(c) if kind == "int" else F.col(c)
    return df.select(*[tidy(c, kind) for c, kind in df.dtypes])
