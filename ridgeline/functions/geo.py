"""Column expressions for coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import point_name

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance."""
    up, across = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(up) * F.sin(up) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(across) * F.sin(across)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def finite(x: Column) -> Column:
    """Whether a double is a number other than infinity."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def _truthy(value: Column) -> Column:
    """The value as text, or null if it is empty or zero."""
    text = value.cast("string")
    return F.when((text != "") & ~F.coalesce(text.try_cast("double") == 0.0, F.lit(False)), text)


def server_position(lat: list[Column], lng: list[Column]) -> Column:
    """(lat, lng) from aliases in order; 0 and empty count as missing, and both are null if either can't be read."""
    a, b = (F.coalesce(*[_truthy(c) for c in names]).try_cast("double") for names in (lat, lng))
    both = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(both, a).alias("lat"), F.when(both, b).alias("lng"))


def client_position(lat: list[Column], lng: list[Column]) -> Column:
    """(lat, lng) from aliases in order; only null falls through, 0 is a place, and empty text is 0."""
    read = lambda c: F.when(c.cast("string") == "", F.lit(0.0)).otherwise(c.cast("string").try_cast("double"))
    return F.struct(F.coalesce(*[read(c) for c in lat]).alias("lat"), F.coalesce(*[read(c) for c in lng]).alias("lng"))


def list_position(values: Column) -> Column:
    """(lat, lng) from an array of two or more; null if it is shorter or not finite. 0 is a place here."""
    a, b = F.get(values, 0).try_cast("double"), F.get(values, 1).try_cast("double")
    return F.when((F.size(values) >= 2) & finite(a) & finite(b), F.struct(a.alias("lat"), b.alias("lng")))


def named_position(lat: list[Column], lng: list[Column]) -> Column:
    """As server_position, null unless both are finite."""
    p = server_position(lat, lng)
    return F.when(finite(p["lat"]) & finite(p["lng"]), p)


def client_points(rows: DataFrame) -> DataFrame:
    """rows (id, name, label, title, and the aliases of positions) as the client lists them: id, name, lat, lng; without id, name or a finite position a row is dropped."""
    at = client_position([F.col("lat"), F.col("latitude")], [F.col("lng"), F.col("lon"), F.col("longitude")])
    named = rows.select("*", point_name(F.col("name"), F.col("label"), F.col("title"), F.col("id")).alias("_name"), at.alias("_at"))
    kept = named.filter((F.coalesce("id", F.lit("")) != "") & (F.col("_name") != "") & finite(F.col("_at.lat")) & finite(F.col("_at.lng")))
    return kept.select(*[c for c in rows.columns if c in ("ord",)], "id", F.col("_name").alias("name"), "_at.lat", "_at.lng")
