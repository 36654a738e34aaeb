"""Column expressions for numbers: dirty casts, edge weights, walking times, difficulty, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CRITERIA = ("time", "distance", "elevation", "difficulty")
#: Grades of the hiking scale, easiest first; difficulty is the place in this list.
SAC_SCALE = ("hiking", "mountain_hiking", "demanding_mountain_hiking", "alpine_hiking", "demanding_alpine_hiking", "difficult_alpine_hiking")


def as_number(value: Column, default: float = 0.0) -> Column:
    """A loosely typed number: blanks around it and underscores between digits are fine; anything else gives ``default``."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"^\s+|\s+$", ""), r"(?<=\d)_(?=\d)", "")
    return F.coalesce(F.when(~text.rlike(r"(?i)\d\.?[df]$"), text.try_cast("double")), F.lit(float(default)))


def criterion_or_time(criterion: Column) -> Column:
    """The criterion that a request is solved by: time unless it is one of the others."""
    return F.when(criterion.isin(*CRITERIA), criterion).otherwise("time")


def edge_weights() -> dict[str, Column]:
    """The weight of an edge under each criterion; a missing difficulty counts 1 here."""
    km, minutes, gain = (as_number(F.col(c)) for c in ("distance_km", "time_min", "elevation_gain_m"))
    hard = as_number(F.col("difficulty"), 1)
    return {"time": minutes, "distance": km, "elevation": gain + km * 10, "difficulty": hard * 100 + gain + minutes + km * 10}


def sac_difficulty(scale: Column) -> Column:
    """1 to 6 by the hiking scale; unknown or missing grades count 1."""
    place = F.array_position(F.array(*map(F.lit, SAC_SCALE)), scale)
    return F.when(place > 0, place).otherwise(1).cast("int")


def walking_minutes(metres: Column, gain: Column) -> Column:
    """Five km an hour and an hour for each 600 m of ascent, to whole minutes, halves to even."""
    return F.rint((metres / 1000.0 / 5.0 + F.greatest(gain, F.lit(0)) / 600.0) * 60.0).cast("long")


def flat_minutes(km: Column) -> Column:
    """Four km an hour, at least a tenth of a minute."""
    return F.bround(F.greatest(km * 15.0, F.lit(0.1)), 2)


def elevation_or_zero(value: Column) -> Column:
    """An elevation as text; missing or unreadable is 0."""
    return as_number(value, 0.0)


def ascent(start: Column, end: Column) -> Column:
    """Metres up from start to end, in whole metres."""
    return F.rint(F.greatest(end - start, F.lit(0.0))).cast("long")


def whole(value: Column) -> Column:
    """Rounded to an integer, halves to even."""
    return F.rint(value).cast("long")


def height_or_null(value: Column) -> Column:
    """A height in cm; empty is null."""
    return F.nullif(value.cast("string"), F.lit("")).try_cast("int")
