"""Middles of points, lines and areas, and lines against boxes, as expressions; positions are structs of lat and lng, on the plane of degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps_of(positions: Column) -> Column:
    """Consecutive positions (a, b)."""
    n = F.greatest(F.size(positions) - 1, F.lit(0))
    return F.arrays_zip(F.slice(positions, 1, n).alias("a"), F.slice(positions, 2, n).alias("b"))


def is_ring(positions: Column) -> Column:
    """Whether a line closes: four positions at least, the last the first."""
    return (F.size(positions) >= 4) & (positions[0] == F.element_at(positions, -1))


def _summed(rings: Column, step) -> Column:
    """Sums (w, x, y) of ``step`` over the steps of every ring; x and y are those of lng and lat."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def one(ring: Column) -> Column:
        def add(s: Column, p: Column) -> Column:
            w, x, y = step(p["a"], p["b"])
            return F.struct((s["w"] + w).alias("w"), (s["x"] + x).alias("x"), (s["y"] + y).alias("y"))

        return F.aggregate(steps_of(ring), zero, add)

    return F.transform(rings, one)


def _total(sums: Column, signed: bool) -> Column:
    """The sum of (w, x, y) triples; ``signed``: each turned so that its w is not below 0, as rings may run either way."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    turn = (lambda s: F.when(s["w"] < 0, -1.0).otherwise(1.0)) if signed else (lambda s: F.lit(1.0))
    return F.aggregate(sums, zero, lambda t, s: F.struct((t["w"] + turn(s) * s["w"]).alias("w"), (t["x"] + turn(s) * s["x"]).alias("x"), (t["y"] + turn(s) * s["y"]).alias("y")))


def centroid(rings: Column, holes: Column, area: Column) -> Column:
    """The centroid (lat, lng) of lines, or of areas where ``area`` says so: by area without the holes, by length, or the mean.

    ``rings`` and ``holes`` are lists of lists of positions. Areas of size 0 count as their lines, lines of length 0 as
    their points. Sums are taken from the first position, so that small shapes far from zero keep their digits.
    """
    first = rings[0][0]
    x, y = (lambda p: p["lng"] - first["lng"]), (lambda p: p["lat"] - first["lat"])

    def swept(a: Column, b: Column) -> tuple[Column, Column, Column]:
        cross = x(a) * y(b) - x(b) * y(a)
        return cross, (x(a) + x(b)) * cross, (y(a) + y(b)) * cross

    def walked(a: Column, b: Column) -> tuple[Column, Column, Column]:
        size = F.sqrt((x(b) - x(a)) * (x(b) - x(a)) + (y(b) - y(a)) * (y(b) - y(a)))
        return size, (x(a) + x(b)) / 2.0 * size, (y(a) + y(b)) / 2.0 * size

    none = F.array().cast("array<array<struct<lat:double,lng:double>>>")
    points = F.flatten(rings)
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda t, p: t + (p[c] - first[c])) / F.size(points)
    sums = F.struct(_total(_summed(rings, swept), True).alias("outer"), _total(_summed(F.coalesce(holes, none), swept), True).alias("inner"), _total(_summed(rings, walked), False).alias("lines"), area.alias("area"))

    def middle(s: Column) -> Column:
        w, lines = s["outer"]["w"] - s["inner"]["w"], s["lines"]
        at = lambda c, k: first[c] + F.when(s["area"] & (w != 0), (s["outer"][k] - s["inner"][k]) / (3.0 * w)).when(lines["w"] != 0, lines[k] / lines["w"]).otherwise(mean(c))
        return F.struct(at("lat", "y").alias("lat"), at("lng", "x").alias("lng"))

    return F.transform(F.array(sums), middle)[0]  # the sums have a name inside, so they are taken once


def meets_box(a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether the straight line from a to b has a point in the box (south, west, north, east), its rim included.

    The line is clipped by one pair of sides after the other: what is left of it lies between two shares of its length.
    """

    def span(a: Column, b: Column, low: float, high: float) -> tuple[Column, Column, Column]:
        still = a == b
        one, two = (F.lit(low) - a) / F.nullif(b - a, F.lit(0.0)), (F.lit(high) - a) / F.nullif(b - a, F.lit(0.0))
        return F.when(still, 0.0).otherwise(F.least(one, two)), F.when(still, 1.0).otherwise(F.greatest(one, two)), ~still | a.between(low, high)

    lat_in, lat_out, lat_ok = span(a_lat, b_lat, box[0], box[2])
    lng_in, lng_out, lng_ok = span(a_lng, b_lng, box[1], box[3])
    return lat_ok & lng_ok & (F.greatest(F.lit(0.0), lat_in, lng_in) <= F.least(F.lit(1.0), lat_out, lng_out))
