"""Routes put together: points with their ends, polylines, runs without repeats, telling points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import finite
from ..functions.text import is_characteristic
from .graph import edges_between
from .routing import hops_of


def by_last(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """One row for each key: the last in file order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def by_first(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """One row for each key: the first in file order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def without_repeats(rows: DataFrame, group: str, order: str, value: Column) -> DataFrame:
    """Rows whose value differs from that of the row before in their group; a missing value equals a missing one."""
    before = F.lag(F.struct(value.alias("v"))).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("_b", before).withColumn("_v", F.struct(value.alias("v"))).filter("_b is null or not (_b <=> _v)").drop("_b", "_v")


def route_points(routes: DataFrame, ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """(req_id, place, id, name, type, lat, lng, elevation): start point, known nodes of the path, end point; repeats in a row collapse.

    ends: (req_id, last, id, ...), last telling start and end apart. Unknown nodes are dropped; of equal ids the last counts.
    """
    shape = ["id", "name", "type", "lat", "lng", "elevation"]
    path = routes.select("req_id", F.posexplode("path").alias("place", "id"))
    middle = path.join(by_last(nodes, "id").select(*shape), "id").select("req_id", "place", *shape)
    outer = ends.select("req_id", F.when(F.col("last"), 1 << 30).otherwise(-1).alias("place"), *shape)
    rows = without_repeats(middle.unionByName(outer), "req_id", "place", F.col("id"))
    again = F.row_number().over(Window.partitionBy("req_id").orderBy("place")) - 1
    return rows.withColumn("place", again)


def edge_positions(geometry: Column, backwards: Column) -> Column:
    """The positions of an edge in walking order, those that are not finite left out; none for a missing geometry."""
    kept = F.filter(F.coalesce(geometry, F.array().cast("array<array<double>>")), lambda p: (F.size(p) >= 2) & finite(p[0]) & finite(p[1]))
    pairs = F.transform(kept, lambda p: F.struct(p[0].alias("lat"), p[1].alias("lng")))
    return F.when(F.coalesce(backwards, F.lit(False)), F.reverse(pairs)).otherwise(pairs)


def route_positions(routes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(req_id, place, lat, lng): the first node, then each hop's geometry, or the node it leads to where there is none."""
    at = by_last(nodes, "id").select(F.col("id").alias("_id"), F.struct("lat", "lng").alias("_at"))
    first = routes.select("req_id", F.get("path", 0).alias("_id")).join(at, "_id").select("req_id", F.lit(-1).alias("hop"), F.lit(0).alias("k"), "_at")
    hops = edges_between(hops_of(routes), edges).withColumn("_line", edge_positions(F.col("e_geometry"), F.col("backwards")))
    drawn = hops.select("req_id", "hop", F.posexplode("_line").alias("k", "_at"))
    plain = hops.filter(F.size("_line") == 0).join(at, F.col("b") == F.col("_id")).select("req_id", "hop", F.lit(0).alias("k"), "_at")
    rows = first.unionByName(drawn).unionByName(plain).select("req_id", F.struct("hop", "k").alias("place"), "_at.lat", "_at.lng").filter(finite(F.col("lat")) & finite(F.col("lng")))
    kept = without_repeats(rows, "req_id", "place", F.struct("lat", "lng"))
    return kept.select("req_id", (F.row_number().over(Window.partitionBy("req_id").orderBy("place")) - 1).alias("place"), "lat", "lng")


def characteristic_points(rows: DataFrame, group: str = "req_id", order: str = "place") -> DataFrame:
    """The first row of every telling name in its route."""
    w = Window.partitionBy(group, F.trim("name")).orderBy(order)
    return rows.filter(is_characteristic(F.col("name"))).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ends_of(points: Column) -> Column:
    """(first, last) of a sequence; both null if it is empty."""
    return F.struct(F.get(points, 0).alias("first"), F.when(F.size(points) > 0, F.element_at(points, -1)).alias("last"))


def line_or_points(positions: Column, points: Column) -> Column:
    """The drawn line if it has positions, else the route's points; what is not finite is left out."""
    return F.filter(F.when(F.size(positions) > 0, positions).otherwise(points), lambda p: finite(p["lat"]) & finite(p["lng"]))


def path_points(path: DataFrame, points: DataFrame, nodes: DataFrame) -> DataFrame:
    """path (req_id, place, id) with names: from the points of interest, else from the nodes; unknown ids are dropped."""
    a = by_last(points, "id").select("id", F.col("name").alias("_a"))
    b = by_last(nodes, "id").select("id", F.col("name").alias("_b"))
    both = path.join(a, "id", "left").join(b, "id", "left")
    return both.withColumn("name", F.coalesce("_a", "_b")).drop("_a", "_b").filter("name is not null")
