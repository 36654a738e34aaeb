"""Nearest trail node of each point, exactly, over cells that hold few nodes each however these are spread.

The box of all nodes is cut into four times four cells, and so is every cell with more nodes than a leaf may hold. Cells
keep the box of their own nodes. A point goes down this tree with all cells that can hold its nearest node: none whose box
is farther than the farthest corner of another's. At the leaves it looks into the one with the nearest box first, then into
those that are nearer than the node found there. Each point so meets a few leaves, with two crowds of nodes far apart as
with one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine_km
from ..functions.text import first_filled
from ..sources.scratch import BROADCAST_BYTES, BROADCAST_ROWS, finished, mark, settled

#: Nodes in a leaf, steps of the grid by halves of each side, halves at a time. Nodes closer together than the box's side by 2 to the 28th share a leaf.
LEAF, DEPTH, STRIDE = 64, 28, 2
#: What a node or a cell takes in a broadcast.
ROW_BYTES = 80
_BOX = ("south", "north", "west", "east")


def _place(c: str, low: float, high: float) -> Column:
    """The finest row or column of a coordinate in the box of all nodes."""
    share = (F.col(c) - F.lit(low)) / F.lit(max(high - low, 1e-12))
    return F.least(F.floor(share * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long")


def _cell(level: int) -> list[Column]:
    return [F.shiftright(c, DEPTH - level).alias(c) for c in ("row", "column")]


def _sized(cells: DataFrame) -> DataFrame:
    return cells.groupBy("row", "column").agg(F.sum("n").alias("n"), F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"))


def cell_tree(known: DataFrame, leaf: int = LEAF) -> tuple[list[tuple[int, DataFrame]], DataFrame, int]:
    """The levels of the tree from the top, as (level, cells), the nodes (node_id, nlat, nlng, ord) with their leaf (level, row, column), and their number."""
    low_lat, high_lat, low_lng, high_lng, n = known.agg(F.min("nlat"), F.max("nlat"), F.min("nlng"), F.max("nlng"), F.count(F.lit(1))).first()
    if not n:
        return [], known, 0
    side = sided(n)
    active = known.withColumns({"row": _place("nlat", low_lat, high_lat), "column": _place("nlng", low_lng, high_lng)})
    level = 0
    while n > leaf << 2 * level >> STRIDE and level + STRIDE <= DEPTH:
        level += STRIDE
    top, levels, leaves = level, [], []
    while True:
        rows = active.select(*_cell(level), F.lit(1).alias("n"), F.col("nlat").alias("south"), F.col("nlat").alias("north"), F.col("nlng").alias("west"), F.col("nlng").alias("east"))
        cells = settled(_sized(rows).withColumn("leaf", (F.col("n") <= leaf) | F.lit(level >= DEPTH)), "cells")
        levels.append((level, cells))
        here = active.withColumns({"fine_row": F.col("row"), "fine_column": F.col("column")}).withColumns({"row": F.shiftright("fine_row", DEPTH - level), "column": F.shiftright("fine_column", DEPTH - level)})
        full = cells.filter("leaf").select("row", "column")
        leaves.append(here.join(side(full), ["row", "column"], "left_semi").select(F.lit(level).alias("level"), "row", "column", "node_id", "nlat", "nlng", "ord"))
        crowded = cells.filter(~F.col("leaf")).select("row", "column")
        if crowded.isEmpty():
            break
        rest = here.join(side(crowded), ["row", "column"], "left_semi").select("node_id", "nlat", "nlng", "ord", F.col("fine_row").alias("row"), F.col("fine_column").alias("column"))
        active, level = settled(rest, "crowded"), min(DEPTH, level + STRIDE)
    for above in range(top - STRIDE, -1, -STRIDE):
        below = levels[0][1].select(*[F.shiftright(c, STRIDE).alias(c) for c in ("row", "column")], "n", *_BOX)
        levels.insert(0, (above, _sized(below).withColumn("leaf", F.lit(False))))
    return levels, reduce(DataFrame.unionByName, leaves), n


def sided(n: int):
    """How tables of nodes or cells are joined, no more of which there are than ``n`` nodes: broadcast if that is few, else shuffled."""
    return F.broadcast if n <= BROADCAST_ROWS and n * ROW_BYTES <= BROADCAST_BYTES else lambda df: df


def box_bounds_km(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Distances below and above that of any position in the box (south, north, west, east) from (lat, lng)."""
    up = F.greatest(F.lit(0.0), F.col("south") - lat, lat - F.col("north"))
    # around the globe, the way to the nearer side
    over = F.pmod(lng - F.col("west"), F.lit(360.0))
    width = F.col("east") - F.col("west")
    side = F.when(over <= width, 0.0).otherwise(F.least(over - width, 360.0 - over))
    across = F.when(side < 90, F.asin(F.least(F.lit(1.0), F.cos(F.radians(lat)) * F.sin(F.radians(side))))).otherwise(F.radians(90 - F.abs(lat)))
    low = EARTH_KM * F.greatest(F.radians(up), across)
    far_up = F.greatest(F.abs(lat - F.col("south")), F.abs(lat - F.col("north")))
    far_side = F.least(F.lit(180.0), F.when(over <= width, F.greatest(over, width - over)).otherwise(side + width))
    widest = F.when((F.col("south") <= 0) & (F.col("north") >= 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs(F.col("south")), F.abs(F.col("north"))))))
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    high = 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), half(far_up) + F.cos(F.radians(lat)) * widest * half(far_side))))
    return F.greatest(F.lit(0.0), low * (1 - 1e-9) - 1e-9), high * (1 + 1e-9) + 1e-9


def candidates(left: DataFrame, levels: list[tuple[int, DataFrame]], key: str, n: int) -> DataFrame:
    """(key, lat, lng, level, row, column, low): the leaves of ``n`` nodes that can hold the nearest one of each point."""
    side, few = sided(n), n <= BROADCAST_ROWS
    steps = F.sequence(F.lit(0).cast("long"), F.lit((1 << STRIDE) - 1).cast("long"))
    if len(levels) == 1:
        now = left.withColumns({"row": F.lit(0).cast("long"), "column": F.lit(0).cast("long")})
    else:  # all cells below the top one, which every point meets
        levels, now = levels[1:], left.withColumn("row", F.explode(steps)).withColumn("column", F.explode(steps))
    held = None
    for at, (level, cells) in enumerate(levels):
        met = now.join(side(cells.select("row", "column", "leaf", *_BOX)), ["row", "column"])
        low, high = box_bounds_km(F.col("lat"), F.col("lng"))
        seen = met.select(key, "lat", "lng", F.lit(level).alias("level"), "row", "column", "leaf", low.alias("low"), high.alias("high"))
        # leaves from above stay in the race
        seen = seen if held is None else seen.unionByName(held)
        kept = seen.withColumn("reach", F.min("high").over(Window.partitionBy(key))).filter("low <= reach").drop("reach")
        if at + 1 == len(levels):
            return kept.select(key, "lat", "lng", "level", "row", "column", "low")
        if not (few and level < 3 * STRIDE):
            kept = settled(kept, "candidates")
        held = kept.filter("leaf")
        deeper = kept.filter(~F.col("leaf")).select(key, "lat", "lng", *[F.shiftleft(c, STRIDE).alias(c) for c in ("row", "column")])
        now = deeper.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).select(key, "lat", "lng", (F.col("row") + F.col("i")).alias("row"), (F.col("column") + F.col("j")).alias("column"))


def nearest(points: DataFrame, nodes: DataFrame, key: str = "id", leaf: int = LEAF) -> DataFrame:
    """(key, node_id, km): the nearest of nodes (id, lat, lng, ord) for every one of points (key, lat, lng).

    Ties go to the node that is first in the file; points and nodes without coordinates are skipped; without nodes node_id
    is null. ``key`` tells the points apart.
    """
    began = mark()
    at = nodes.filter("lat is not null and lng is not null").groupBy(F.col("lat").alias("nlat"), F.col("lng").alias("nlng")).agg(F.min(F.struct("ord", F.col("id").alias("node_id"))).alias("first"))
    known = settled(at.select("first.node_id", "nlat", "nlng", "first.ord"), "nodes")
    left = points.filter("lat is not null and lng is not null").select(key, "lat", "lng")
    levels, leaves, n = cell_tree(known, leaf)
    if not n:
        return left.select(key, F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("double").alias("km"))
    leaves = sided(n)(leaves if len(levels) == 1 or n <= BROADCAST_ROWS else settled(leaves, "leaves"))
    first = Window.partitionBy(key).orderBy("low", "level", "row", "column")
    found = settled(candidates(left, levels, key, n).withColumn("turn", F.row_number().over(first)), "candidates")
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("nlat"), F.col("nlng"))
    best = lambda df: df.join(leaves, ["level", "row", "column"]).groupBy(key).agg(F.min(F.struct(km.alias("km"), "ord", "node_id")).alias("x"))
    one = best(found.filter("turn = 1"))
    near = found.filter("turn > 1").join(one.select(key, F.col("x.km").alias("reach")), key).filter("low <= reach").drop("reach")
    both = one.unionByName(best(near)).groupBy(key).agg(F.min("x").alias("x"))
    return finished(both.select(key, "x.node_id", "x.km"), "nearest", began)


def routing_key(points: DataFrame) -> Column:
    """The trail node that a point names itself, by the aliases that it has columns for."""
    names = ("nearest_routing_node_id", "routing_node_id", "node_id", "nearest_node", "id")
    return first_filled(*[F.col(c) for c in names if c in points.columns])


def resolved(points: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """(key, node_id): the trail node that a point names if there is such a node, else the nearest one.

    Only the points without a valid name go into the search.
    """
    named = points.select(key, "lat", "lng", routing_key(points).alias("_named"))
    ids = nodes.select(F.col("id").cast("string").alias("_known")).distinct()
    valid = named.join(ids, F.col("_named") == F.col("_known"), "left_semi").select(key, F.col("_named").alias("node_id"))
    rest = named.join(ids, F.coalesce("_named", F.lit("")) == F.col("_known"), "left_anti").select(key, "lat", "lng")
    return valid.unionByName(nearest(rest, nodes, key).select(key, "node_id"))


def relinked(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """points with nearest_routing_node_id and distance_to_trail_m set anew for every point that has coordinates."""
    found = nearest(points, nodes).select("id", F.col("node_id").alias("nearest_routing_node_id"), F.rint(F.col("km") * 1000).cast("long").alias("distance_to_trail_m"))
    return points.drop("nearest_routing_node_id", "distance_to_trail_m").join(found, "id", "left")
