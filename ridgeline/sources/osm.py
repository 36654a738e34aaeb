"""Map extracts to graph: tag filters, ways to segments, one edge a pair, derived measures; points of interest.

osm: (type, id, lat, lon, nodes, tags, ord), the elements of an extract in order, and members where there are relations.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.geometry import centroid, is_ring, meets_box
from ..functions.numbers import ascent, elevation_or_zero, flat_minutes, sac_difficulty, walking_minutes
from ..functions.text import node_name, node_type, osm_id, poi_name, poi_type, waypoint_name
from ..operators.graph import first_edges, used_nodes
from ..operators.nearest import nearest, relinked
from . import schemas
from .documents import read_points, write_json
from .extract import SPLIT_BYTES, read_documents
from .scratch import settled

# Workers get the helper of relations along with its function, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The box of the map (south, west, north, east) and the tags of trails and of points of interest.
BOX = (49.15, 19.70, 49.36, 20.15)
PATHS, WALKS = "path|footway|track|steps|pedestrian", "path|footway|track"
FEATURES = {"natural": ("peak", "saddle", "water"), "tourism": ("alpine_hut", "guest_house", "viewpoint"), "waterway": ("waterfall",)}
#: Kinds under ``natural`` that stay lines when they close.
BARE_LINES = ("coastline", "cliff", "ridge", "arete", "tree_row")


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float] = BOX) -> Column:
    """Whether a position is in the box."""
    return lat.between(box[0], box[2]) & lng.between(box[1], box[3])


def trail_tags(highway: Column, access: Column, scale: Column) -> Column:
    """Open paths, and any way with a hiking grade, whatever its access."""
    return (F.coalesce(highway.rlike(PATHS), F.lit(False)) & ~F.coalesce(access, F.lit("")).rlike("private|no")) | scale.isNotNull()


def walk_tags(highway: Column, foot: Column) -> Column:
    """Paths that are not closed to walkers."""
    return F.coalesce(highway.rlike(WALKS), F.lit(False)) & ~F.coalesce(foot, F.lit("")).rlike("no")


def feature_tags(tags: Column) -> Column:
    """Summits, saddles, waters, huts, viewpoints and falls."""
    out = F.lit(False)
    for key, values in FEATURES.items():
        out = out | F.coalesce(tags[key].isin(*values), F.lit(False))
    return out


def selected(osm: DataFrame, box: tuple[float, float, float, float] = BOX) -> DataFrame:
    """The ways of trails that meet the box, with a node or between two nodes, once each, and all nodes that they go through."""
    tags = F.col("tags")
    ways = osm.filter("type = 'way'").filter(trail_tags(tags["highway"], tags["access"], tags["sac_scale"]))
    nodes = osm.filter("type = 'node'")
    at = _last_nodes(osm).filter("lat is not null and lon is not null").select(F.col("id").alias("node"), "lat", "lon")
    members = ways.select("id", "ord", F.posexplode("nodes").alias("place", "node")).join(at, "node")
    on = Window.partitionBy("id", "ord").orderBy("place")
    here, there = ("lat", "lon"), [F.when(F.lead("place").over(on) == F.col("place") + 1, F.lead(c).over(on)).otherwise(F.col(c)) for c in ("lat", "lon")]
    met = members.select("id", *here, there[0].alias("to_lat"), there[1].alias("to_lon")).filter(meets_box(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"), box))
    ways = ways.join(met.select("id").distinct(), "id", "left_semi")
    first = Window.partitionBy("id").orderBy("ord")
    ways = ways.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*osm.columns)
    through = ways.select(F.explode("nodes").alias("id")).distinct()
    return nodes.join(through, "id", "left_semi").select(*osm.columns).unionByName(ways)


def read_extract(spark: SparkSession, path: str, lines: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The elements of an extract in order, of a file or a folder: JSON documents with a list under ``elements``, or with ``lines`` an element a line.

    ``ord`` is (file, block, place): files by name, whatever their sizes. Documents are split by bytes and read from any
    store that pyarrow opens, lines by Spark's own reader. The elements are kept as a Parquet table, so that they are parsed
    once and filters on type and position reach the scans.
    """
    if lines:
        rows = spark.read.schema(schemas.EXTRACT).json(path)
        # a block lies in one task, which reads it in order
        ord_ = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
        rows = rows.select("*", ord_.alias("ord"))
    else:
        rows = read_documents(spark, path, split_bytes)
    return settled(rows, "extract")


def build_map(spark: SparkSession, extract: str, map_folder: str, points: str | None = None, points_folder: str | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """The map job: read an extract, build the whole map, write nodes and edges, and link the points of a file anew.

    Without ``points`` the last step is left out. Returns the nodes and edges as written.
    """
    nodes, edges = full_map(selected(read_extract(spark, extract, lines)))
    write_json(nodes.orderBy("id").drop("ord"), f"{map_folder}/nodes")
    write_json(edges.orderBy("ord").drop("ord"), f"{map_folder}/edges")
    nodes = spark.read.schema(schemas.NODES).json(f"{map_folder}/nodes")
    if points is not None and points_folder is not None:
        write_json(relinked(read_points(spark, points), nodes.withColumn("ord", F.monotonically_increasing_id())).drop("ord"), points_folder)
    return nodes, spark.read.schema(schemas.BUILT_EDGES).json(f"{map_folder}/edges")


def way_segments(ways: DataFrame) -> DataFrame:
    """(way columns, seg, a, b): consecutive nodes of every way."""
    n = F.greatest(F.size("nodes") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("nodes", 1, n).alias("a"), F.slice("nodes", 2, n).alias("b"))
    return ways.select("*", F.posexplode(pairs).alias("seg", "_x")).select("*", "_x.a", "_x.b").drop("_x")


def _last_nodes(osm: DataFrame) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("ord"))
    return osm.filter("type = 'node'").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _joined_ends(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    at = nodes.select("id", "lat", "lon", elevation_or_zero(F.col("tags")["ele"]).alias("ele"))
    one = segments.join(at.withColumnsRenamed({"id": "a", "lat": "a_lat", "lon": "a_lng", "ele": "a_ele"}), "a")
    return one.join(at.withColumnsRenamed({"id": "b", "lat": "b_lat", "lon": "b_lng", "ele": "b_ele"}), "b")


def full_map(osm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the whole map: segments with unknown ends are skipped, the first way of a pair wins.

    Gain and elevations are 0 here, and time is that of the unrounded distance on the flat; of nodes with one id the last
    counts; only nodes that an edge touches stay.
    """
    nodes = _last_nodes(osm)
    ways = osm.filter("type = 'way'").select(F.col("id").alias("way"), "nodes", "tags", F.col("ord").alias("way_ord"))
    found = _joined_ends(way_segments(ways), nodes)
    found = found.withColumns({"src": osm_id(F.lit("node"), F.col("a")), "dst": osm_id(F.lit("node"), F.col("b"))})
    kept = first_edges(found, "way_ord", "seg").drop("lo", "hi")
    km = haversine_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    edges = kept.select(
        "src", "dst", F.bround(km, 4).alias("distance_km"), flat_minutes(km).alias("time_min"), F.lit(0).alias("elevation_gain_m"), sac_difficulty(F.col("tags")["sac_scale"]).alias("difficulty"),
        osm_id(F.lit("way"), F.col("way")).alias("osm_way_id"), F.coalesce(F.col("tags")["name"], F.lit("")).alias("trail_name"),
        F.array(F.array("a_lat", "a_lng"), F.array("b_lat", "b_lng")).alias("geometry"), F.struct("way_ord", "seg").alias("ord"),
    )
    points = nodes.select(osm_id(F.lit("node"), F.col("id")).alias("id"), waypoint_name(F.col("tags"), F.col("id")).alias("name"), F.lit("waypoint").alias("type"), "lat", F.col("lon").alias("lng"), F.lit(0.0).alias("elevation"), "ord")
    return used_nodes(points, edges), edges


def walk_map(osm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the older map: every segment of a walk, with ascent and walking time, difficulty unknown."""
    nodes, tags = _last_nodes(osm), F.col("tags")
    ways = osm.filter("type = 'way'").filter(walk_tags(tags["highway"], tags["foot"])).select(F.col("id").alias("way"), "nodes", F.col("ord").alias("way_ord"))
    found = _joined_ends(way_segments(ways), nodes)
    metres = haversine_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")) * 1000
    edges = found.select(
        osm_id(F.lit("node"), F.col("a")).alias("src"), osm_id(F.lit("node"), F.col("b")).alias("dst"), F.bround(metres / 1000, 3).alias("distance_km"),
        walking_minutes(metres, F.greatest(F.col("b_ele") - F.col("a_ele"), F.lit(0.0))).alias("time_min"), ascent(F.col("a_ele"), F.col("b_ele")).alias("elevation_gain_m"), F.lit("unknown").alias("difficulty"),
        F.struct("way_ord", "seg").alias("ord"),
    )
    points = nodes.select(osm_id(F.lit("node"), F.col("id")).alias("id"), node_name(tags, F.col("id")).alias("name"), node_type(tags).alias("type"), "lat", F.col("lon").alias("lng"), elevation_or_zero(tags["ele"]).alias("elevation"), "ord")
    return points, edges


def area_tags(tags: Column) -> Column:
    """Whether a closed way of these tags is an area, not a line that ends where it begins."""
    said = tags["area"]
    kinds = (tags["natural"].isNotNull() & ~F.coalesce(tags["natural"].isin(*BARE_LINES), F.lit(False))) | tags["tourism"].isNotNull()
    return F.coalesce(said != "no", F.lit(True)) & (kinds | F.coalesce(said == "yes", F.lit(False)))


def _rings(members: list) -> dict[str, list]:
    """The closed rings that the ways of a relation make up, end to end, by role; what does not close is left out."""
    out: dict[str, list] = {"rings": [], "holes": []}
    for role, name in (("outer", "rings"), ("inner", "holes")):
        parts = [[tuple(p) for p in m["positions"]] for m in sorted(members, key=lambda m: m["place"]) if (m["role"] or "outer") == role and len(m["positions"] or ()) > 1]
        while parts:
            ring = parts.pop(0)
            while ring[0] != ring[-1]:
                k = next((k for k, p in enumerate(parts) if ring[-1] in (p[0], p[-1])), None)
                if k is None:
                    break
                part = parts.pop(k)
                ring += (part if part[0] == ring[-1] else part[::-1])[1:]
            if len(ring) >= 4 and ring[0] == ring[-1]:
                out[name].append(ring)
    return out


def features(osm: DataFrame) -> DataFrame:
    """Nodes, ways and relations of areas with the tags of points of interest: type, id, rings, holes, tags, ord.

    A node is one line of one position, a way one line of the positions that are known, a relation the rings that its outer
    and inner ways make up. What has no position is left out.
    """
    wanted = osm.filter(feature_tags(F.col("tags")))
    position = F.struct("lat", F.col("lon").alias("lng"))
    at = _last_nodes(osm).filter("lat is not null and lon is not null").select(F.col("id").alias("node"), position.alias("p"))
    lines = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("place", "p"))), lambda x: x["p"]).alias(c)
    none = F.array().cast("array<array<struct<lat:double,lng:double>>>")
    points = wanted.filter("type = 'node' and lat is not null and lon is not null").select("type", "id", F.array(F.array(position)).alias("rings"), none.alias("holes"), "tags", "ord")
    ways = wanted.filter("type = 'way'")
    drawn = ways.select("id", "ord", F.posexplode("nodes").alias("place", "node")).join(at, "node").groupBy("id", "ord").agg(lines("line"))
    drawn = ways.select("type", "id", "tags", "ord").join(drawn, ["id", "ord"]).select("type", "id", F.array("line").alias("rings"), none.alias("holes"), "tags", "ord")
    if "members" not in osm.columns:
        return points.unionByName(drawn)
    whole = wanted.filter("type = 'relation'").filter(F.coalesce(F.col("tags")["type"].isin("multipolygon", "boundary"), F.lit(False)))
    parts = whole.select("id", "ord", F.posexplode("members").alias("place", "m")).filter("m.type = 'way'").select("id", "ord", "place", F.col("m.ref").alias("way"), F.col("m.role").alias("role"))
    member_ways = osm.filter("type = 'way'").join(parts.select(F.col("way").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    member_lines = member_ways.select(F.col("id").alias("way"), F.posexplode("nodes").alias("place", "node")).join(at, "node").groupBy("way").agg(lines("positions"))
    made = parts.join(member_lines, "way").groupBy("id", "ord").agg(F.collect_list(F.struct("place", "role", "positions")).alias("members"))
    shape = "array<array<struct<lat:double,lng:double>>>"
    made = made.withColumn("made", F.udf(_rings, f"struct<rings:{shape},holes:{shape}>")("members")).filter("size(made.rings) > 0")
    areas = whole.select("type", "id", "tags", "ord").join(made.select("id", "ord", "made"), ["id", "ord"]).select("type", "id", "made.rings", "made.holes", "tags", "ord")
    return points.unionByName(drawn).unionByName(areas)


def points_of_interest(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """Named features (type, id, rings, holes, tags, ord) with their centroid, nearest node and distance, by name in code point order.

    A column ``positions`` may stand for rings and holes: one line.
    """
    if "rings" not in features.columns:
        features = features.withColumns({"rings": F.array("positions"), "holes": F.array().cast("array<array<struct<lat:double,lng:double>>>")})
    tags = F.col("tags")
    area = (F.col("type") == "relation") | (area_tags(tags) & is_ring(F.col("rings")[0]))
    named = features.filter(feature_tags(tags)).withColumn("_at", centroid(F.col("rings"), F.col("holes"), area)).select(
        osm_id(F.col("type"), F.col("id")).alias("id"), poi_name(tags).alias("name"), poi_type(tags).alias("type"),
        F.bround("_at.lat", 6).alias("lat"), F.bround("_at.lng", 6).alias("lng"), elevation_or_zero(tags["ele"]).alias("elevation"), "ord",
    ).filter("name is not null")
    named = settled(named, "features")
    found = nearest(named, nodes).select("id", F.col("node_id").alias("nearest_routing_node_id"), F.rint(F.col("km") * 1000).cast("long").alias("distance_to_trail_m"))
    return named.join(found, "id", "left").orderBy("name", "ord")
