"""The registered queries of the trail operators, over tables derived from the star schema."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, numbers, text
from ..operators import assembly, checks, graph, nearest, routing, search, store
from ..sources import documents, osm
from ..sources.scratch import scratch_path, settled


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lat(key: Column) -> Column:
    return F.lit(49.15) + (key * 37 % 1000) * 0.00021


def _lng(key: Column) -> Column:
    return F.lit(19.70) + (key * 91 % 1000) * 0.00045


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), key).alias("id"), F.col("n_name").alias("name"), F.lit("waypoint").alias("type"), _lat(key).alias("lat"), _lng(key).alias("lng"),
        (key * 10).cast("double").alias("elevation"), key.cast("long").alias("ord"),
    )


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between two nations as an edge, all that there is."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    buyers = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("a"))
    sellers = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    n = lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    geometry = F.when(F.col("n") % 2 == 1, F.array(F.array(_lat(F.col("a")), _lng(F.col("a"))), F.array(_lat(F.col("a") + F.col("b")), _lng(F.col("a") + F.col("b"))), F.array(_lat(F.col("b")), _lng(F.col("b")))))
    return n.select(
        F.concat(F.lit("n"), "a").alias("src"), F.concat(F.lit("n"), "b").alias("dst"), ((F.col("n") % 17 + 1) / 2.0).cast("string").alias("distance_km"),
        (F.col("n") % 23 + 5).cast("string").alias("time_min"), (F.col("n") % 7 * 10).cast("string").alias("elevation_gain_m"),
        F.when(F.col("n") % 5 == 0, "unknown").otherwise((F.col("n") % 6 + 1).cast("string")).alias("difficulty"), geometry.alias("geometry"), (F.col("a") * 25 + F.col("b")).cast("long").alias("ord"),
    )


def _requests(spark: SparkSession, sf_dir: str, criterion: str | None = None) -> DataFrame:
    a, b = (_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(x)) for x in "ab")
    kinds = F.array(*map(F.lit, numbers.CRITERIA))
    pick = F.lit(criterion) if criterion else F.element_at(kinds, ((F.col("a") + F.col("b")) % 4 + 1).cast("int"))
    ends = a.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(24))))
    return ends.join(b, "b", "left_semi").select((F.col("a") * 100 + F.col("b")).cast("long").alias("req_id"), F.concat(F.lit("n"), "a").alias("start"), F.concat(F.lit("n"), "b").alias("end"), pick.alias("criterion"))


def _answers(spark: SparkSession, sf_dir: str, criterion: str | None = None) -> DataFrame:
    out = routing.solve(_requests(spark, sf_dir, criterion), settled(_links(spark, sf_dir), "links"))
    return out.withColumn("path", F.array_join("path", ","))


def route_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of nations as a route request, under four criteria in turn."""
    return _answers(spark, sf_dir)


def _by_criterion(criterion: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _answers(spark, sf_dir, criterion).select("req_id", "status", "route_weight", "path")


def _order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as places: a customer's next order follows the one before; first and last orders of customers k, k // 4 * 2 + k % 2 and k // 6 * 2 + k % 2 are linked.

    Long trails of orders with two neighbours each between crossings of three and more, in two parts: even and odd customers.
    """
    orders = settled(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    steps = orders.select(before.alias("a"), F.col("o_orderkey").alias("b")).filter("a is not null")
    ends = settled(orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")), "ends")
    k = F.col("o_custkey")

    def across(by: int, to: str) -> DataFrame:
        other = ends.select(F.col("o_custkey").alias("p"), F.col(to).alias("a"))
        return ends.withColumn("p", F.floor(k / by) * 2 + k % 2).filter("p <> o_custkey").join(other, "p").select("a", F.col("first").alias("b"))

    links = steps.unionByName(across(4, "last")).unionByName(across(6, "first"))
    a, b = F.col("a"), F.col("b")
    n = a * 31 + b * 17
    return links.select(
        F.concat(F.lit("o"), a).alias("src"), F.concat(F.lit("o"), b).alias("dst"), ((n % 17 + 1) / 2.0).cast("string").alias("distance_km"), (n % 23 + 5).cast("string").alias("time_min"),
        (n % 7 * 10).cast("string").alias("elevation_gain_m"), F.when(n % 5 == 0, "unknown").otherwise((n % 6 + 1).cast("string")).alias("difficulty"), (a * 10_000_000 + b).alias("ord"),
    )


def _order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first order of a nation's first customer to the last order of its last one."""
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    held = customers.join(orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    ends = held.groupBy("c_nationkey").agg(F.min_by("first", "c_custkey").alias("a"), F.max_by("last", "c_custkey").alias("b"))
    kind = F.element_at(F.array(*map(F.lit, numbers.CRITERIA)), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return ends.select(F.col("c_nationkey").cast("long").alias("req_id"), F.concat(F.lit("o"), "a").alias("start"), F.concat(F.lit("o"), "b").alias("end"), kind.alias("criterion"))


def order_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes over a graph of all orders, which grows with the data; requests that nothing connects leave before the search."""
    edges = settled(_order_links(spark, sf_dir), "links")
    out = routing.solve(settled(_order_requests(spark, sf_dir), "requests"), edges, parts=True)
    return out.withColumn("path", F.array_join("path", ","))


def reachable_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pairs of consecutive nations' requests have both ends in one part of the graph of orders."""
    requests = settled(_order_requests(spark, sf_dir), "requests")
    other = requests.select(((F.col("req_id") + 24) % 25).alias("req_id"), F.col("end"))
    crossed = requests.select("req_id", "start").join(other, "req_id")
    found = graph.together(crossed, graph.components(_order_links(spark, sf_dir))).select("req_id", F.lit(True).alias("found"))
    return crossed.join(found, "req_id", "left").select("req_id", "start", "end", F.coalesce("found", F.lit(False)).alias("reachable"))


def weights_by_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumns({
        "distance_km": F.col("l_quantity").cast("string"), "time_min": F.concat(F.lit(" "), F.col("l_linenumber") * 10), "elevation_gain_m": (F.col("l_tax") * 100).cast("string"),
        "difficulty": F.when(F.col("l_linenumber") % 4 == 0, "unknown").otherwise(F.col("l_linenumber").cast("string")),
    })
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(w, 6).alias(f"w_{k}") for k, w in numbers.edge_weights().items()])


def dirty_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    dirty = F.when(kind == "signup", F.lit(None).cast("string")).when(kind == "error", " Unknown ").when(kind == "click", F.concat(F.lit(" \t"), k, F.lit(" "))).when(kind == "view", F.concat(F.lit("1_"), k, F.lit(".5"))).otherwise(F.concat(k, F.lit("d")))
    return _table(spark, sf_dir, "events").select("event_id", numbers.as_number(dirty, 7).alias("n"))


def scalar_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    scale = F.element_at(F.array(*map(F.lit, (*numbers.SAC_SCALE, "other"))), (key % 7 + 1).cast("int"))
    preference = F.element_at(F.array(*map(F.lit, ("shortest", "fastest", "easy", "balanced", ""))), (key % 5 + 1).cast("int"))
    criterion = F.element_at(F.array(*map(F.lit, numbers.CRITERIA)), (key % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", numbers.sac_difficulty(scale).alias("difficulty"), text.preferred_criterion(preference, F.lit("elevation")).alias("preferred"), text.criterion_label(criterion).alias("label"),
        text.minutes_text(size * 7).alias("minutes"), numbers.walking_minutes(size * 250, key % 900 - 100).alias("walking"), numbers.flat_minutes(size / 8.0).alias("flat"),
        numbers.ascent(F.lit(10.0), size / 2.0).alias("ascent"), text.shown_elevation(size % 3).alias("elevation"), text.shown_type(F.when(key % 2 == 0, "").otherwise(F.col("p_type"))).alias("kind"),
        text.one_decimal(F.col("p_retailprice")).alias("price"), numbers.height_or_null(F.when(key % 3 == 0, "").otherwise(size.cast("string"))).alias("height"),
        text.joined_names(F.split("p_name", " ")).alias("arrows"), text.osm_id(F.lit("node"), key).alias("node"),
        text.point_name(F.when(key % 2 == 0, "").otherwise(F.col("p_name")), F.lit(None), F.when(key % 4 == 0, F.col("p_brand")), key.cast("string")).alias("name"),
        text.is_generic(F.when(key % 3 == 0, F.concat(F.lit(" punkt "), key)).otherwise(F.col("p_name"))).alias("generic"),
    )


def folded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents without accents, counted."""
    lines = _table(spark, sf_dir, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return lines.select(text.fold_text(F.col("line")).alias("folded")).groupBy("folded").agg(F.count(F.lit(1)).alias("n"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    lat, latitude = F.when(key % 3 == 0, "0").when(key % 3 == 1, _lat(key).cast("string")), F.when(key % 2 == 0, _lat(key).cast("string"))
    lng = F.when(key % 7 == 0, "x").otherwise(_lng(key).cast("string"))
    server, client = geo.server_position([lat, latitude], [lng]), geo.client_position([lat, latitude], [lng])
    listed = geo.list_position(F.when(key % 5 == 0, F.array(lat)).otherwise(F.array(lat, lng)))
    far = F.when(key % 11 == 1, "Infinity").otherwise(lng)
    named = geo.named_position([lat, latitude], [F.lit(None).cast("string"), far])
    r = lambda c: F.round(c, 6)
    return _table(spark, sf_dir, "customer").select("c_custkey", r(named["lat"]).alias("d_lat"), r(named["lng"]).alias("d_lng"), r(server["lat"]).alias("s_lat"), r(server["lng"]).alias("s_lng"), r(client["lat"]).alias("c_lat"), r(client["lng"]).alias("c_lng"), r(listed["lat"]).alias("l_lat"), r(listed["lng"]).alias("l_lng"))


def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    return rows.select("s_suppkey", F.round(geo.haversine_km(_lat(s), _lng(s), _lat(n), _lng(n)), 6).alias("km"))


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = _table(spark, sf_dir, "customer").select(c.cast("string").alias("id"), _lat(c).alias("lat"), _lng(c).alias("lng"), F.when(c % 3 == 0, F.concat(F.lit("s"), c % 100)).otherwise("").alias("nearest_routing_node_id"))
    nodes = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), s).alias("id"), _lat(s + 5).alias("lat"), _lng(s * 3).alias("lng"), s.alias("ord"))
    return points, nodes


def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nodes = _places(spark, sf_dir)
    return nearest.nearest(points, nodes).select("id", "node_id", F.round("km", 6).alias("km"))


def resolve_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nodes = _places(spark, sf_dir)
    return nearest.resolved(points.withColumn("key", F.col("id")).drop("id"), nodes, "key")


def relinked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nodes = _places(spark, sf_dir)
    return nearest.relinked(points, nodes).select("id", "nearest_routing_node_id", "distance_to_trail_m")


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ways through their parts."""
    line = F.struct("l_linenumber", "l_partkey")
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(F.sort_array(F.collect_list(line))["l_partkey"].alias("nodes"))


def way_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osm.way_segments(_ways(spark, sf_dir)).select("way", "seg", "a", "b")


def undirected_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = osm.way_segments(_ways(spark, sf_dir)).select("way", "seg", F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"))
    return graph.first_edges(found, "way", "seg").select("lo", "hi", "way", "seg")


def _tags(key: Column) -> Column:
    """Tags of parts as nodes: names under one key or another or none, empty ones, kinds, elevations."""
    text_of = lambda k, n, value: F.when(key % n == k, value)
    return F.create_map(
        F.lit("name"), F.when(key % 4 != 0, F.when(key % 13 == 1, "").otherwise(F.col("p_name"))), F.lit("name:pl"), text_of(2, 9, F.col("p_brand")), F.lit("alt_name"), text_of(0, 8, F.col("p_type")),
        F.lit("ele"), F.when(key % 5 == 0, "high").otherwise(F.concat(F.col("p_size"), F.lit(".5"))), F.lit("natural"), F.element_at(F.array(*map(F.lit, ("peak", "saddle", "water", "tree", ""))), (F.col("p_size") % 5 + 1).cast("int")),
        F.lit("tourism"), text_of(1, 3, F.lit("viewpoint")), F.lit("waterway"), text_of(2, 6, F.lit("waterfall")),
    )


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes and orders as ways of a map extract; every tenth part's position is unknown to it."""
    key, order = F.col("p_partkey"), F.col("way")
    kinds = lambda k: F.element_at(F.array(*map(F.lit, ("path", "footway", "road", "track", "motorway"))), (k % 5 + 1).cast("int"))
    nodes = _table(spark, sf_dir, "part").withColumn("known", key % 10 != 3).select(F.when(F.col("known"), "node").otherwise("relation").alias("type"), key.alias("id"), _lat(key).alias("lat"), _lng(key).alias("lon"), F.lit(None).cast("array<bigint>").alias("nodes"), _tags(key).alias("tags"), key.alias("ord"))
    tags = F.create_map(F.lit("name"), F.when(order % 3 != 0, F.concat(F.lit("Szlak "), order % 100)), F.lit("access"), F.when(order % 6 == 0, "private"), F.lit("highway"), kinds(order), F.lit("sac_scale"), F.when(order % 4 != 0, F.element_at(F.array(*map(F.lit, (*numbers.SAC_SCALE, "x"))), (order % 7 + 1).cast("int"))))
    ways = _ways(spark, sf_dir).select(F.lit("way").alias("type"), order.alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "nodes", tags.alias("tags"), (order + 100_000_000).alias("ord"))
    return nodes.unionByName(ways)


def _map_edges(osm_rows: DataFrame) -> DataFrame:
    _, edges = osm.full_map(osm_rows)
    return edges.select("src", "dst", F.col("distance_km").alias("km"), F.col("time_min").alias("minutes"), "elevation_gain_m", "difficulty", "osm_way_id", "trail_name", F.size("geometry").alias("n_positions"))


def full_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map_edges(_elements(spark, sf_dir))


def extract_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same map from an extract: the elements are written as files of unlike sizes and read back in splits."""
    rows = _elements(spark, sf_dir).select("ord", F.to_json(F.struct("type", "id", "lat", "lon", "nodes", "tags")).alias("value"))
    folder = scratch_path(spark, "extract")
    rows.repartitionByRange("ord").sortWithinPartitions("ord").select("value").write.text(folder)
    return _map_edges(osm.read_extract(spark, folder, split_bytes=4 << 20))


def full_map_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = osm.full_map(_elements(spark, sf_dir))
    return nodes.select("id", "name", "type", F.round("lat", 6).alias("lat"), "elevation")


def walk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = osm.walk_map(_elements(spark, sf_dir))
    return edges.select(F.col("ord.way_ord").alias("way"), F.col("ord.seg").alias("seg"), "src", "dst", F.col("distance_km").alias("km"), F.col("time_min").alias("minutes"), "elevation_gain_m", "difficulty")


def walk_map_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = osm.walk_map(_elements(spark, sf_dir))
    return nodes.select("id", "name", "type", F.round("lng", 6).alias("lng"), "elevation")


def selected_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails with a node in a smaller box, and all nodes that they go through."""
    return osm.selected(_elements(spark, sf_dir), (49.20, 19.80, 49.22, 19.90)).select("type", "id")


def built_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points, lines, rings with and without a hole (of which waterfalls alone stay lines), linked to suppliers as nodes."""
    key = F.col("p_partkey")
    at = lambda k: F.struct(_lat(key + k).alias("lat"), _lng(key + k).alias("lng"))
    line = lambda *steps: F.array(*map(at, steps))
    rings = F.when(key % 5 == 0, F.array(line(0))).when(key % 5 == 1, F.array(line(0, 7, 20))).when(key % 5 == 2, F.array(line(0, 7, 20, 0))).when(key % 5 == 3, F.array(line(0, 3, 7, 20, 45, 0))).otherwise(F.array(line(0, 7, 20, 0), line(100, 130, 107, 100)))
    holes = F.when(key % 5 == 4, F.array(line(2, 9, 5, 2))).otherwise(F.array().cast("array<array<struct<lat:double,lng:double>>>"))
    kind = F.when(key % 5 == 0, "node").when(key % 5 == 4, "relation").otherwise("way")
    features = _table(spark, sf_dir, "part").select(kind.alias("type"), key.alias("id"), rings.alias("rings"), holes.alias("holes"), _tags(key).alias("tags"), key.alias("ord"))
    _, nodes = _places(spark, sf_dir)
    return osm.points_of_interest(features, nodes).select("id", "name", "type", "lat", "lng", "elevation", "nearest_routing_node_id", "distance_to_trail_m")


def bbox_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    highway = F.element_at(F.array(*map(F.lit, ("path", "footway", "road", "tracks", "motorway"))), (key % 5 + 1).cast("int"))
    access = F.when(F.col("p_size") % 4 == 0, "private").when(F.col("p_size") % 4 == 1, "yes").when(F.col("p_size") % 4 == 2, "no")
    kept = osm.in_box(_lat(key) + 0.05, _lng(key)) & osm.trail_tags(highway, access, F.when(key % 7 == 0, "hiking"))
    return _table(spark, sf_dir, "part").select("p_partkey", kept.alias("trail"), osm.walk_tags(highway, access).alias("walk"))


def _buying(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), _lat(F.col("c_custkey")).alias("lat"), _lng(F.col("c_custkey")).alias("lng"), F.col("c_custkey").alias("ord"))
    edges = _table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("c"), F.col("o_orderkey") % 3000).alias("dst"), F.col("o_orderkey").alias("ord"))
    return nodes, edges


def used_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.used_nodes(*_buying(spark, sf_dir)).select("id").orderBy("id")


def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no urgent order under way leads from or to."""
    nodes, _ = _buying(spark, sf_dir)
    orders = _table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    edges = orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("c"), F.col("o_orderkey") % 3000).alias("dst"))
    return graph.isolated_nodes(nodes, edges).select("id")


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_counts(*_buying(spark, sf_dir))


def drawn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _buying(spark, sf_dir)
    r = lambda c: F.round(c, 6).alias(c)
    return graph.drawn_edges(edges, nodes).select("ord", "src", "dst", r("src_lat"), r("src_lng"), r("dst_lat"), r("dst_lng"))


def adjacency_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(_buying(spark, sf_dir)[1]).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as routes through parts, with an end point before and behind."""
    routes = _ways(spark, sf_dir).select(F.col("way").alias("req_id"), F.col("nodes").cast("array<string>").alias("path"))
    key = F.col("p_partkey")
    nodes = _table(spark, sf_dir, "part").filter("p_size > 5").select(key.cast("string").alias("id"), F.col("p_name").alias("name"), F.lit("waypoint").alias("type"), _lat(key).alias("lat"), _lng(key).alias("lng"), F.lit(0.0).alias("elevation"), key.alias("ord"))
    ends = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("req_id"), F.inline(F.array(F.struct(F.lit(False).alias("last"), F.lit("a").alias("id")), F.struct(F.lit(True).alias("last"), F.lit("z").alias("id")))))
    ends = ends.withColumns({"name": F.lit("end"), "type": F.lit("poi"), "lat": F.lit(0.0), "lng": F.lit(0.0), "elevation": F.lit(0.0)})
    return assembly.route_points(routes, ends, nodes).select("req_id", "place", "id", "name")


def route_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks over each nation and the next two, along the links there are."""
    key = F.col("n_nationkey")
    step = lambda k: F.concat(F.lit("n"), (key + k) % 25)
    routes = _table(spark, sf_dir, "nation").select(key.alias("req_id"), F.array(step(0), step(1), step(2), step(7)).alias("path"))
    found = assembly.route_positions(routes, _links(spark, sf_dir), _nations(spark, sf_dir))
    return found.select("req_id", "place", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def route_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last part of every order, of those with a discount alone: some orders have none."""
    line = F.when(F.col("l_discount") > 0.05, F.struct("l_linenumber", "l_partkey"))
    routes = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line))["l_partkey"].alias("nodes"))
    return routes.select("l_orderkey", assembly.ends_of(F.col("nodes")).alias("x")).select("l_orderkey", "x.first", "x.last")


def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return assembly.without_repeats(rows, "user_id", "at", F.col("event_type")).select("event_id", "user_id", "event_type")


def characteristic_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("Punkt "), F.get_json_object("props", "$.k"))).when(F.col("event_type") == "click", " ").otherwise(F.concat("event_type", F.lit(" "), F.floor(F.col("value") / 20)))
    rows = _table(spark, sf_dir, "events").withColumns({"name": name, "place": F.struct("ts", "event_id")})
    return assembly.characteristic_points(rows, "user_id", "place").select("user_id", "event_id", "name")


def path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the parts and suppliers on every line."""
    path = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("req_id"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("id"))
    points = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    nodes = _table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return assembly.path_points(path, points, nodes).select("req_id", "place", "id", "name")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select((F.col("p_partkey") % 1500).cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_partkey").alias("ord"))


def unique_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.unique_points(_points(spark, sf_dir)).select("id", "name", "ord")


def search_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suggestions(_points(spark, sf_dir), " Réd ").select("id", "name", "type")


def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for a piece of the name of every part, one to six characters long."""
    key = F.col("p_partkey")
    queries = _table(spark, sf_dir, "part").select(key.alias("q_id"), F.substring("p_name", (key % 7 + 1).cast("int"), (key % 6 + 1).cast("int")).alias("query"))
    return search.suggestions_for(_points(spark, sf_dir), queries).select("q_id", "place", "id", "name", "type")


def route_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _buying(spark, sf_dir)
    requests = edges.select(F.col("ord").alias("req_id"), F.when(F.col("ord") % 11 == 0, "").otherwise(F.col("src")).alias("start"), F.col("dst").alias("end"))
    return checks.route_status(requests, nodes, nodes).select("req_id", "code")


def route_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final status of requests, some of them without a matching node or a connection."""
    nodes, edges = _buying(spark, sf_dir)
    key = F.col("ord")
    requests = edges.select(key.alias("req_id"), F.when(key % 11 == 0, "").otherwise(F.col("src")).alias("start"), F.col("dst").alias("end"))
    routes = edges.select(key.alias("req_id"), F.when(key % 3 != 0, F.col("src")).alias("routing_start"), F.col("dst").alias("routing_end"), F.when(key % 5 == 0, "no route").otherwise("ok").alias("status"))
    return checks.route_reasons(checks.route_status(requests, nodes, nodes), routes)


def form_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(key % 4 != 0, F.col("c_name")).alias("name"), F.when(key % 7 == 0, "").otherwise(F.col("c_mktsegment")).alias("email"), F.expr("left(c_name, int(c_custkey % 9))").alias("password"),
        F.when(key % 5 != 0, key).alias("user_id"), F.when(key % 6 == 0, "").otherwise(F.col("c_mktsegment")).alias("route_name"),
    )
    return rows.select("c_custkey", checks.registration_ok().alias("registration"), checks.favourite_ok().alias("favourite"))


def favourite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as favourites, their parts as the path."""
    rows = _ways(spark, sf_dir).select(F.col("way").alias("user_id"), F.col("nodes").cast("array<string>").alias("path"))
    return store.favourite_rows(rows)


def response_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the client draws: the line of an answer, or its points where there is no line."""
    key = F.col("c_custkey")
    at = lambda k: F.struct(F.when((key + k) % 9 == 0, float("nan")).when((key + k) % 9 == 1, float("inf")).otherwise(_lat(key + k)).alias("lat"), _lng(key + k).alias("lng"))
    none = F.array().cast("array<struct<lat:double,lng:double>>")
    line, points = F.when(key % 4 == 0, none).otherwise(F.array(at(0), at(1), at(2))), F.array(at(5), at(6))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(assembly.line_or_points(line, points)).alias("place", "p"))
    return rows.select("c_custkey", "place", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


def client_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation as a document of points, as the client reads it."""
    key = F.col("c_custkey")
    item = F.to_json(F.struct(
        F.when(key % 10 != 0, key.cast("string")).alias("id"), F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(key % 6 == 0, F.col("c_mktsegment")).alias("title"),
        F.when(key % 4 == 0, F.lit(0.0)).when(key % 4 == 1, key / 8.0).alias("lat"), F.when(key % 4 == 2, "x").when(key % 2 == 0, key.cast("string")).alias("latitude"), (key / 16.0).alias("lon"),
    ))
    pair = F.struct(key.alias("k"), F.concat(F.when(F.col("c_nationkey") % 2 == 1, F.concat(F.lit('"'), key, F.lit('":'))).otherwise(""), item).alias("item"))
    listed = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list(pair))["item"], ",").alias("items"))
    odd = F.col("c_nationkey") % 2 == 1
    value = F.concat(F.lit('{"points":'), F.when(odd, "{").otherwise("["), F.col("items"), F.when(odd, "}").otherwise("]"), F.lit("}"))
    rows = documents.collection(listed.select("c_nationkey", value.alias("value")), "value", "id STRING, name STRING, label STRING, title STRING, lat STRING, latitude STRING, lng STRING, lon STRING, longitude STRING", "points", "nodes", promote=False)
    return geo.client_points(rows).select("id", "name", "lat", "lng")


def map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map document for each region: nations as nodes under their ids, edges to the region."""
    key = F.col("n_nationkey")
    node = F.concat(F.lit('"n'), key, F.lit('":'), F.to_json(F.struct(F.col("n_name").alias("name"), (key / 4.0).alias("lat"))))
    edge = F.to_json(F.struct(F.concat(F.lit("n"), key).alias("from"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("to"), F.when(key % 2 == 0, "unknown").otherwise(key.cast("string")).alias("difficulty"), F.array(F.array(key / 2.0, key / 4.0)).alias("geometry")))
    docs = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(node), ",").alias("nodes"), F.array_join(F.collect_list(edge), ",").alias("edges"))
    nodes, edges = documents.map_rows(docs.select(F.concat(F.lit('{"nodes":{'), "nodes", F.lit('},"edges":['), "edges", F.lit("]}")).alias("value")))
    return edges.join(nodes.select(F.col("id").alias("src"), "name", "lat"), "src").select("src", "dst", "name", "lat", "difficulty", F.col("geometry")[0][0].alias("first"))


def unique_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.concat_ws("@", "c_mktsegment", "c_nationkey").alias("email"))
    users = _table(spark, sf_dir, "nation").select(F.concat(F.lit("BUILDING@"), "n_nationkey").alias("email"), F.col("n_nationkey").cast("long").alias("id")).filter("id < 5")
    return store.insert_users(users, batch).select("id", "email", "ord")


def replayed_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users in four batches, of which two come again."""
    rows = settled(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.concat_ws("@", "c_mktsegment", "c_nationkey").alias("email")), "batches")
    table = f"users_{uuid.uuid4().hex}"
    for batch in (0, 1, 1, 2, 3, 0):
        store.insert_users_once(rows.filter(F.col("ord") % 4 == batch), table, batch)
    out = settled(spark.table(table).select("id", "email", "ord"), "users")
    spark.sql(f"DROP TABLE {table}")
    return out


def verified_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"), F.sha2(F.concat("c_name", F.lit("!")), 256).alias("password_hash"))
    tries = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("email"), F.col("o_orderstatus").alias("s"))
    tries = tries.withColumn("password", F.when(F.col("s") == "F", "bad").otherwise(F.concat("email", F.lit("!"))))
    return store.verified(users, tries, F.col("password_hash") == F.sha2("password", 256)).select("o_orderkey", "user_id", "ok")


def favorites_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("route_name"), F.col("o_totalprice").alias("distance_km"), F.col("o_orderdate").alias("created_at"))
    return store.favourites_of(rows, 7).select("id", "user_id", "route_name", "distance_km", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = F.when(F.col("event_type") == "error", "").otherwise(F.get_json_object("props", "$.k"))
    return store.profile_updates(_table(spark, sf_dir, "events").select("user_id", height.alias("height_cm"), F.nullif("event_type", F.lit("view")).alias("experience_level"), F.lit("easy").alias("route_preference"), F.struct("ts", "event_id").alias("updated_at")))


def profile_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(_profiles(spark, sf_dir), "user_id", "updated_at").select("user_id", "height_cm", "experience_level", "route_preference")


def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same profiles, merged in batches that come out of order and of which one comes again."""
    rows = settled(_profiles(spark, sf_dir), "profiles")
    path = scratch_path(spark, "merged")
    for batch in (2, 0, 3, 2, 1):
        store.merge(rows.filter(F.pmod(F.xxhash64("updated_at"), F.lit(4)) == batch), path, "user_id", "updated_at", buckets=16)
    return store.merged_rows(spark, path).select("user_id", "height_cm", "experience_level", "route_preference")


def profile_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return store.profiles_of(users, _profiles(spark, sf_dir))


def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return store.without_orphans(_table(spark, sf_dir, "events").select("event_id", "user_id"), users)


def normalize_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as JSON in five shapes of container."""
    key = F.col("n_nationkey")
    item = F.to_json(F.struct(F.col("n_name").alias("name"), key.cast("double").alias("lat")))
    own = F.to_json(F.struct(F.lit("own").alias("id"), F.col("n_name").alias("name"), key.cast("double").alias("lat")))
    shapes = F.element_at(F.array(
        F.concat(F.lit("["), own, F.lit(","), item, F.lit(",3]")), F.concat(F.lit('{"points":['), own, F.lit("]}")), F.concat(F.lit('{"nodes":{"k":'), item, F.lit(',"l":'), own, F.lit("}}")),
        F.concat(F.lit('{"k":'), item, F.lit(',"v":3}')), F.lit('"text"'),
    ), (key % 5 + 1).cast("int"))
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", shapes.alias("value"))
    return documents.collection(rows, "value", "id STRING, name STRING, lat DOUBLE", "points", "nodes").select("n_nationkey", "ord", "id", "name", "lat")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "route_batch": route_batch,
    **{f"shortest_path_{c}": _by_criterion(c) for c in numbers.CRITERIA},
    **{f.__name__: f for f in (
        order_routes, reachable_requests, weights_by_criterion, dirty_number, scalar_expressions, folded_words, coordinates, haversine_pairs, nearest_node, resolve_node, relinked_points, way_segments, undirected_dedup, full_map, extract_map, full_map_nodes, walk_map, walk_map_nodes, selected_elements, built_points,
        bbox_tag_filter, used_nodes, isolated_nodes, graph_counts, drawn_edges, adjacency_degree, route_points, route_positions, route_ends, consecutive_runs, characteristic_points, path_points, unique_points, search_points, search_batch,
        route_status, route_reasons, form_checks, favourite_rows, response_positions, client_points, map_scan, unique_insert, replayed_inserts, verified_logins, favorites_by_user, profile_upsert, profile_merge, profile_view, orphan_rows, normalize_collection,
    )},
}
