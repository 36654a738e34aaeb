"""DuckDB SQL for the registered queries of the trail operators."""

from __future__ import annotations


def _lat(k: str) -> str:
    return f"(49.15::DOUBLE + (({k}) * 37 % 1000) * 0.00021::DOUBLE)"


def _lng(k: str) -> str:
    return f"(19.70::DOUBLE + (({k}) * 91 % 1000) * 0.00045::DOUBLE)"


def _km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"(sin(radians({lat2} - {lat1}) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lng2} - {lng1}) / 2) ** 2)"
    return f"(2 * 6371.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})))"


def _pick(values: tuple[str, ...], k: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[(({k}) % {len(values)} + 1)::INT]"


SAC = ("hiking", "mountain_hiking", "demanding_mountain_hiking", "alpine_hiking", "demanding_alpine_hiking", "difficult_alpine_hiking")

LINKS = f"""
links AS (
  SELECT 'n' || a AS src, 'n' || b AS dst, (n % 17 + 1) / 2.0::DOUBLE AS km, (n % 23 + 5)::DOUBLE AS minutes, (n % 7 * 10)::DOUBLE AS gain,
         CASE WHEN n % 5 = 0 THEN NULL ELSE (n % 6 + 1)::DOUBLE END AS hard, n % 2 = 1 AS drawn, a, b, a * 25 + b AS ord
  FROM (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> s_nationkey GROUP BY ALL)),
pairs AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, * FROM links QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ord) = 1)
"""


def _routes(criterion: str | None) -> str:
    """Relaxation by unrolled rounds, then the walk back along tight arcs."""
    kind = f"'{criterion}'" if criterion else "(['time', 'distance', 'elevation', 'difficulty'])[(a.n_nationkey + b.n_nationkey) % 4 + 1]"
    rounds = "".join(
        f", d{i} AS MATERIALIZED (SELECT criterion, start, node, min(d) AS d FROM (SELECT * FROM d{i - 1} UNION ALL SELECT p.criterion, start, arcs.nb, p.d + w FROM d{i - 1} p JOIN arcs ON p.criterion = arcs.criterion AND p.node = arcs.node) GROUP BY ALL)"
        for i in range(1, 17)
    )
    return f"""
WITH RECURSIVE {LINKS},
kinds AS (SELECT src, dst, unnest([{{'c': 'time', 'w': minutes}}, {{'c': 'distance', 'w': km}}, {{'c': 'elevation', 'w': gain + km * 10}}, {{'c': 'difficulty', 'w': coalesce(hard, 1) * 100 + gain + minutes + km * 10}}]) AS x FROM links),
arcs AS MATERIALIZED (SELECT criterion, node, nb, min(w) AS w FROM (SELECT x.c AS criterion, src AS node, dst AS nb, x.w AS w FROM kinds UNION ALL SELECT x.c, dst, src, x.w FROM kinds) GROUP BY ALL),
req AS (SELECT (a.n_nationkey * 100 + b.n_nationkey)::BIGINT AS req_id, 'n' || a.n_nationkey AS "start", 'n' || b.n_nationkey AS "end", {kind} AS criterion FROM nation a, nation b),
d0 AS MATERIALIZED (SELECT DISTINCT criterion, node AS start, node, 0::DOUBLE AS d FROM arcs){rounds},
back AS MATERIALIZED (SELECT criterion, start, node, prev FROM (SELECT v.criterion, v.start, v.node, u.node AS prev, row_number() OVER (PARTITION BY v.criterion, v.start, v.node ORDER BY u.d, u.node) AS r
  FROM d16 v JOIN arcs ON v.criterion = arcs.criterion AND v.node = arcs.nb JOIN d16 u ON u.criterion = v.criterion AND u.start = v.start AND u.node = arcs.node WHERE u.d + w = v.d AND u.d < v.d) WHERE r = 1),
walk AS (SELECT req_id, req.criterion, req."start", d16.node, d16.node AS path, 0 AS hop, d16.d FROM req JOIN d16 ON d16.criterion = req.criterion AND d16.start = req."start" AND d16.node = req."end"
  UNION ALL SELECT req_id, walk.criterion, walk."start", prev, prev || ',' || path, hop + 1, d FROM walk JOIN back ON back.criterion = walk.criterion AND back.start = walk."start" AND back.node = walk.node),
found AS MATERIALIZED (SELECT req_id, path, d FROM walk WHERE node = "start"),
hops AS (SELECT req_id, unnest(list_zip(string_split(path, ',')[:-2], string_split(path, ',')[2:])) AS x FROM found),
sums AS (SELECT req_id, sum(km) AS km, sum(minutes) AS minutes, sum(gain) AS gain, sum(coalesce(hard, 0)) AS hard FROM hops JOIN pairs ON lo = least(x[1], x[2]) AND hi = greatest(x[1], x[2]) GROUP BY req_id)
"""


ORDER_LINKS = """
ends AS MATERIALIZED (SELECT o_custkey AS k, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY ALL),
steps AS (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, o_orderkey AS b FROM orders),
joined AS (SELECT * FROM steps WHERE a IS NOT NULL UNION ALL SELECT p.last, c.first FROM ends c JOIN ends p ON p.k = c.k // 4 * 2 + c.k % 2 AND p.k <> c.k UNION ALL SELECT p.first, c.first FROM ends c JOIN ends p ON p.k = c.k // 6 * 2 + c.k % 2 AND p.k <> c.k),
links AS MATERIALIZED (SELECT 'o' || a AS src, 'o' || b AS dst, (n % 17 + 1) / 2.0::DOUBLE AS km, (n % 23 + 5)::DOUBLE AS minutes, (n % 7 * 10)::DOUBLE AS gain, CASE WHEN n % 5 = 0 THEN NULL ELSE (n % 6 + 1)::DOUBLE END AS hard, a * 10000000 + b AS ord FROM (SELECT *, a * 31 + b * 17 AS n FROM joined)),
req AS MATERIALIZED (SELECT c_nationkey::BIGINT AS req_id, 'o' || arg_min(first, c_custkey) AS "start", 'o' || arg_max(last, c_custkey) AS "end", (['time', 'distance', 'elevation', 'difficulty'])[c_nationkey % 4 + 1] AS criterion FROM customer JOIN ends ON k = c_custkey GROUP BY c_nationkey)
"""

#: Distances by recursion that keeps the least of each key, then the walk back along tight arcs.
ORDER_ROUTES = f"""
WITH RECURSIVE {ORDER_LINKS},
pairs AS MATERIALIZED (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, * FROM links QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ord) = 1),
kinds AS (SELECT src, dst, unnest([{{'c': 'time', 'w': minutes}}, {{'c': 'distance', 'w': km}}, {{'c': 'elevation', 'w': gain + km * 10}}, {{'c': 'difficulty', 'w': coalesce(hard, 1) * 100 + gain + minutes + km * 10}}]) AS x FROM links),
arcs AS MATERIALIZED (SELECT criterion, node, nb, min(w) AS w FROM (SELECT x.c AS criterion, src AS node, dst AS nb, x.w AS w FROM kinds UNION ALL SELECT x.c, dst, src, x.w FROM kinds) GROUP BY ALL),
dist(req_id, node, d, criterion) USING KEY (req_id, node) AS (SELECT req_id, "start", 0::DOUBLE, criterion FROM req
  UNION SELECT p.req_id, arcs.nb, min(p.d + w), any_value(p.criterion) FROM dist p JOIN arcs ON p.criterion = arcs.criterion AND p.node = arcs.node LEFT JOIN recurring.dist o ON o.req_id = p.req_id AND o.node = arcs.nb WHERE o.d IS NULL OR p.d + w < o.d GROUP BY p.req_id, arcs.nb),
dd AS MATERIALIZED (SELECT * FROM dist),
back AS MATERIALIZED (SELECT v.req_id, v.node, arg_min(u.node, (u.d, u.node)) AS prev FROM dd v JOIN arcs ON v.criterion = arcs.criterion AND v.node = arcs.nb JOIN dd u ON u.req_id = v.req_id AND u.node = arcs.node WHERE u.d + w = v.d AND u.d < v.d GROUP BY ALL),
walk AS (SELECT req_id, "start", node, node AS path, d FROM req JOIN dd USING (req_id) WHERE node = "end" UNION ALL SELECT req_id, "start", prev, prev || ',' || path, d FROM walk JOIN back USING (req_id, node)),
found AS MATERIALIZED (SELECT req_id, path, d FROM walk WHERE node = "start"),
hops AS (SELECT req_id, unnest(list_zip(string_split(path, ',')[:-2], string_split(path, ',')[2:])) AS x FROM found),
sums AS (SELECT req_id, sum(km) AS km, sum(minutes) AS minutes, sum(gain) AS gain, sum(coalesce(hard, 0)) AS hard FROM hops JOIN pairs ON lo = least(x[1], x[2]) AND hi = greatest(x[1], x[2]) GROUP BY req_id)
"""


REACHABLE = f"""
WITH RECURSIVE {ORDER_LINKS},
arcs AS MATERIALIZED (SELECT src AS node, dst AS nb FROM links UNION SELECT dst, src FROM links),
seen AS (SELECT "start" AS origin, "start" AS node FROM req UNION SELECT origin, nb FROM seen JOIN arcs USING (node))
SELECT r.req_id, r."start" AS "start", o."end" AS "end", EXISTS (SELECT 1 FROM seen WHERE origin = r."start" AND node = o."end") AS reachable FROM req r JOIN req o ON (o.req_id + 24) % 25 = r.req_id
"""


def _answers(columns: str) -> str:
    """The last step of the routes: statuses, weights and totals of all requests."""
    return f"""SELECT {columns} FROM (SELECT req.*, CASE WHEN path IS NULL THEN 'no route' ELSE 'ok' END AS status, path, round_even(d, 2) AS route_weight,
  CASE WHEN path IS NOT NULL THEN round_even(coalesce(km, 0), 2) END AS total_distance_km, CASE WHEN path IS NOT NULL THEN round_even(coalesce(minutes, 0), 0)::BIGINT END AS total_time_min,
  CASE WHEN path IS NOT NULL THEN round_even(coalesce(gain, 0), 0)::BIGINT END AS total_elevation_gain_m, CASE WHEN path IS NOT NULL THEN round_even(coalesce(hard, 0), 2) END AS total_difficulty
  FROM req LEFT JOIN found USING (req_id) LEFT JOIN sums USING (req_id))"""


def _batch(criterion: str | None, columns: str) -> str:
    return _routes(criterion) + _answers(columns)


PLACES = f"""
p AS (SELECT c_custkey::VARCHAR AS id, {_lat("c_custkey")} AS lat, {_lng("c_custkey")} AS lng, CASE WHEN c_custkey % 3 = 0 THEN 's' || (c_custkey % 100) END AS named FROM customer),
n AS (SELECT 's' || s_suppkey AS node_id, {_lat("s_suppkey + 5")} AS nlat, {_lng("s_suppkey * 3")} AS nlng, s_suppkey AS ord FROM supplier),
near AS MATERIALIZED (SELECT id, node_id, km FROM (SELECT id, node_id, {_km("lat", "lng", "nlat", "nlng")} AS km, ord FROM p, n) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(km, 9), ord) = 1)
"""

WAYS = "w AS (SELECT l_orderkey AS way, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem)"
SEGMENTS = WAYS + ", s AS (SELECT * FROM (SELECT way, i::INT AS seg, k AS a, lead(k) OVER (PARTITION BY way ORDER BY i) AS b FROM w) WHERE b IS NOT NULL)"
_TAG_COLUMNS = """p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size + 0.5 END::DOUBLE AS ele, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 13 = 1 THEN '' ELSE p_name END END AS name,
  CASE WHEN p_partkey % 9 = 2 THEN p_brand END AS name_pl, CASE WHEN p_partkey % 8 = 0 THEN p_type END AS alt_name, (['peak', 'saddle', 'water', 'tree', ''])[p_size % 5 + 1] AS "natural",
  CASE WHEN p_partkey % 3 = 1 THEN 'viewpoint' END AS tourism, CASE WHEN p_partkey % 6 = 2 THEN 'waterfall' END AS waterway"""
TAGS = f"tg AS (SELECT {_TAG_COLUMNS} FROM part)"
KNOWN = f"kn AS (SELECT {_TAG_COLUMNS} FROM part WHERE p_partkey % 10 <> 3)"
BUYING = "e AS (SELECT 'c' || o_custkey AS src, 'c' || (o_orderkey % 3000) AS dst, o_orderkey AS ord FROM orders)"
_TRAIL_KM = _km(_lat("a"), _lng("a"), _lat("b"), _lng("b"))
PROFILES = "pr AS (SELECT user_id, try_cast(CASE WHEN event_type = 'error' THEN NULL ELSE json_extract_string(props, '$.k') END AS INT) AS height_cm, nullif(event_type, 'view') AS experience_level, 'easy' AS route_preference FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"
POINTS = "pt AS (SELECT (p_partkey % 1500)::VARCHAR AS id, p_name AS name, p_type AS type, p_partkey AS ord FROM part), u AS (SELECT id, name, type, first_value(ord) OVER (PARTITION BY id ORDER BY ord) AS first, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS r FROM pt)"

FULL_MAP = f"""WITH {SEGMENTS}, {KNOWN}, f AS (SELECT * FROM s JOIN kn x ON x.k = a JOIN kn y ON y.k = b QUALIFY row_number() OVER (PARTITION BY least('node/' || a, 'node/' || b), greatest('node/' || a, 'node/' || b) ORDER BY way, seg) = 1),
  g AS (SELECT *, {_TRAIL_KM} AS d FROM f)
  SELECT 'node/' || a AS src, 'node/' || b AS dst, round_even(d, 4) AS km, round_even(greatest(d * 15, 0.1::DOUBLE), 2) AS minutes, 0 AS elevation_gain_m, CASE WHEN way % 4 = 0 OR way % 7 = 6 THEN 1 ELSE way % 7 + 1 END::INT AS difficulty,
  'way/' || way AS osm_way_id, CASE WHEN way % 3 <> 0 THEN 'Szlak ' || (way % 100) ELSE '' END AS trail_name, 2 AS n_positions FROM g"""


def _meets(a: str, b: str, box: tuple[float, float, float, float]) -> str:
    """Whether the line between the positions of a and b (a_lat, ..., b_lng) meets the box, by shares of its length."""
    one = lambda c, low, high: (f"least(({low} - {a}_{c}) / ({b}_{c} - {a}_{c}), ({high} - {a}_{c}) / ({b}_{c} - {a}_{c}))", f"greatest(({low} - {a}_{c}) / ({b}_{c} - {a}_{c}), ({high} - {a}_{c}) / ({b}_{c} - {a}_{c}))", f"{a}_{c} = {b}_{c}", f"{a}_{c} BETWEEN {low} AND {high}")
    (in1, out1, still1, ok1), (in2, out2, still2, ok2) = one("lat", box[0], box[2]), one("lng", box[1], box[3])
    spans = lambda s, x, d: f"CASE WHEN {s} THEN {d} ELSE {x} END"
    return (
        f"(NOT ({still1}) OR {ok1}) AND (NOT ({still2}) OR {ok2}) AND "
        f"greatest(0.0::DOUBLE, {spans(still1, in1, '0.0::DOUBLE')}, {spans(still2, in2, '0.0::DOUBLE')}) <= least(1.0::DOUBLE, {spans(still1, out1, '1.0::DOUBLE')}, {spans(still2, out2, '1.0::DOUBLE')})"
    )


def _swept(steps: str, weight: str, x: str) -> str:
    """A sum over consecutive positions of the list ``steps`` (structs of a and o, from the first position of all)."""
    return f"coalesce(list_sum(list_transform(range(1, len({steps})), lambda i: ({weight.format(s=steps)}) * ({x.format(s=steps)}))), 0)"


_CROSS, _LENGTH = "{s}[i].o * {s}[i + 1].a - {s}[i + 1].o * {s}[i].a", "sqrt(({s}[i + 1].o - {s}[i].o) ** 2 + ({s}[i + 1].a - {s}[i].a) ** 2)"


def _middle(c: str) -> str:
    """The centroid's lat (c = a) or lng (c = o) from the lists r1, r2 and hole, less the first position."""
    both = "{s}[i]." + c + " + {s}[i + 1]." + c
    area = lambda s: _swept(s, _CROSS, "1")
    turned = lambda s, v: f"(CASE WHEN {area(s)} < 0 THEN -1 ELSE 1 END * {v})"
    w = f"({turned('r1', area('r1'))} + {turned('r2', area('r2'))} - {turned('hole', area('hole'))})"
    x = f"({turned('r1', _swept('r1', _CROSS, both))} + {turned('r2', _swept('r2', _CROSS, both))} - {turned('hole', _swept('hole', _CROSS, both))})"
    size, along = _swept("r1", _LENGTH, "1"), _swept("r1", _LENGTH, f"({both}) / 2")
    return f"CASE WHEN is_area AND {w} <> 0 THEN {x} / (3 * {w}) WHEN {size} <> 0 THEN {along} / {size} ELSE 0 END"


ORACLES: dict[str, str] = {
    "route_batch": _batch(None, "*"),
    **{f"shortest_path_{c}": _batch(c, "req_id, status, route_weight, path") for c in ("time", "distance", "elevation", "difficulty")},
    "order_routes": ORDER_ROUTES + _answers("*"),
    "reachable_requests": REACHABLE,
    "weights_by_criterion": """SELECT l_orderkey, l_linenumber, l_partkey, round((l_linenumber * 10)::DOUBLE, 6) AS w_time, round(l_quantity, 6) AS w_distance, round(l_tax * 100 + l_quantity * 10, 6) AS w_elevation,
        round((CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE l_linenumber END)::DOUBLE * 100 + l_tax * 100 + l_linenumber * 10 + l_quantity * 10, 6) AS w_difficulty FROM lineitem""",
    "dirty_number": "SELECT event_id, CASE event_type WHEN 'click' THEN k::DOUBLE WHEN 'view' THEN ('1' || k || '.5')::DOUBLE ELSE 7.0::DOUBLE END AS n FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)",
    "scalar_expressions": f"""SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN 1 ELSE p_partkey % 7 + 1 END::INT AS difficulty, {_pick(("distance", "time", "difficulty", "time", "elevation"), "p_partkey")} AS preferred,
        {_pick(("czas", "dystans", "brak", "trudność"), "p_partkey")} AS label,
        CASE WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN (m // 60) || ' h' ELSE (m // 60) || ' h ' || (m % 60) || ' min' END AS minutes,
        round_even((p_size * 250 / 1000.0::DOUBLE / 5.0::DOUBLE + greatest(p_partkey % 900 - 100, 0) / 600.0::DOUBLE) * 60.0::DOUBLE, 0)::BIGINT AS walking, round_even(greatest(p_size / 8.0::DOUBLE * 15.0::DOUBLE, 0.1::DOUBLE), 2) AS flat,
        round_even(greatest(p_size / 2.0::DOUBLE - 10, 0), 0)::BIGINT AS ascent, CASE WHEN p_size % 3 = 0 THEN 'brak danych' ELSE (p_size % 3)::VARCHAR END AS elevation, CASE WHEN p_partkey % 2 = 0 THEN 'punkt' ELSE p_type END AS kind,
        printf('%.1f', p_retailprice) AS price, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END::INT AS height, replace(p_name, ' ', ' → ') AS arrows, 'node/' || p_partkey AS node,
        CASE WHEN p_partkey % 2 <> 0 THEN p_name WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_partkey::VARCHAR END AS name, p_partkey % 3 = 0 AS generic
        FROM (SELECT *, p_size * 7 AS m FROM part)""",
    "folded_words": "SELECT strip_accents(lower(line)) AS folded, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY ALL",
    "coordinates": f"""SELECT c_custkey, round(CASE WHEN s IS NOT NULL AND lng IS NOT NULL AND k % 11 <> 1 THEN s END, 6) AS d_lat, round(CASE WHEN s IS NOT NULL AND lng IS NOT NULL AND k % 11 <> 1 THEN lng END, 6) AS d_lng, round(CASE WHEN ok THEN s END, 6) AS s_lat, round(CASE WHEN ok THEN lng END, 6) AS s_lng, round(coalesce(lat, latitude), 6) AS c_lat, round(lng, 6) AS c_lng,
        round(CASE WHEN k % 5 <> 0 AND lat IS NOT NULL AND lng IS NOT NULL THEN lat END, 6) AS l_lat, round(CASE WHEN k % 5 <> 0 AND lat IS NOT NULL AND lng IS NOT NULL THEN lng END, 6) AS l_lng
        FROM (SELECT *, s IS NOT NULL AND lng IS NOT NULL AS ok FROM (SELECT *, coalesce(nullif(lat, 0), latitude) AS s FROM (SELECT c_custkey, c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN {_lat("c_custkey")} END AS lat,
        CASE WHEN c_custkey % 2 = 0 THEN {_lat("c_custkey")} END AS latitude, CASE WHEN c_custkey % 7 <> 0 THEN {_lng("c_custkey")} END AS lng FROM customer)))""",
    "haversine_pairs": f"SELECT s_suppkey, round({_km(_lat('s_suppkey'), _lng('s_suppkey'), _lat('n_nationkey'), _lng('n_nationkey'))}, 6) AS km FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "nearest_node": f"WITH {PLACES} SELECT id, node_id, round(km, 6) AS km FROM near",
    "resolve_node": f"WITH {PLACES} SELECT p.id AS key, coalesce(n.node_id, near.node_id) AS node_id FROM p LEFT JOIN n ON p.named = n.node_id JOIN near ON near.id = p.id",
    "relinked_points": f"WITH {PLACES} SELECT id, node_id AS nearest_routing_node_id, round_even(km * 1000, 0)::BIGINT AS distance_to_trail_m FROM near",
    "way_segments": f"WITH {SEGMENTS} SELECT way, seg, a, b FROM s",
    "undirected_dedup": f"WITH {SEGMENTS} SELECT least(a::VARCHAR, b::VARCHAR) AS lo, greatest(a::VARCHAR, b::VARCHAR) AS hi, way, seg FROM s QUALIFY row_number() OVER (PARTITION BY lo, hi ORDER BY way, seg) = 1",
    "full_map": FULL_MAP,
    "extract_map": FULL_MAP,
    "full_map_nodes": f"""WITH {SEGMENTS}, {KNOWN}, f AS (SELECT unnest([a, b]) AS k FROM s JOIN kn x ON x.k = a JOIN kn y ON y.k = b)
        SELECT 'node/' || k AS id, coalesce(name, 'Punkt ' || k) AS name, 'waypoint' AS type, round({_lat("k")}, 6) AS lat, 0.0::DOUBLE AS elevation FROM kn WHERE k IN (SELECT k FROM f)""",
    "walk_map": f"""WITH {SEGMENTS}, {KNOWN}, g AS (SELECT *, {_TRAIL_KM} * 1000 AS m, greatest(y.ele - x.ele, 0.0::DOUBLE) AS up FROM s JOIN kn x ON x.k = a JOIN kn y ON y.k = b WHERE way % 5 IN (0, 1, 3))
        SELECT way + 100000000 AS way, seg, 'node/' || a AS src, 'node/' || b AS dst, round_even(m / 1000, 3) AS km, round_even(m / 5000 * 60 + up / 600 * 60, 0)::BIGINT AS minutes, round_even(up, 0)::BIGINT AS elevation_gain_m, 'unknown' AS difficulty FROM g""",
    "walk_map_nodes": f"""WITH {KNOWN} SELECT 'node/' || k AS id, coalesce(nullif(name_pl, ''), nullif(name, ''), nullif(alt_name, ''), 'Punkt ' || k) AS name, coalesce(tourism, nullif("natural", ''), waterway, 'waypoint') AS type, round({_lng("k")}, 6) AS lng, ele AS elevation FROM kn""",
    "selected_elements": f"""WITH {WAYS}, {KNOWN}, t AS (SELECT DISTINCT way FROM w WHERE (way % 5 IN (0, 1, 3) AND way % 6 <> 0) OR way % 4 <> 0),
        pos AS (SELECT way, i, {_lat("k")} AS a_lat, {_lng("k")} AS a_lng FROM w JOIN kn USING (k) WHERE way IN (SELECT way FROM t)),
        ln AS (SELECT x.way, x.a_lat, x.a_lng, coalesce(y.a_lat, x.a_lat) AS b_lat, coalesce(y.a_lng, x.a_lng) AS b_lng FROM pos x LEFT JOIN pos y ON x.way = y.way AND y.i = x.i + 1),
        near AS (SELECT DISTINCT way FROM ln WHERE {_meets("a", "b", (49.20, 19.80, 49.22, 19.90))})
        SELECT 'way' AS type, way AS id FROM near UNION ALL SELECT 'node', k FROM kn WHERE k IN (SELECT k FROM w WHERE way IN (SELECT way FROM near))""",
    "built_points": f"""WITH {TAGS}, {PLACES}, p3 AS (SELECT *, CASE k % 5 WHEN 0 THEN [0] WHEN 1 THEN [0, 7, 20] WHEN 2 THEN [0, 7, 20, 0] WHEN 3 THEN [0, 3, 7, 20, 45, 0] ELSE [0, 7, 20, 0] END AS s1, CASE k % 5 WHEN 4 THEN [100, 130, 107, 100] ELSE [] END AS s2,
        CASE k % 5 WHEN 4 THEN [2, 9, 5, 2] ELSE [] END AS s3, k % 5 IN (2, 3) AND ("natural" IS NOT NULL OR tourism IS NOT NULL) OR k % 5 = 4 AS is_area FROM tg WHERE "natural" IN ('peak', 'saddle', 'water') OR tourism IS NOT NULL OR waterway IS NOT NULL),
        o AS (SELECT *, {", ".join(f"list_transform({s}, lambda x: {{'a': {_lat('k + x')} - {_lat('k')}, 'o': {_lng('k + x')} - {_lng('k')}}}) AS {n}" for s, n in (("s1", "r1"), ("s2", "r2"), ("s3", "hole")))} FROM p3),
        c AS (SELECT *, round_even({_lat("k")} + {_middle("a")}, 6) AS lat, round_even({_lng("k")} + {_middle("o")}, 6) AS lng FROM o WHERE coalesce(name_pl, name, alt_name) IS NOT NULL),
        d AS (SELECT c.*, node_id, {_km("c.lat", "c.lng", "nlat", "nlng")} AS km, ord FROM c, n QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(km, 9), ord) = 1)
        SELECT CASE WHEN k % 5 = 0 THEN 'node/' WHEN k % 5 = 4 THEN 'relation/' ELSE 'way/' END || k AS id, coalesce(name_pl, name, alt_name) AS name, coalesce("natural", tourism, waterway, 'poi') AS type, lat, lng, ele AS elevation, node_id AS nearest_routing_node_id, round_even(km * 1000, 0)::BIGINT AS distance_to_trail_m FROM d""",
    "bbox_tag_filter": f"""SELECT p_partkey, {_lat("p_partkey")} + 0.05 BETWEEN 49.15 AND 49.36 AND {_lng("p_partkey")} BETWEEN 19.70 AND 20.15 AND ((p_partkey % 5 IN (0, 1, 3) AND p_size % 4 NOT IN (0, 2)) OR p_partkey % 7 = 0) AS trail,
        p_partkey % 5 IN (0, 1, 3) AND p_size % 4 <> 2 AS walk FROM part""",
    "used_nodes": f"WITH {BUYING} SELECT 'c' || c_custkey AS id FROM customer WHERE 'c' || c_custkey IN (SELECT src FROM e UNION SELECT dst FROM e)",
    "isolated_nodes": "WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM o UNION SELECT o_orderkey % 3000 FROM o)",
    "graph_counts": "SELECT (SELECT count(*) FROM customer) AS n_nodes, (SELECT count(*) FROM orders) AS n_edges",
    "drawn_edges": f"WITH {BUYING}, c AS (SELECT 'c' || c_custkey AS id, round({_lat('c_custkey')}, 6) AS lat, round({_lng('c_custkey')}, 6) AS lng FROM customer) SELECT ord, src, dst, x.lat AS src_lat, x.lng AS src_lng, y.lat AS dst_lat, y.lng AS dst_lng FROM e JOIN c x ON x.id = src JOIN c y ON y.id = dst",
    "adjacency_degree": f"WITH {BUYING} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node",
    "route_points": f"""WITH {WAYS}, r AS (SELECT way, i, k::VARCHAR AS id, p_name AS name FROM w JOIN part ON p_partkey = k WHERE p_size > 5 UNION ALL SELECT o_orderkey, -1, 'a', 'end' FROM orders UNION ALL SELECT o_orderkey, 1000000, 'z', 'end' FROM orders),
        q AS (SELECT *, lag(id) OVER (PARTITION BY way ORDER BY i) AS before FROM r) SELECT way AS req_id, (row_number() OVER (PARTITION BY way ORDER BY i) - 1)::INT AS place, id, name FROM q WHERE before IS NULL OR before <> id""",
    "route_positions": f"""WITH {LINKS}, st AS (SELECT n_nationkey AS r, unnest([0, 1, 2]) AS hop, unnest([0, 1, 2]) AS x, unnest([1, 2, 7]) AS y FROM nation), hp AS (SELECT r, hop, (r + x) % 25 AS a, (r + y) % 25 AS b FROM st),
        j AS (SELECT hp.r, hop, hp.b AS next, drawn, pairs.a AS pa, pairs.b AS pb, pairs.src = 'n' || hp.b AS backwards FROM hp LEFT JOIN pairs ON lo = least('n' || hp.a, 'n' || hp.b) AND hi = greatest('n' || hp.a, 'n' || hp.b)),
        pos AS (SELECT r, -1 AS hop, 0 AS k, r AS key FROM hp WHERE hop = 0 UNION ALL SELECT r, hop, unnest([0, 1, 2]), unnest(CASE WHEN backwards THEN [pb, pa + pb, pa] ELSE [pa, pa + pb, pb] END) FROM j WHERE drawn UNION ALL SELECT r, hop, 0, next FROM j WHERE drawn IS NULL OR NOT drawn),
        ll AS (SELECT r, hop, k, {_lat("key")} AS lat, {_lng("key")} AS lng FROM pos), q AS (SELECT *, lag(lat) OVER t AS blat, lag(lng) OVER t AS blng FROM ll WINDOW t AS (PARTITION BY r ORDER BY hop, k))
        SELECT r AS req_id, (row_number() OVER (PARTITION BY r ORDER BY hop, k) - 1)::INT AS place, round(lat, 6) AS lat, round(lng, 6) AS lng FROM q WHERE blat IS NULL OR blat <> lat OR blng <> lng""",
    "consecutive_runs": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type",
    "characteristic_points": "SELECT user_id, event_id, name FROM (SELECT user_id, event_id, ts, event_type || ' ' || floor(value / 20)::BIGINT AS name FROM events WHERE event_type NOT IN ('view', 'click')) QUALIFY row_number() OVER (PARTITION BY user_id, name ORDER BY ts, event_id) = 1",
    "path_points": "SELECT l_orderkey AS req_id, l_linenumber AS place, l_partkey AS id, coalesce(s_name, p_name) AS name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_partkey LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey WHERE coalesce(s_name, p_name) IS NOT NULL",
    "unique_points": f"WITH {POINTS} SELECT id, name, first AS ord FROM u WHERE r = 1",
    "search_points": f"WITH {POINTS} SELECT id, name, type FROM u WHERE r = 1 AND (contains(lower(name), 'red') OR contains(lower(id), 'red') OR contains(lower(type), 'red')) ORDER BY name, first LIMIT 8",
    "route_status": f"WITH {BUYING}, c AS (SELECT 'c' || c_custkey AS id FROM customer) SELECT ord AS req_id, (CASE WHEN ord % 11 = 0 OR src = dst THEN 400 WHEN src NOT IN (SELECT id FROM c) OR dst NOT IN (SELECT id FROM c) THEN 404 ELSE 200 END)::INT AS code FROM e",
    "route_reasons": f"""WITH {BUYING}, c AS (SELECT 'c' || c_custkey AS id FROM customer), r AS (SELECT ord AS req_id, CASE WHEN ord % 11 = 0 THEN 'missing' WHEN src = dst THEN 'equal' WHEN src NOT IN (SELECT id FROM c) OR dst NOT IN (SELECT id FROM c) THEN 'unknown'
        WHEN ord % 3 = 0 THEN 'unmatched' WHEN ord % 5 = 0 THEN 'unreachable' ELSE 'ok' END AS reason FROM e) SELECT req_id, CASE WHEN reason IN ('missing', 'equal') THEN 400 WHEN reason = 'ok' THEN 200 ELSE 404 END::INT AS code, reason FROM r""",
    "route_ends": """SELECT l_orderkey, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) FILTER (l_discount > 0.05) AS "first", arg_max(l_partkey, l_linenumber * 100000000 + l_partkey) FILTER (l_discount > 0.05) AS "last" FROM lineitem GROUP BY l_orderkey""",
    "form_checks": "SELECT c_custkey, c_custkey % 4 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 9 >= 6 AS registration, c_custkey % 5 <> 0 AND c_custkey % 6 <> 0 AS favourite FROM customer",
    "favourite_rows": """SELECT l_orderkey AS user_id, '["' || string_agg(l_partkey::VARCHAR, '","' ORDER BY l_linenumber, l_partkey) || '"]' AS path FROM lineitem GROUP BY l_orderkey""",
    "response_positions": f"""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN [c_custkey + 5, c_custkey + 6] ELSE [c_custkey, c_custkey + 1, c_custkey + 2] END AS ks FROM customer), x AS (SELECT c_custkey, unnest([y FOR y IN ks IF y % 9 > 1]) AS k FROM r)
        SELECT c_custkey, (row_number() OVER (PARTITION BY c_custkey ORDER BY k) - 1)::INT AS place, round({_lat("k")}, 6) AS lat, round({_lng("k")}, 6) AS lng FROM x""",
    "client_points": """SELECT k::VARCHAR AS id, name, lat, lng FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_name WHEN c_custkey % 6 = 0 THEN c_mktsegment ELSE c_custkey::VARCHAR END AS name,
        CASE c_custkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN c_custkey / 8.0 END::DOUBLE AS lat, (c_custkey / 16.0)::DOUBLE AS lng FROM customer) WHERE k % 10 <> 0 AND lat IS NOT NULL""",
    "map_scan": "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, n_name AS name, (n_nationkey / 4.0)::DOUBLE AS lat, CASE WHEN n_nationkey % 2 = 0 THEN 'unknown' ELSE n_nationkey::VARCHAR END AS difficulty, (n_nationkey / 2.0)::DOUBLE AS \"first\" FROM nation",
    "unique_insert": "SELECT 4 + row_number() OVER (ORDER BY ord) AS id, email, ord FROM (SELECT c_custkey AS ord, c_mktsegment || '@' || c_nationkey AS email FROM customer QUALIFY row_number() OVER (PARTITION BY email ORDER BY c_custkey) = 1) WHERE email NOT IN (SELECT 'BUILDING@' || n_nationkey FROM nation WHERE n_nationkey < 5)",
    "verified_logins": "SELECT o_orderkey, c_custkey AS user_id, coalesce(o_orderstatus <> 'F' AND c_custkey IS NOT NULL, false) AS ok FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2",
    "favorites_by_user": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS route_name, o_totalprice AS distance_km, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC",
    "profile_upsert": f"WITH {PROFILES} SELECT * FROM pr",
    "profile_merge": f"WITH {PROFILES} SELECT * FROM pr",
    "replayed_inserts": """SELECT (b::BIGINT << 40) + row_number() OVER (PARTITION BY b ORDER BY ord) AS id, email, ord
        FROM (SELECT c_custkey AS ord, c_mktsegment || '@' || c_nationkey AS email, c_custkey % 4 AS b FROM customer QUALIFY row_number() OVER (PARTITION BY email ORDER BY b, ord) = 1)""",
    "search_batch": f"""WITH {POINTS}, q AS (SELECT p_partkey AS q_id, strip_accents(lower(trim(substr(p_name, p_partkey % 7 + 1, p_partkey % 6 + 1)))) AS q FROM part)
        SELECT q_id, place, id, name, type FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY name, first)::INTEGER AS place FROM q JOIN u ON r = 1 AND q <> '' AND (contains(strip_accents(lower(name)), q) OR contains(id, q) OR contains(strip_accents(lower(type)), q))) WHERE place <= 8""",
    "profile_view": f"WITH {PROFILES} SELECT c_custkey AS user_id, height_cm, coalesce(experience_level, '') AS experience_level, coalesce(route_preference, '') AS route_preference FROM customer LEFT JOIN pr ON user_id = c_custkey",
    "orphan_rows": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier)",
    "normalize_collection": """SELECT n_nationkey, x.ord::BIGINT AS ord, x.id AS id, n_name AS name, n_nationkey::DOUBLE AS lat FROM (SELECT *, unnest(CASE n_nationkey % 5 WHEN 0 THEN [{'ord': 0, 'id': 'own'}, {'ord': 1, 'id': NULL}] WHEN 1 THEN [{'ord': 0, 'id': 'own'}]
        WHEN 2 THEN [{'ord': 0, 'id': 'k'}, {'ord': 1, 'id': 'own'}] WHEN 3 THEN [{'ord': 0, 'id': 'k'}] ELSE [] END) AS x FROM nation)""",
}
