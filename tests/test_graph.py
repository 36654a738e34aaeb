"""Routing, nearest nodes and assembly on an invented graph with ties, parallel edges, a loop and isolated nodes."""

from __future__ import annotations

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import assembly, graph, nearest, routing

EDGES = [
    ("n1", "n2", "2.0", "30", "100", "1"), ("n2", "n3", "1.5", "25", "unknown", "2"), ("n1", "n4", "1.0", "40", "300", "unknown"), ("n4", "n3", "1.0", "15", "0", "3"), ("n3", "n5", "2.5", "50", "250", "4"),
    ("n5", "n3", "2.0", "35", "400", "5"), ("n3", "n6", "0.5", "10", " 20 ", None), ("n6", "n6", "0.1", "1", "0", "1"), ("", "n1", "9", "9", "9", "9"), ("n7", "n8", "1.0", "15", "10", "1"),
]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(*e, None, i) for i, e in enumerate(EDGES)]
    return spark.createDataFrame(rows, "src string, dst string, distance_km string, time_min string, elevation_gain_m string, difficulty string, geometry array<array<double>>, ord bigint")


def test_routes(spark, edges):
    asked = [(1, "n1", "n5", "time"), (2, "n1", "n5", "distance"), (3, "n1", "n5", "elevation"), (4, "n1", "n5", "difficulty"), (5, "n1", "n5", None), (6, "n1", "n7", "time"), (7, "n1", "n9", "time"), (8, "n1", "n1", "time"), (9, "n2", "n6", "time"), (10, "n1", "n5", "odd")]
    rows = {r.req_id: r for r in routing.solve(spark.createDataFrame(asked, "req_id bigint, start string, end string, criterion string"), edges).collect()}
    got = lambda i: (rows[i].path, rows[i].route_weight, rows[i].total_distance_km, rows[i].total_time_min, rows[i].total_elevation_gain_m, rows[i].total_difficulty)
    assert got(1) == (["n1", "n2", "n3", "n5"], 90.0, 6.0, 105, 350, 7.0)
    assert got(2) == (["n1", "n4", "n3", "n5"], 4.0, 4.5, 105, 550, 7.0)
    assert got(3) == (["n1", "n2", "n3", "n5"], 410.0, 6.0, 105, 350, 7.0)
    assert got(4) == (["n1", "n2", "n3", "n5"], 1215.0, 6.0, 105, 350, 7.0)
    assert got(5) == got(1) == got(10)
    assert [rows[i].status for i in (6, 7)] == ["no route", "no route"]
    assert (rows[8].path, rows[8].route_weight) == (["n1"], 0.0)
    assert (rows[9].path, rows[9].route_weight) == (["n2", "n3", "n6"], 35.0)


def test_routes_at_random(spark):
    rng = random.Random(5)
    nodes = [f"v{i}" for i in range(14)]
    rows = [(rng.choice(nodes), rng.choice(nodes), "1", str(rng.randint(1, 4)), "0", "1", i) for i in range(30)]
    edges = spark.createDataFrame(rows, "src string, dst string, distance_km string, time_min string, elevation_gain_m string, difficulty string, ord bigint")
    near: dict[str, list[tuple[str, int]]] = {}
    for a, b, _, w, *_ in rows:
        near.setdefault(a, []).append((b, int(w)))
        near.setdefault(b, []).append((a, int(w)))
    want = {}
    for s in sorted(near):
        dist, before, heap = {s: 0}, {}, [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            for v, w in near[u] if d == dist[u] else ():
                if d + w < dist.get(v, math.inf):
                    dist[v], before[v] = d + w, u
                    heapq.heappush(heap, (d + w, v))
        for t in dist:
            path = [t]
            while path[-1] != s:
                path.append(before[path[-1]])
            want[s, t] = (float(dist[t]), path[::-1])
    asked = [(i, a, b, "time") for i, (a, b) in enumerate((a, b) for a in nodes[:6] for b in nodes)]
    got = routing.solve(spark.createDataFrame(asked, "req_id bigint, start string, end string, criterion string"), edges.withColumn("geometry", F.lit(None).cast("array<array<double>>"))).collect()
    for r in got:
        assert ((r.route_weight, r.path) if r.path else None) == want.get((r.start, r.end))


def test_nearest_is_exact(spark):
    rng = random.Random(3)
    spots = [(f"s{i}", rng.uniform(-80, 80), rng.uniform(-180, 180), i) for i in range(40)] + [("twin", 10.0, 10.0, 90), ("late", 10.0, 10.0, 91)]
    asked = [(f"p{i}", rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(60)] + [("q", 10.0, 10.0), ("none", None, 1.0), ("west", 0.0, -179.9)]
    got = {r.id: r.node_id for r in nearest.nearest(spark.createDataFrame(asked, "id string, lat double, lng double"), spark.createDataFrame(spots, "id string, lat double, lng double, ord bigint")).collect()}

    def km(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    assert "none" not in got
    for i, lat, lng in asked:
        if lat is not None:
            assert got[i] == min((km(lat, lng, a, b), n, s) for s, a, b, n in spots)[2]
    empty = nearest.nearest(spark.createDataFrame(asked, "id string, lat double, lng double"), spark.createDataFrame([], "id string, lat double, lng double, ord bigint"))
    assert {r.node_id for r in empty.collect()} == {None}


def test_runs_and_points(spark, edges):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", "b", None, None, "a"])], "g int, i int, id string")
    assert [r.id for r in assembly.without_repeats(rows, "g", "i", F.col("id")).orderBy("i").collect()] == ["a", "b", None, "a"]
    nodes = spark.createDataFrame([(f"n{i}", "", "", 0.0, 0.0, 0.0, i) for i in range(1, 10)], "id string, name string, type string, lat double, lng double, elevation double, ord bigint")
    assert sorted(r.id for r in graph.isolated_nodes(nodes, edges).collect()) == ["n9"]
    assert graph.graph_counts(nodes, edges).first().asDict() == {"n_nodes": 9, "n_edges": 10}
    assert graph.adjacency(edges).filter("node = 'n6'").count() == 3
