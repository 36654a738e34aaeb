"""Routes over graphs with long chains, rings, parallel edges and weights of zero, against a plain search."""

from __future__ import annotations

import heapq
import random

from pyspark.sql import functions as F

from ridgeline.operators import contraction, graph, routing

EDGES = "src string, dst string, distance_km string, time_min string, elevation_gain_m string, difficulty string, ord bigint"


def plain_route(edges, start, end, weight):
    """The path under one weight by a queue, or None."""
    around = {}
    for a, b, *_ in edges:
        if a and b:
            around.setdefault(a, []), around.setdefault(b, [])
    for e in edges:
        if e[0] and e[1]:
            around[e[0]].append((e[1], weight(e)))
            around[e[1]].append((e[0], weight(e)))
    if start not in around or end not in around:
        return None
    d, back, queue = {start: 0.0}, {}, [(0.0, start)]
    while queue:
        here, node = heapq.heappop(queue)
        if node == end:
            break
        if here > d[node]:
            continue
        for other, w in around[node]:
            if here + w < d.get(other, float("inf")):
                d[other], back[other] = here + w, node
                heapq.heappush(queue, (here + w, other))
    if end not in d:
        return None
    path = [end]
    while path[-1] != start:
        path.append(back[path[-1]])
    return path[::-1], d[end]


def random_edges(seed):
    """Crossings joined by chains of up to 40 places, a ring apart, a second part, dead ends."""
    rng, edges, n = random.Random(seed), [], [0]

    def link(a, b):
        edges.append((a, b, str(rng.randint(1, 12) / 2), str(rng.randint(1, 30)), "10", str(rng.randint(1, 6)), len(edges)))

    def chain(a, b, size):
        inside = [f"c{n[0] + k:04d}" for k in range(size)]
        n[0] += size
        for x, y in zip([a, *inside], [*inside, b]):
            link(x, y) if rng.random() < 0.5 else link(y, x)

    crossings = [f"x{k:02d}" for k in range(12)]
    for _ in range(26):
        chain(*rng.sample(crossings, 2), rng.choice((0, 0, 1, 2, 5, 17, 40)))
    chain("x00", "x00", 6)  # a loop at a crossing
    chain("r0", "r0", 9)  # a ring alone, r0 no crossing of it
    chain("y0", "y1", 30)
    chain("x03", "dead", 12)
    link("x01", "x01")
    edges.append(("", "x01", "1", "1", "1", "1", len(edges)))
    return edges


def test_routes_over_chains(spark):
    edges = random_edges(5)
    frame = spark.createDataFrame(edges, EDGES).repartition(3)
    rng = random.Random(8)
    places = sorted({p for e in edges for p in e[:2] if p})
    requests = [(i, *rng.sample(places, 2), rng.choice(("time", "distance", "difficulty"))) for i in range(14)] + [(20, "y0", "y1", "time"), (21, "x00", "y1", "time"), (22, "x00", "nowhere", None), (23, "x02", "x02", "time"), (24, "r0", "c0000", "time"), (25, "x03", "dead", "odd")]
    weight = {"time": lambda e: float(e[3]), "distance": lambda e: float(e[2]), "difficulty": lambda e: float(e[5]) * 100 + float(e[4]) + float(e[3]) + float(e[2]) * 10}
    asked = spark.createDataFrame(requests, "req_id bigint, start string, end string, criterion string")
    labels = graph.components(frame)
    for known in (None, labels):
        got = {r.req_id: r for r in routing.solve(asked, frame, known).collect()}
        assert len(got) == len(requests)
        for i, start, end, kind in requests:
            want = plain_route(edges, start, end, weight.get(kind, weight["time"]))
            if want is None:
                assert got[i].status == "no route" and got[i].path is None, i
            else:
                assert got[i].status == "ok" and got[i].route_weight == want[1], i
                along = lambda p, k=kind: [min(weight.get(k, weight["time"])(e) for e in edges if {a, b} == set(e[:2])) for a, b in zip(p, p[1:])]
                assert sum(along(got[i].path)) == want[1] and (got[i].path[0], got[i].path[-1]) == (start, end), i
                assert got[i].path == want[0], i


def test_ties_through_chains(spark):
    """Of two best ways the one whose last place before their meeting is nearer, then smaller by name, as without chains."""
    rows = [("a", "m1"), ("m1", "m2"), ("m2", "z"), ("a", "k1"), ("k1", "k2"), ("k2", "z"), ("z", "t"), ("a", "l1"), ("l1", "z")]
    for seed, times in enumerate(((1, 2, 3, 1, 2, 3, 1, 2, 4), (2, 2, 2, 3, 2, 1, 1, 5, 1), (1, 1, 4, 2, 2, 2, 5, 3, 3))):
        edges = [(a, b, "1", str(t), "0", "1", i) for i, ((a, b), t) in enumerate(zip(rows, times))]
        frame = spark.createDataFrame(edges, EDGES)
        got = routing.solve(spark.createDataFrame([(1, "a", "t", "time")], "req_id bigint, start string, end string, criterion string"), frame).first()
        want = plain_route(edges, "a", "t", lambda e: float(e[3]))
        assert (got.path, got.route_weight) == want, seed


def test_rounds_follow_crossings(spark, monkeypatch):
    """A trail of 400 places between two crossings is one arc, and its path is read back whole."""
    places = [f"p{k:03d}" for k in range(400)]
    pairs = list(zip(places, places[1:])) + [("p000", "q1"), ("p000", "q2"), ("p399", "q3"), ("p399", "q4")]
    frame = spark.createDataFrame([(a, b, "1", "1", "0", "1", i) for i, (a, b) in enumerate(pairs)], EDGES)
    arcs = graph.weighted_arcs(frame)
    short, members = contraction.contracted(arcs, spark.createDataFrame([("q1",), ("q4",)], "node string"))
    assert short.filter("criterion = 'time'").count() == 10 and short.agg(F.max("hops")).first()[0] == 399
    assert members.filter("criterion = 'time'").count() == 2 * 399
    rounds, settle = [], routing.settled
    monkeypatch.setattr(routing, "settled", lambda df, name: rounds.append(name) or settle(df, name))
    got = routing.solve(spark.createDataFrame([(1, "q1", "q4", "time"), (2, "q1", "q4", "time")], "req_id bigint, start string, end string, criterion string"), frame)
    assert all(r.path == ["q1", *places, "q4"] and r.route_weight == 401.0 for r in got.collect())
    assert rounds.count("distances") <= 6 and rounds.count("strides") <= 3


def test_components(spark):
    edges = random_edges(6)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, *_ in edges:
        if a and b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    frame = spark.createDataFrame(edges, EDGES)
    assert {r.node: r.label for r in graph.components(frame).collect()} == {x: root(x) for x in parent}
    assert graph.components(frame.limit(0)).count() == 0


def test_search_from_both_ends(spark, monkeypatch):
    """A route across a large graph needs few of its nodes, and none is looked for on when one end has nothing more to reach."""
    rng, size = random.Random(4), 1500
    pairs = sorted({(k // by, k) for k in range(1, size) for by in (2, 3)} | {("z", "y"), ("y", "v"), ("v", "z")}, key=str)
    edges = [(f"t{a}", f"t{b}", "1", str(rng.randint(5, 27)), "0", "1", i) for i, (a, b) in enumerate(pairs)]
    frame = spark.createDataFrame(edges, EDGES)
    written, settle = [], routing.settled

    def kept(df, name):
        out = settle(df, name)
        written.append(out.count() if name in ("distances", "known") else 0)
        return out

    monkeypatch.setattr(routing, "settled", kept)
    asked = [(1, "t1", "t1499", "time"), (2, "t3", "t1498", "time"), (3, "t0", "tz", "time"), (4, "ty", "t700", "time")]
    got = {r.req_id: r for r in routing.solve(spark.createDataFrame(asked, "req_id bigint, start string, end string, criterion string"), frame).collect()}
    for i, start, end, _ in asked[:2]:
        path, weight = plain_route(edges, start, end, lambda e: float(e[3]))
        assert (got[i].path, got[i].route_weight) == (path, weight)
    assert got[3].status == got[4].status == "no route"
    assert sum(written) < size


def test_parts_of_requests(spark):
    """Requests between two components leave the search, as with labels of the whole graph; chains may have arcs that one criterion can't use."""
    edges = random_edges(7)
    asked = [(1, "y0", "y1", "time"), (2, "x00", "y1", "time"), (3, "x00", "x05", "distance"), (4, "r0", "r0", "time"), (5, "x02", "none", "time"), (6, "c0000", "c0003", "time")]
    frame, requests = spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, "req_id bigint, start string, end string, criterion string")
    arcs = graph.both_ways(graph.pair_weights(frame))
    labels = graph.components(frame)
    assert {r.req_id for r in graph.linked(requests, arcs).collect()} == {r.req_id for r in graph.together(requests, labels).collect()}
    assert graph.linked(requests, arcs.limit(0)).filter("start <> end").isEmpty()
    columns = ["req_id", "status", "path", "route_weight", "total_time_min"]
    one, two = (sorted(map(tuple, x.select(columns).collect())) for x in (routing.solve(requests, frame, labels), routing.solve(requests, frame, parts=True)))
    assert one == two
    rows = [("a", "b", "1"), ("b", "c", "-1"), ("c", "d", "1"), ("a", "d", "9"), ("a", "q", "1"), ("d", "p", "1")]
    broken = spark.createDataFrame([(a, b, "1" if b != "d" or a == "c" else "7", t, "0", "1", i) for i, (a, b, t) in enumerate(rows)], EDGES)
    got = routing.solve(spark.createDataFrame([(1, "q", "p", "time"), (2, "q", "p", "distance")], "req_id bigint, start string, end string, criterion string"), broken, parts=True)
    assert {r.req_id: r.path for r in got.collect()} == {1: ["q", "a", "d", "p"], 2: ["q", "a", "b", "c", "d", "p"]}
