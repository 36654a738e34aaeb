"""Shortest paths for a batch of requests, by rounds of relaxation over the whole batch, from both ends of every request.

requests: (req_id, start, end, criterion). Chains of nodes with two neighbours are arcs of their own first, so rounds follow
the crossings of a graph, not its nodes. Every round, of two steps, leaves the nodes of an end that were not left yet at their
distance, and writes what it reaches as one more table; tables are put together every few rounds. The end with far more to
leave waits. Nodes nearer than the nearest one to be left have their least distance, so a node is not left any more if its
distance and that of the other end's nearest one exceed the best meeting; a request of which one end has nothing more to leave
is done, without a route if the ends have not met. Then distances go on from the start's side into the end's, but only to
nodes on best ways, so that all are sums from the start on. Paths are read back from tight arcs by doubling: the predecessor
of a node is the tight one with the least (distance, id); where arcs of weight 0 leave no farther-back choice, the one with
fewest hops.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import CRITERIA, as_number, criterion_or_time, whole
from ..sources.scratch import finished, fits, mark, settled, small
from .contraction import shortened, weights_in
from .graph import canonical, edges_between, linked, pair_weights, real_edges, together

#: Tables of distances between two that hold all; an end waits that has more than so many times, and so many more, nodes to leave.
TABLES, TIMES, MORE = 8, 4, 64
#: Two distances that are added up in another order than a path's may be larger by this.
SLACK = 1 + 1e-9
#: Whether a node is to be left: it and the nearest of the other end are not beyond the best.
GOES_ON = f"best is null or d + other <= best * {SLACK!r}D"


def _least(rows: DataFrame, *rest: str) -> DataFrame:
    """The least (d, hops) of every request, end and node, ``fresh`` if it was not left yet; the other columns depend on these."""
    least = rows.groupBy("req_id", "ahead", "node").agg(F.min(F.struct("d", "hops", "fresh")).alias("x"), *[F.first(c).alias(c) for c in ("criterion", *rest)])
    return least.select("req_id", "ahead", "node", "x.d", "x.hops", "x.fresh", "criterion", *rest)


def _of_criterion(name: str, arcs: DataFrame) -> Column:
    """The column ``name`` of the row's criterion."""
    return F.coalesce(*[F.when(F.col("criterion") == k, F.col(f"{name}_{k}")) for k in weights_in(arcs)])


def _relaxed(start: DataFrame, arcs: DataFrame, left: DataFrame | None) -> DataFrame:
    """The least distances one arc on from ``start`` that are not beyond the best; with ``left`` (req_id, node, left) only those on best ways."""
    met = start.join(arcs.select("node", "neighbour", F.col("hops").alias("more"), *[f"w_{k}" for k in weights_in(arcs)]), "node")
    met = met.select("req_id", "ahead", F.col("neighbour").alias("node"), (F.col("d") + _of_criterion("w", arcs)).alias("d"), (F.col("hops") + F.col("more")).alias("hops"), F.lit(True).alias("fresh"), "criterion", "best", "other")
    met = met.withColumn("left", F.lit(0.0)) if left is None else met.join(left, ["req_id", "node"])
    return _least(met.filter("d is not null").filter(f"best is null or d + left <= best * {SLACK!r}D"), "best", "other")


def _search(tables: list[DataFrame], arcs: DataFrame, chosen: Callable[[DataFrame], DataFrame], left: DataFrame | None = None) -> DataFrame:
    """All distances from those of ``tables`` on (req_id, ahead, node, d, hops, fresh, criterion), by rounds until ``chosen`` gives none of them to be left (with best and other)."""
    columns = tables[0].columns
    while True:
        known = _least(reduce(DataFrame.unionByName, tables))
        start = settled(chosen(known), "front")
        if start.isEmpty():
            return known
        one = settled(_relaxed(small(start), arcs, left), "steps")
        on = one.filter(GOES_ON)
        two = _relaxed(F.broadcast(on) if fits(one) else on, arcs, left)
        reached = settled(_least(one.withColumn("fresh", ~F.expr(GOES_ON)).unionByName(two)), "distances")
        tables = [*tables, start.withColumn("fresh", F.lit(False)).select(*columns), reached]
        if len(tables) > TABLES:
            tables = [settled(_least(reduce(DataFrame.unionByName, tables)), "distances")]


def _ends(known: DataFrame) -> DataFrame:
    """(req_id, ahead, best, own, n, other, others): the least distance over both ends; of an end and the other one the distance of the nearest node to be left, and how many there are."""
    d = lambda when: F.min(F.when(F.expr(when), F.col("d")))
    nodes = known.groupBy("req_id", "node").agg((d("ahead") + d("not ahead")).alias("d"), d("ahead and fresh").alias("a"), d("not ahead and fresh").alias("b"))
    met = nodes.groupBy("req_id").agg(F.min("d").alias("best"), *[f(c).alias(f"{x}_{c}") for c in "ab" for x, f in (("d", F.min), ("n", F.count))])
    side = lambda ahead, own, other: F.struct(F.lit(ahead).alias("ahead"), F.col(f"d_{own}").alias("own"), F.col(f"n_{own}").alias("n"), F.col(f"d_{other}").alias("other"), F.col(f"n_{other}").alias("others"))
    return met.select("req_id", "best", F.inline(F.array(side(True, "a", "b"), side(False, "b", "a"))))


def _both_sides(asked: DataFrame, arcs: DataFrame) -> DataFrame:
    """(req_id, ahead, node, d, hops, criterion, best): distances from the start (ahead) and from the end of the requests that have a route; a node of a best way has one of the two."""
    ends = F.array(F.struct(F.lit(True).alias("ahead"), F.col("start").alias("node")), F.struct(F.lit(False).alias("ahead"), F.col("end").alias("node")))
    both = settled(asked.select("req_id", "criterion", F.inline(ends)), "ends")
    real = arcs.select("node").join(small(both.select("node").distinct()), "node", "left_semi").distinct()
    first = settled(both.join(real, "node").select("req_id", "ahead", "node", F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("fresh"), "criterion"), "distances")

    def chosen(known: DataFrame) -> DataFrame:
        start = known.filter("fresh").join(_ends(known), ["req_id", "ahead"]).filter("other is not null").filter(GOES_ON)
        return start.filter(f"n <= {TIMES} * others + {MORE}").drop("own", "n", "others")

    known = _search([first], arcs, chosen)
    sure = known.join(_ends(known), ["req_id", "ahead"]).filter(f"d <= best * {SLACK!r}D and (own is null or d < own)")
    return sure.select("req_id", "ahead", "node", "d", "hops", "criterion", "best")


def distances(requests: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, arcs): from each request's start that has a route, the distances (req_id, node, d, hops) that its paths need, and the arcs between their nodes."""
    asked = settled(requests.select("req_id", "start", "end", criterion_or_time(F.col("criterion")).alias("criterion")), "requests")
    sides = settled(_both_sides(asked, arcs), "sides")
    nodes = small(settled(sides.select("node").distinct(), "nodes"))
    arcs = settled(arcs.join(nodes, "node", "left_semi").join(nodes.withColumnRenamed("node", "neighbour"), "neighbour", "left_semi"), "arcs")
    left = small(settled(sides.filter("not ahead").select("req_id", "node", F.col("d").alias("left")), "left"))
    best = small(settled(sides.groupBy("req_id").agg(F.first("best").alias("best")), "best"))
    first = settled(sides.filter("ahead").select("req_id", "ahead", "node", "d", "hops", F.lit(True).alias("fresh"), "criterion"), "front")
    known = _search([first], arcs, lambda known: known.filter("fresh").join(best, "req_id").withColumn("other", F.lit(0.0)), left)
    return settled(known.select("req_id", "node", "d", "hops"), "known"), arcs


def predecessors(requests: DataFrame, known: DataFrame, arcs: DataFrame) -> DataFrame:
    """(req_id, node, back, via): the arc by which a node is best reached, as its begin and the second node of a chain."""
    asked = requests.select("req_id", criterion_or_time(F.col("criterion")).alias("criterion"))
    known = small(known)
    v = known.join(asked, "req_id").select("req_id", "criterion", F.col("node").alias("neighbour"), F.col("d").alias("dv"), F.col("hops").alias("hv"))
    v = F.broadcast(v) if fits(known) else v
    u = known.select("req_id", "node", F.col("d").alias("du"), F.col("hops").alias("hu"))
    met = v.join(arcs, "neighbour").withColumns({"w": _of_criterion("w", arcs), "before": _of_criterion("before", arcs)})
    tight = met.join(u, ["req_id", "node"]).filter("du + w = dv and (du + before < dv or hu + hops - 1 < hv)")
    before = F.col("du") + F.col("before")
    order = F.struct(before.alias("d"), F.when(before < F.col("dv"), 0).otherwise(F.col("hu") + F.col("hops") - 1).alias("hops"), "last", F.col("node").alias("back"), "via")
    return tight.groupBy("req_id", F.col("neighbour").alias("node")).agg(F.min(order).alias("x")).select("req_id", "node", "x.back", "x.via")


def paths(requests: DataFrame, known: DataFrame, arcs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(req_id, path) of the requests whose target was reached.

    Every node's ancestor 1, 2, 4, ... steps back is found by doubling; from the target, the places that these strides
    lead to are those of the whole path. ``members`` are the chains that arcs stand for.
    """
    before = settled(predecessors(requests, known, arcs), "predecessors")
    strides = [before.select("req_id", "node", F.col("back").alias("far"))]
    while True:
        one = strides[-1]
        far = settled(one.join(one.select("req_id", F.col("node").alias("far"), F.col("far").alias("farther")), ["req_id", "far"]).select("req_id", "node", F.col("farther").alias("far")), "strides")
        if far.isEmpty():
            break
        strides.append(far)
    reached = requests.select("req_id", F.col("end").alias("node")).join(known.select("req_id", "node"), ["req_id", "node"], "left_semi")
    walk = reached.select("req_id", "node", F.lit(0).cast("long").alias("place"))
    for k in range(len(strides) - 1, -1, -1):
        here, there = F.struct("node", "place"), F.struct(F.col("far").alias("node"), (F.col("place") + (1 << k)).alias("place"))
        both = F.when(F.col("far").isNull(), F.array(here)).otherwise(F.array(here, there))
        walk = walk.join(strides[k], ["req_id", "node"], "left").select("req_id", F.inline(both))
    # from here on along the path: the arc that leads to each place, and what it stands for
    walk = walk.join(before, ["req_id", "node"], "left").select("req_id", "node", (-F.col("place")).alias("place"), "back", "via")
    nodes = walk.select("req_id", "place", F.lit(None).cast("long").alias("rank"), "node")
    if members is not None:
        chains = small(settled(walk.filter("via is not null").select("req_id", "place", F.col("back").alias("first_t"), F.col("via").alias("first_h")), "walked"))
        inside = members.join(chains, ["first_t", "first_h"]).select("req_id", "place", "rank", F.col("t").alias("node"))
        nodes = nodes.unionByName(inside)
    # a place's chain comes before its node
    ordered = F.sort_array(F.collect_list(F.struct("place", F.coalesce("rank", F.lit(1 << 62)).alias("rank"), "node")))
    return nodes.groupBy("req_id").agg(F.transform(ordered, lambda x: x["node"]).alias("path"))


def hops_of(routes: DataFrame) -> DataFrame:
    """(req_id, hop, a, b): consecutive nodes of every path."""
    pairs = F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("a"), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))).alias("b"))
    return routes.select("req_id", F.posexplode(pairs).alias("hop", "x")).select("req_id", "hop", "x.a", "x.b")


def totals(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sums of the measures along every path (req_id, path), each pair by its first edge in the file; difficulty defaults to 0."""
    measures = {"total_distance_km": "distance_km", "total_time_min": "time_min", "total_elevation_gain_m": "elevation_gain_m", "total_difficulty": "difficulty"}
    hops = settled(hops_of(routes), "hops")
    walked = small(hops.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    found = edges_between(hops, canonical(edges).join(walked, ["lo", "hi"], "left_semi").select(*edges.columns))
    sums = found.groupBy("req_id").agg(*[F.sum(F.when(F.col("e_src").isNotNull(), as_number(F.col(f"e_{c}"), 0)).otherwise(0.0)).alias(t) for t, c in measures.items()])
    out = routes.select("req_id").join(sums, "req_id", "left").fillna(0.0)
    return out.select("req_id", F.bround("total_distance_km", 2).alias("total_distance_km"), whole(F.col("total_time_min")).alias("total_time_min"), whole(F.col("total_elevation_gain_m")).alias("total_elevation_gain_m"), F.bround("total_difficulty", 2).alias("total_difficulty"))


def solve(requests: DataFrame, edges: DataFrame, labels: DataFrame | None = None, parts: bool = False) -> DataFrame:
    """The answer to every request: status, path, route_weight, totals and the criterion as it was asked for.

    A request has no route when an endpoint has no edge or can't be reached. With ``labels`` (node, label) of the graph's
    components, as ``graph.components`` makes them once a map, requests between two components never enter the rounds; with
    ``parts`` these are found here, over the crossings and endpoints only.
    """
    began = mark()
    kinds = [r[0] for r in requests.select(criterion_or_time(F.col("criterion"))).distinct().collect()]  # four criteria at most
    pairs = settled(pair_weights(edges, kinds or CRITERIA), "pairs")
    able = requests if labels is None else together(requests, labels)
    arcs, members = shortened(pairs, able.select(F.explode(F.array("start", "end")).alias("node")))
    if parts:
        able = settled(linked(able, arcs), "able")
    known, arcs = distances(able, arcs)
    itself = settled(requests.filter("start = end").select("req_id", "start"), "itself")
    lone = real_edges(edges).select(F.explode(F.array("src", "dst")).alias("start")).join(small(itself.select("start").distinct()), "start", "left_semi").distinct()
    same = itself.join(lone, "start").select("req_id", F.array("start").alias("path"))
    found = paths(able.filter("start <> end"), known, arcs, members).unionByName(same)
    found = settled(found, "paths")
    weight = requests.join(known.select("req_id", F.col("node").alias("end"), F.bround("d", 2).alias("route_weight")), ["req_id", "end"]).select("req_id", "route_weight")
    out = requests.join(found, "req_id", "left").join(weight, "req_id", "left").join(totals(found, edges), "req_id", "left")
    status = F.when(F.col("path").isNotNull(), "ok").otherwise("no route")
    out = out.select("req_id", "start", "end", "criterion", status.alias("status"), "path", F.when(F.size("path") == 1, F.coalesce("route_weight", F.lit(0.0))).otherwise(F.col("route_weight")).alias("route_weight"), "total_distance_km", "total_time_min", "total_elevation_gain_m", "total_difficulty")
    return finished(out, "routes", began)
