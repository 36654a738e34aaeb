"""The trail graph as tables: edges (src, dst, measures, ord), nodes (id, ...). Undirected; ``ord`` is the place in the file."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import CRITERIA, edge_weights
from ..sources.scratch import finished, fits, mark, settled


def real_edges(edges: DataFrame) -> DataFrame:
    """The edges with both endpoints named."""
    return edges.filter("src is not null and src <> '' and dst is not null and dst <> ''")


def adjacency(edges: DataFrame) -> DataFrame:
    """Every edge in both directions (node, neighbour and the edge's other columns); parallel edges stay."""
    rows, rest = real_edges(edges), [c for c in edges.columns if c not in ("src", "dst")]
    there = rows.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), *rest)
    return there.unionByName(rows.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), *rest))


def pair_weights(edges: DataFrame, kinds: Sequence[str] = CRITERIA) -> DataFrame:
    """(lo, hi, w_time, ...): the lightest edge of each pair of nodes under every criterion of ``kinds``, null where none is usable."""
    usable = {f"w_{k}": F.when(~F.isnan(w) & (w >= 0) & (w < float("inf")), w) for k, w in edge_weights().items() if k in kinds}
    rows = canonical(real_edges(edges)).filter("lo <> hi").select("lo", "hi", *[w.alias(c) for c, w in usable.items()])
    return rows.groupBy("lo", "hi").agg(*[F.min(c).alias(c) for c in usable]).filter(reduce(Column.__or__, [F.col(c).isNotNull() for c in usable]))


def both_ways(pairs: DataFrame) -> DataFrame:
    """pairs (lo, hi, ...) as arcs (node, neighbour, ...) in both directions."""
    ends = F.array(F.struct(F.col("lo").alias("node"), F.col("hi").alias("neighbour")), F.struct(F.col("hi").alias("node"), F.col("lo").alias("neighbour")))
    return pairs.select(F.inline(ends), *[c for c in pairs.columns if c not in ("lo", "hi")])


def weighted_arcs(edges: DataFrame) -> DataFrame:
    """(criterion, node, neighbour, w): the lightest arc of each pair under every criterion; unusable weights are dropped."""
    kinds = F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(f"w_{k}").alias("w")) for k in CRITERIA])
    return both_ways(pair_weights(edges)).select("node", "neighbour", F.inline(kinds)).filter("w is not null").select("criterion", "node", "neighbour", "w")


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with ``lo`` and ``hi``, their endpoints in order."""
    return edges.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")})


def first_edges(edges: DataFrame, *order: str) -> DataFrame:
    """One edge for each unordered pair of nodes: the first in the given order."""
    w = Window.partitionBy("lo", "hi").orderBy(*order)
    return canonical(real_edges(edges)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def edges_between(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """hops (a, b and others) with the first edge of each pair and whether it is walked backwards; hops without one stay."""
    found = first_edges(edges, "ord").withColumnsRenamed({c: f"e_{c}" for c in edges.columns})
    pairs = hops.withColumns({"_lo": F.least("a", "b"), "_hi": F.greatest("a", "b")})
    both = pairs.join(found, (F.col("_lo") == F.col("lo")) & (F.col("_hi") == F.col("hi")), "left").drop("_lo", "_hi", "lo", "hi")
    return both.withColumn("backwards", F.col("e_src") == F.col("b"))


def used_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that an edge touches."""
    ends = real_edges(edges).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi")


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that no edge touches."""
    ends = real_edges(edges).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_anti")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges."""
    both = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_edges"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of every node's component.

    Every node points to a node of its component, at first to itself. In a round a node, and the node it points to, turn to
    the least that the neighbours' targets point to, or to their own target's target if that is less. So whole trees of
    pointers move at once, and the rounds follow the logarithm of the graph's size, not the length of its trails.
    """
    began = mark()
    rows = real_edges(edges).select("src", "dst")
    links = settled(rows.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(rows.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct(), "links")
    points = settled(links.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), "labels")
    while True:
        state = points.join(points.select(F.col("node").alias("to"), F.col("to").alias("far")), "to")
        around = links.join(state.select(F.col("node").alias("other"), "far"), "other").groupBy("node").agg(F.min("far").alias("least"))
        turns = F.array(F.struct("node", F.least("to", "far", "least").alias("new"), F.col("to").alias("was")), F.struct(F.col("to").alias("node"), F.col("least").alias("new"), F.lit(None).cast("string").alias("was")))
        turned = state.join(around, "node").select(F.inline(turns)).groupBy("node").agg(F.min("new").alias("to"), F.max("was").alias("was"))
        new = settled(turned, "labels")
        points = new.select("node", "to")
        if new.filter("to < was").isEmpty():
            return finished(points.withColumnRenamed("to", "label"), "labels", began)


def together(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """The requests whose start and end lie in one component."""
    ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("start", "end")]
    return requests.join(ends[0], "start").join(ends[1], "end").filter("_start = _end").select(*requests.columns)


def linked(requests: DataFrame, arcs: DataFrame) -> DataFrame:
    """The requests whose start and end lie in one component of arcs (node, neighbour, in both directions), found for these ends only.

    In a round every node turns to the first of its neighbours by a hash, and on to what that one turns to, if they come
    before it; what turns to one node is one node then, so the graph shrinks to nothing in rounds that follow the logarithm
    of its size.
    """
    links, rounds = arcs.select(F.col("node").alias("a"), F.col("neighbour").alias("b")), []
    while not links.isEmpty():
        a, b = (F.struct(F.xxhash64(F.col(c), F.lit(len(rounds))).alias("hash"), F.col(c).alias("node")) for c in "ab")
        first = links.groupBy("a").agg(F.min(b).alias("b"))
        turns = settled(first.select("a", F.when(F.col("b") < a, F.col("b.node")).otherwise(F.col("a")).alias("to")), "turns")
        few = fits(turns)
        near = F.broadcast(turns) if few else turns
        far = near.join(near.select(F.col("a").alias("to"), F.col("to").alias("far")), "to").select("a", F.col("far").alias("to"))
        turns = F.broadcast(far) if few else settled(far, "turns")
        both = links.join(turns, "a").select(F.col("to").alias("a"), "b").join(turns.select(F.col("a").alias("b"), "to"), "b").select("a", F.col("to").alias("b"))
        links = settled(both.filter("a <> b").distinct(), "links")
        rounds.append(turns)
    now = requests.select(F.explode(F.array("start", "end")).alias("node")).distinct().withColumn("a", F.col("node"))
    for turns in rounds:
        now = now.join(turns, "a", "left").select("node", F.coalesce("to", "a").alias("a"))
    return together(requests, settled(now.withColumnRenamed("a", "label"), "ends"))


def drawn_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the positions of both ends; those with an unknown end are dropped."""
    at = nodes.select("id", "lat", "lng")
    one = edges.join(at.withColumnsRenamed({"id": "src", "lat": "src_lat", "lng": "src_lng"}), "src")
    return one.join(at.withColumnsRenamed({"id": "dst", "lat": "dst_lat", "lng": "dst_lng"}), "dst")
