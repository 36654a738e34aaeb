"""Chains of trail nodes with two neighbours each as single arcs, and back again.

An arc whose tail is such a node knows the arc before it. By doubling, every arc finds the first one of its chain, its rank
and the weight before it, in as many rounds as the longest chain has binary digits. What keeps no first arc is a ring that
no other trail meets, and is left out. Chains are those of the graph under all criteria, with a weight for each: null where
an arc of the chain can't be used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import CRITERIA
from ..sources.scratch import settled, small
from .graph import both_ways


def weights_in(df: DataFrame) -> list[str]:
    """The criteria that df has weights for."""
    return [k for k in CRITERIA if f"w_{k}" in df.columns]


def inner_nodes(arcs: DataFrame, kept: DataFrame) -> DataFrame:
    """(node, one, two): nodes with two neighbours, but for the nodes of ``kept`` (node); one and two are structs of the neighbour and the weights to it."""
    arc = F.struct("neighbour", *[f"w_{k}" for k in weights_in(arcs)])
    ends = arcs.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(arc).alias("one"), F.max(arc).alias("two")).filter("n = 2").drop("n")
    return ends.join(kept.select("node").distinct(), "node", "left_anti").select("node", "one", "two")


def chain_members(inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, last): the arcs of every chain but its first one, in both directions, and the last arc of each (t, h, w_time, ...).

    members: (first_t, first_h, rank, t, h, before_time, ...), where (first_t, first_h) is the first arc, of rank 0.
    """
    kinds = [k for k in CRITERIA if f"w_{k}" in inner.schema["one"].dataType.names]
    met = inner
    for side in ("one", "two"):
        other = inner.select(F.col("node").alias(f"{side}_node"), F.lit(True).alias(f"{side}_inner"))
        met = met.withColumn(f"{side}_node", F.col(f"{side}.neighbour")).join(other, f"{side}_node", "left")

    def leaving(to: str, back: str):
        return F.struct(
            F.col(f"{to}_node").alias("h"), F.col(f"{back}_node").alias("first_t"), F.coalesce(f"{to}_inner", F.lit(False)).alias("inside"), F.coalesce(f"{back}_inner", F.lit(False)).alias("open"),
            *[F.col(f"{to}.w_{k}").alias(f"w_{k}") for k in kinds], *[F.col(f"{back}.w_{k}").alias(f"before_{k}") for k in kinds],
        )

    rows = met.select(F.col("node").alias("t"), F.inline(F.array(leaving("one", "two"), leaving("two", "one"))))
    # the arc before it, which is the first one unless that arc's tail is inside too
    own = ["t", "h", "first_t", F.col("t").alias("first_h"), F.lit(1).cast("long").alias("rank"), *[f"before_{k}" for k in kinds], "open"]
    arcs = settled(rows.select(*own, "inside", *[f"w_{k}" for k in kinds]), "chains")
    last = arcs.filter("not inside").select("t", "h", *[f"w_{k}" for k in kinds])
    now = arcs.drop("inside", *[f"w_{k}" for k in kinds])
    done, n = [now.filter("not open").drop("open")], now.count()
    for _ in range(math.ceil(math.log2(max(2, n))) + 1):
        going = now.filter("open")
        if going.isEmpty():
            break
        every = reduce(DataFrame.unionByName, [*[x.withColumn("open", F.lit(False)) for x in done], going])
        step = every.select(F.col("t").alias("first_t"), F.col("h").alias("first_h"), F.col("first_t").alias("far_t"), F.col("first_h").alias("far_h"), F.col("rank").alias("more"), *[F.col(f"before_{k}").alias(f"more_{k}") for k in kinds], F.col("open").alias("goes_on"))
        both = small(going).join(step, ["first_t", "first_h"])
        now = settled(both.select("t", "h", F.col("far_t").alias("first_t"), F.col("far_h").alias("first_h"), (F.col("rank") + F.col("more")).alias("rank"), *[(F.col(f"before_{k}") + F.col(f"more_{k}")).alias(f"before_{k}") for k in kinds], F.col("goes_on").alias("open")), "chains")
        done.append(now.filter("not open").drop("open"))
    return reduce(DataFrame.unionByName, done), last


def shortened(pairs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(arcs, members): arcs (node, neighbour, last, hops, via, w_time, ..., before_time, ...) between the nodes that are left of pairs (lo, hi, w_time, ...).

    ``last`` is the node before the end, ``before`` the weight up to it, ``hops`` the number of arcs that one stands for,
    and ``via`` the second node of a chain. ``members`` are those of the chains, None without any.
    """
    kinds = weights_in(pairs)
    inner = settled(inner_nodes(both_ways(pairs), kept), "inner")
    bare, left = inner.isEmpty(), pairs
    for end in () if bare else ("lo", "hi"):
        left = left.join(inner.select(F.col("node").alias(end)), end, "left_anti")
    plain = both_ways(left).select("node", "neighbour", F.col("node").alias("last"), F.lit(1).cast("long").alias("hops"), F.lit(None).cast(pairs.schema["lo"].dataType).alias("via"), *[f"w_{k}" for k in kinds], *[F.lit(0.0).alias(f"before_{k}") for k in kinds])
    if bare:
        return settled(plain, "arcs"), None
    members, last = chain_members(inner)
    ends = members.filter("first_t <> h").join(last, ["t", "h"])
    chains = ends.select(F.col("first_t").alias("node"), F.col("h").alias("neighbour"), F.col("t").alias("last"), (F.col("rank") + 1).alias("hops"), F.col("first_h").alias("via"), *[(F.col(f"before_{k}") + F.col(f"w_{k}")).alias(f"w_{k}") for k in kinds], *[f"before_{k}" for k in kinds])
    return settled(plain.unionByName(chains), "arcs"), members


def contracted(arcs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``shortened`` for arcs (criterion, node, neighbour, w), with a row for each criterion; members also hold the first arc of every chain."""
    kinds = [F.min(F.when(F.col("criterion") == k, F.col("w"))).alias(f"w_{k}") for k in CRITERIA]
    pairs = settled(arcs.filter("node < neighbour").groupBy(F.col("node").alias("lo"), F.col("neighbour").alias("hi")).agg(*kinds), "pairs")
    short, members = shortened(pairs, kept)
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(f"w_{k}").alias("w"), F.col(f"before_{k}").alias("before")) for k in CRITERIA]))
    arcs = short.select("node", "neighbour", "last", "hops", "via", each).filter("w is not null")
    if members is None:
        return arcs, None
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(f"before_{k}").alias("before")) for k in CRITERIA]))
    rest = members.select("first_t", "first_h", "rank", "t", "h", each)
    first = rest.filter("rank = 1").select("first_t", "first_h", F.lit(0).cast("long").alias("rank"), F.col("first_t").alias("t"), F.col("first_h").alias("h"), "criterion", F.lit(0.0).alias("before"))
    return arcs, rest.unionByName(first).filter("before is not null")
