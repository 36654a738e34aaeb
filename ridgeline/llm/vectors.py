"""Near-duplicate vectors by small-world graphs per shard.

Exact copies are one class. The classes of a label are dealt over shards of bounded size by their hash, and a graph is built
in each and written as rows: every node with its links. Then every vector is a query to every shard of its label: a task
gets two shards with their graphs (or one, twice) and lets each search the other. A query whose beam is full of links is
asked again with a wider one, at last against the whole shard, so that no link is lost to a crowd. An audit compares every
32nd query (64 at least) with the whole shard; beams are doubled until the share of its links that were found is 0.99.
Links count only with the cosine in double precision. A task hands on how many vectors each node is linked with and one link
into its group, not the pairs, and components of these links are the groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import dropped, small_side, written
from .small_world import AT_ONCE, WIDTH, SmallWorld

LINK = 0.93
#: Bounds of a shard: vectors, and bytes of their components.
SHARD_ROWS, SHARD_BYTES = 32_768, 64 << 20
#: First beam of the search; share of an audit's links that must be found; every how manieth query is audited, and how many at least.
BEAM, RECALL, AUDITED, LEAST_AUDIT = 64, 0.99, 32, 64
#: A beam that was widened to this part of a shard gives way to the whole shard, which is cheaper then.
WHOLE = 16
#: What single precision may take from a cosine.
SLACK = 1e-5


def units(rows: list) -> np.ndarray:
    """The vectors as rows of length 1, scaled first so that no square overflows."""
    vec = np.array([np.asarray(x, np.float64) for x in rows])
    vec /= np.abs(vec).max(1, keepdims=True)
    return vec / np.sqrt((vec * vec).sum(1, keepdims=True))


def _built(shard: pd.DataFrame) -> pd.DataFrame:
    """A shard's nodes in the order of their graph, each with its links: those of layer 0, then those of the layers above."""
    shard = shard.sort_values("cls", ignore_index=True)
    graph = SmallWorld.built(units(shard.vec.tolist()))
    out = shard.drop(columns="vec")
    out["pos"] = np.arange(len(shard), dtype=np.int32)
    out["unit"] = [x.tobytes() for x in graph.exact]
    out["links"] = [b"".join(layer[i].tobytes() for layer in graph.layers if i < len(layer)) for i in range(len(shard))]
    return out


def _graph(nodes: pd.DataFrame) -> SmallWorld:
    vectors = np.frombuffer(b"".join(nodes.unit), np.float64).reshape(len(nodes), -1)
    links = [np.frombuffer(x, np.int32) for x in nodes.links]
    layers = [np.array([x[: 2 * WIDTH] for x in links])]
    while upper := [x[(len(layers) + 1) * WIDTH : (len(layers) + 2) * WIDTH] for x in links if len(x) > (len(layers) + 1) * WIDTH]:
        layers.append(np.array(upper))
    return SmallWorld(vectors, layers)


def _too_wide(graph: SmallWorld, beam: int) -> bool:
    return beam >= len(graph.exact) or beam > BEAM and beam * WHOLE > len(graph.exact)


def _whole(graph: SmallWorld, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (query, node) with a link."""
    return np.nonzero(queries @ graph.exact.T >= LINK)


def _asked(graph: SmallWorld, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node) of the links that beams find, and the queries whose beams stay full until the whole shard is cheaper."""
    found, rest, crowded = [], np.arange(len(queries)), []
    while len(rest):
        if _too_wide(graph, beam):
            crowded.append(rest)
            break
        full = []
        for s in range(0, len(rest), AT_ONCE):
            own = rest[s : s + AT_ONCE]
            asked = queries[own].astype(np.float32)
            ids, sims = graph.beam(0, asked, graph.entries(asked, 1), beam)
            over = sims[:, -1] >= LINK - SLACK
            full.append(own[over])
            row, place = np.nonzero((sims >= LINK - SLACK) & ~over[:, None])
            row, node = own[row], ids[row, place]
            good = np.einsum("ij,ij->i", queries[row], graph.exact[node]) >= LINK
            found.append((row[good], node[good]))
        rest, beam = np.concatenate(full), 4 * beam
    row, node = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return row, node, np.concatenate(crowded) if crowded else np.zeros(0, np.int64)


def searched(graph: SmallWorld, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_asked`` with beams as wide as the audit demands."""
    audit = np.unique(np.linspace(0, len(queries) - 1, min(len(queries), max(LEAST_AUDIT, len(queries) // AUDITED))).astype(np.int64))
    row, node = _whole(graph, queries[audit]) if not _too_wide(graph, beam) else (np.zeros(0, np.int64),) * 2
    true = audit[row] * len(graph.exact) + node
    while True:
        row, node, crowded = _asked(graph, queries, beam)
        # crowded queries are compared with the whole shard later on, so nothing of them is lost
        open_ = true[~np.isin(true // len(graph.exact), crowded)]
        if not len(open_) or np.isin(open_, row * len(graph.exact) + node).mean() >= RECALL:
            return row, node, crowded
        beam *= 2


class _Groups:
    """Sets of nodes that links join, each under its smallest node."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            a, b = np.minimum(x, y), np.maximum(x, y)
            pairs = np.unique(a[a != b] * len(self.root) + b[a != b])
            a, b = pairs // len(self.root), pairs % len(self.root)
            np.minimum.at(self.root, b, a)
            while (deeper := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = deeper


def _searched(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the two shards ``lo`` and ``hi`` of a group (or within one): for each node how many vectors, and a node of its local group.

    A link found from either end counts for both. Of crowded nodes all links are counted block by block, so that a task
    never holds the pairs of a crowd.
    """
    lo, hi = rows.lo.iat[0], rows.hi.iat[0]
    sides = [rows[rows.shard == x].sort_values("pos", ignore_index=True) for x in ((lo,) if lo == hi else (lo, hi))]
    graphs = [_graph(x) for x in sides]
    cls, mult = (np.concatenate([x[c].to_numpy(np.int64) for x in sides]) for c in ("cls", "mult"))
    first, n = len(sides[0]), len(cls)
    crowded, pairs = np.zeros(n, bool), []
    offsets = (0, first)[: len(sides)]
    for a, b in ((0, 0),) if lo == hi else ((0, 1), (1, 0)):
        row, node, full = searched(graphs[b], graphs[a].exact)
        crowded[full + offsets[a]] = True
        row, node = row + offsets[a], node + offsets[b]
        pairs.append(np.minimum(row, node)[row != node] * n + np.maximum(row, node)[row != node])
    pairs = np.unique(np.concatenate(pairs))
    a, b = pairs // n, pairs % n
    count, groups = np.zeros(n, np.int64), _Groups(n)
    np.add.at(count, a[~crowded[a]], mult[b[~crowded[a]]])
    np.add.at(count, b[~crowded[b]], mult[a[~crowded[b]]])
    groups.join(a, b)
    for side, other in ((0, 0),) if lo == hi else ((0, 1), (1, 0)):
        own = np.flatnonzero(crowded[offsets[side] : offsets[side] + len(sides[side])])
        for s in range(0, len(own), AT_ONCE):
            row, node = _whole(graphs[other], graphs[side].exact[own[s : s + AT_ONCE]])
            row, node = own[s : s + AT_ONCE][row] + offsets[side], node + offsets[other]
            row, node = row[row != node], node[row != node]
            np.add.at(count, row, mult[node])
            quiet = ~crowded[node]
            row_, node_ = row[quiet], node[quiet]
            unseen = ~np.isin(np.minimum(row_, node_) * n + np.maximum(row_, node_), pairs)
            np.add.at(count, node_[unseen], mult[row_[unseen]])
            groups.join(row, node)
    linked = np.flatnonzero(count)
    return pd.DataFrame({"cls": cls[linked], "n": count[linked], "to": cls[groups.root[linked]]})


def near_vectors(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The group of every vector: vec_id, n_links, component_id, kept.

    ``vectors`` needs vec_id (an integer), embedding (an array of numbers) and label; other columns are not looked at. Two
    rows link if their labels are equal, their vectors equally long and the cosine is 0.93 or more. A row whose label or
    vec_id is null, or whose vector is null, empty, zero or holds a null, NaN or infinite component, links with nothing: it
    has no links and is its own component (a null vec_id: a null component), and is kept. Repeated rows are vectors of their
    own, and copies of one another; of rows that share a vec_id and a component each is ``kept`` if that is the component's.
    An empty table gives an empty result.
    """
    vec = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # no negative zero
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", vec.alias("vec")).withColumn("sound", sound)
    digest = F.struct(F.xxhash64("label", "vec"), F.xxhash64(F.lit(1), "vec", "label"))
    rows = rows.withColumn("key", F.when(F.col("sound"), digest))
    classes = rows.filter("sound").groupBy("label", "vec", "key").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("first"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cls"), "label", F.size("vec").alias("dim"), "key", "mult", "first", "vec"), "vector_classes")
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    labels = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")).select("label", "dim", F.ceil(F.col("size") / most).alias("parts"))
    dealt = classes.join(small_side(labels), ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("cls"), F.col("parts")))
    kind = vectors.schema["label"].dataType.simpleString()
    nodes = dealt.select("cls", "mult", "label", "dim", "parts", "shard", "vec").groupBy("label", "dim", "shard")
    nodes = written(nodes.applyInPandas(_built, f"cls bigint, mult bigint, label {kind}, dim int, parts bigint, shard bigint, pos int, unit binary, links binary"), "vector_graphs")
    with_ = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    met = nodes.withColumn("other", with_).withColumns({"lo": F.least("shard", "other"), "hi": F.greatest("shard", "other")})
    met = met.groupBy("label", "dim", "lo", "hi").applyInPandas(_searched, "cls bigint, n bigint, to bigint")
    met = written(met, "vector_links")
    counts = met.groupBy("cls").agg(F.sum("n").alias("n"))
    groups = components(met.select(F.col("cls").alias("a"), F.col("to").alias("b")))
    known = classes.select("cls", "key", "mult", "first").join(counts, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    known = written(known.select("key", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("comp", "cls").alias("comp"), "first"), "vector_groups")
    least = known.groupBy("comp").agg(F.min("first").alias("component_id"))
    known = written(known.join(least, "comp").select("key", "n_links", "component_id"), "vector_groups")
    dropped(classes, nodes, met, groups)
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
