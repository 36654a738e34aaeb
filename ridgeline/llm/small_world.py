"""Hierarchical navigable small-world graphs over the unit vectors of one shard, as arrays; many queries walk at once.

Nodes lie by falling level, so that a layer is a prefix of them: ``layers[l]`` holds the neighbours of its nodes, filled up
with -1. A layer is filled from the one above: its first block by plain comparison, the others batch by batch, by a beam
from the nodes to which the layers above lead. Neighbours are chosen so that none is nearer to another than to the node.
"""

from __future__ import annotations

import numpy as np

#: Links of a node in the upper layers; layer 0 has twice as many. Beam of the build, queries that walk at once.
WIDTH, BUILD_BEAM, AT_ONCE = 12, 64, 256
_FIRST = 512


class SmallWorld:
    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]) -> None:
        self.exact, self.layers = vectors, layers
        self.vectors = np.concatenate([vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32)

    @staticmethod
    def levels(n: int) -> np.ndarray:
        """A level for each place, falling: one in WIDTH reaches the next layer."""
        drawn = np.random.default_rng(n).random(n)
        return np.sort((-np.log(np.maximum(drawn, 1e-12)) / np.log(WIDTH)).astype(np.int64))[::-1]

    @classmethod
    def built(cls, vectors: np.ndarray) -> SmallWorld:
        n, levels = len(vectors), cls.levels(len(vectors))
        sizes = [int((levels >= k).sum()) for k in range(int(levels[0]) + 1)] if n else []
        graph = cls(vectors, [np.full((size, WIDTH * (2 if k == 0 else 1)), -1, np.int32) for k, size in enumerate(sizes)])
        for k in range(len(sizes) - 1, -1, -1):
            first = min(sizes[k], max(_FIRST, sizes[k + 1] if k + 1 < len(sizes) else 0))
            for s in range(0, first, AT_ONCE):
                e = min(first, s + AT_ONCE)
                sims = graph.vectors[s:e] @ graph.vectors[:first].T
                sims[np.arange(e - s), np.arange(s, e)] = -np.inf
                near = np.argsort(-sims, axis=1, kind="stable")[:, : min(BUILD_BEAM, first - 1)]
                graph.layers[k][s:e] = graph._chosen(near, np.take_along_axis(sims, near, 1), graph.layers[k].shape[1])
            graph._back(k, np.arange(first))
            for s in range(first, sizes[k], AT_ONCE):
                e = min(sizes[k], s + AT_ONCE)
                near, sims = graph.beam(k, graph.vectors[s:e], graph.entries(graph.vectors[s:e], k + 1), BUILD_BEAM)
                own = graph.vectors[s:e] @ graph.vectors[s:e].T  # a batch is no stranger to itself
                np.fill_diagonal(own, -np.inf)
                near, sims = np.concatenate([near, np.tile(np.arange(s, e), (e - s, 1))], 1), np.concatenate([sims, own], 1)
                best = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
                near, sims = np.take_along_axis(near, best, 1), np.take_along_axis(sims, best, 1)
                graph.layers[k][s:e, :WIDTH] = graph._chosen(near, sims, WIDTH)
                graph._back(k, np.arange(s, e))
        return graph

    def _chosen(self, near: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of candidates in falling order up to ``width``: first those nearer to the node than to any chosen one, then the rest."""
        rows, size = near.shape
        ids = np.where(np.isfinite(sims), near, len(self.exact))
        among = self.vectors[ids] @ self.vectors[ids].transpose(0, 2, 1)
        taken, barred = np.zeros((rows, size), bool), ids == len(self.exact)
        for c in range(size):
            good = ~barred[:, c] & (taken.sum(1) < width)
            taken[:, c] = good
            # what is nearer to this one than to the node waits
            barred |= good[:, None] & (among[:, c] > sims) & (np.arange(size) > c)
        order = np.argsort(np.where(ids == len(self.exact), 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(ids, order, 1)
        out = np.where(out == len(self.exact), -1, out)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)

    def _back(self, k: int, nodes: np.ndarray) -> None:
        """Links back from the neighbours of new nodes; full lists are chosen again."""
        layer = self.layers[k]
        width = layer.shape[1]
        to, source = layer[nodes].ravel(), np.repeat(nodes, width)
        source, to = source[to >= 0], to[to >= 0]
        fresh = ~(layer[to] == source[:, None]).any(1)
        source, to = source[fresh], to[fresh]
        if not len(to):
            return
        sims = np.einsum("ij,ij->i", self.vectors[to], self.vectors[source])
        order = np.lexsort((-sims, to))
        to, source = to[order], source[order]
        places = np.concatenate(([True], to[1:] != to[:-1]))
        rank = np.arange(len(to)) - np.maximum.accumulate(np.where(places, np.arange(len(to)), 0))
        keep = rank < width
        each, row = np.unique(to[keep], return_inverse=True)
        more = np.full((len(each), int(rank[keep].max()) + 1), -1, np.int64)
        more[row, rank[keep]] = source[keep]
        for s in range(0, len(each), AT_ONCE):
            own = each[s : s + AT_ONCE]
            ids = np.concatenate([layer[own], more[s : s + AT_ONCE]], 1)
            near = np.where(ids < 0, -np.inf, np.einsum("bkd,bd->bk", self.vectors[ids], self.vectors[own]))
            best = np.argsort(-near, axis=1, kind="stable")
            layer[own] = self._chosen(np.take_along_axis(ids, best, 1), np.take_along_axis(near, best, 1), width)

    def entries(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """The nodes to which layers from the top to ``down_to`` lead."""
        at = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.layers) - 1, down_to - 1, -1):
            at = self.beam(k, queries, at, 4)[0]
        return at

    def beam(self, k: int, queries: np.ndarray, entries: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes that a best-first walk of layer ``k`` meets, and their cosines, in falling order; -inf fills up."""
        n, rows = len(self.exact), len(queries)
        links = np.concatenate([self.layers[k], np.full((1, self.layers[k].shape[1]), -1, np.int32)])
        seen = np.zeros((rows, n + 1), bool)
        seen[:, n] = True
        ids, sims, done = np.full((rows, width), n, np.int64), np.full((rows, width), -np.inf, np.float32), np.ones((rows, width), bool)
        start = np.where(entries < 0, n, entries)[:, :width]
        start_sims = np.where(start == n, -np.inf, np.einsum("bkd,bd->bk", self.vectors[start], queries))
        order = np.argsort(-start_sims, axis=1, kind="stable")
        span = start.shape[1]
        ids[:, :span], sims[:, :span] = np.take_along_axis(start, order, 1), np.take_along_axis(start_sims, order, 1)
        done[:, :span] = ids[:, :span] == n
        np.put_along_axis(seen, start, True, 1)
        active = np.flatnonzero(~done.all(1))
        while len(active):
            open_ = ~done[active]
            pick = open_ & (np.cumsum(open_, 1) <= step)
            done[active] |= pick
            row, place = np.nonzero(pick)
            where = ids[active[row], place]
            near = links[np.minimum(where, len(links) - 1)].astype(np.int64)
            near[near < 0] = n
            row = np.repeat(row, near.shape[1])
            flat = near.ravel()
            new = ~seen[active[row], flat]
            row, flat = row[new], flat[new]
            key = np.unique(row * (n + 1) + flat)
            row, flat = key // (n + 1), key % (n + 1)
            seen[active[row], flat] = True
            found = np.einsum("ij,ij->i", self.vectors[flat], queries[active[row]])
            counts = np.bincount(row, minlength=len(active))
            most = int(counts.max(initial=0))
            if most:
                col = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                more_ids, more_sims = np.full((len(active), most), n, np.int64), np.full((len(active), most), -np.inf, np.float32)
                more_ids[row, col], more_sims[row, col] = flat, found
                all_ids, all_sims = np.concatenate([ids[active], more_ids], 1), np.concatenate([sims[active], more_sims], 1)
                all_done = np.concatenate([done[active], more_ids == n], 1)
                order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
                ids[active], sims[active], done[active] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1), np.take_along_axis(all_done, order, 1)
            active = active[~done[active].all(1)]
        return np.where(ids == n, -1, ids), sims
