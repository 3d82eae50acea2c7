"""A hierarchical navigable small-world graph in flat arrays, built and searched for many points at once.

Nearness is the largest inner product. Points get one more component that brings all of a shard to the same length, so that the
inner product orders them as their distance does and the graph is that of a metric; queries have 0 there.

A layer is one array of neighbours, ``width`` places a node, -1 where empty. Points are inserted in batches: a batch
searches the layer as it stands, meets itself by one product of matrices, and links then go both ways. Searches run in step:
each round every query that isn't done opens its best candidates, so that the work of a round is a few array operations.
"""

from __future__ import annotations

import numpy as np

#: Neighbours kept by a node in the upper layers; twice as many in the lowest one.
LINKS = 16
NONE = np.float32(-np.inf)


def lifted(x: np.ndarray) -> np.ndarray:
    """Rows, scaled by one factor, with one more component, so that all have the length of the longest."""
    x = x / max(np.abs(x).max(initial=0), np.finfo(x.dtype).tiny)
    norm = np.einsum("ij,ij->i", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]], axis=1).astype(np.float32)


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int, opened: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``width`` nearest nodes that a best-first walk finds: nodes (-1: none) and inner products, not ordered.

    entries: a row of different nodes for each query, -1 where none. ``opened``: candidates that a query opens in a round.
    """
    n = len(queries)
    nodes, near = np.full((n, width), -1, np.int32), np.full((n, width), NONE)
    done = np.zeros((n, width), bool)
    seen = np.full((n, len(vectors)), -1, np.int16)
    live = np.arange(n)

    def meet(at: np.ndarray, ids: np.ndarray) -> None:
        rows = np.arange(len(at))[:, None]
        mine = at[:, None]
        safe = np.maximum(ids, 0)
        fresh = (ids >= 0) & (seen[mine, safe] < 0)
        column = np.broadcast_to(np.arange(ids.shape[1], dtype=np.int16), ids.shape)
        r, c = np.nonzero(fresh)
        seen[at[r], ids[r, c]] = column[r, c]  # of one node met twice in a round, the last place counts
        keep = seen[at[r], ids[r, c]] == c
        r, c = r[keep], c[keep]
        sims = np.full(ids.shape, NONE)
        sims[r, c] = np.einsum("ij,ij->i", vectors[ids[r, c]], queries[at[r]])
        all_near = np.concatenate([near[at], sims], axis=1)
        best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        near[at] = all_near[rows, best]
        nodes[at] = np.where(near[at] > NONE, np.concatenate([nodes[at], ids], axis=1)[rows, best], -1)
        done[at] = np.concatenate([done[at], np.zeros(ids.shape, bool)], axis=1)[rows, best]

    meet(live, entries)
    while len(live):
        todo = np.where(done[live], NONE, near[live])
        k = min(opened, width)
        best = np.argpartition(-todo, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(todo, best, 1)
        some = (value > NONE).any(axis=1)
        live, best, value = live[some], best[some], value[some]
        if not len(live):
            break
        done[live[:, None], best] = True
        ids = np.where((value > NONE)[:, :, None], links[nodes[live[:, None], best]], -1).reshape(len(live), -1)
        meet(live, ids)
    return nodes, near


def diverse(vectors: np.ndarray, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates at most ``keep``: first those that are nearer to the row's own point than to any kept before, then the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    there = (ids >= 0) & (ids != base[:, None])
    own = vectors[np.maximum(ids, 0)]
    between = np.matmul(own, own.transpose(0, 2, 1))
    n, m = ids.shape
    kept, closest, count = np.zeros((n, m), bool), np.full((n, m), NONE), np.zeros(n, np.int64)
    for j in range(m):
        take = there[:, j] & (closest[:, j] < sims[:, j]) & (count < keep)
        kept[:, j] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
    rank = np.argsort(np.where(kept, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :keep]
    out = np.where(np.take_along_axis(there, rank, 1), np.take_along_axis(ids, rank, 1), -1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1).astype(np.int32)


class Graph:
    """layers[0] holds all points; layers[i] the neighbours of the first ``counts[i]`` of them, as points are numbered from the highest level down."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, points: np.ndarray, wide: int = 96, batch: int = 512, seed: int = 1) -> tuple[Graph, np.ndarray]:
        """The graph of the points (rows of any lengths), and the place of each of its nodes among them."""
        x = lifted(points)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")
        x, level = x[order], level[order]
        graph = cls(x, [])
        for i in range(int(level.max(initial=0)), -1, -1):
            graph._layer(int((level >= i).sum()), LINKS * (1 if i else 2), wide, batch)
        graph.layers.reverse()
        return graph, order

    def _layer(self, n: int, width: int, wide: int, batch: int) -> None:
        """One more layer of the first n points, below those that are there."""
        x, slack = self.vectors[:n], width // 2
        links = np.full((n, width + slack), -1, np.int32)
        used = np.zeros(n, np.int64)
        a = 0
        while a < n:
            b = min(n, a + max(64, min(batch, a)))
            new = np.arange(a, b)
            own = x[a:b] @ x[a:b].T
            np.fill_diagonal(own, NONE)
            k = min(wide // 2, b - a)
            near = np.argpartition(-own, k - 1, axis=1)[:, :k]
            ids, sims = (near + a).astype(np.int32), np.take_along_axis(own, near, 1)
            if a:
                found, values = beam(x[:a], links[:a], x[a:b], self.entries(x[a:b], a), wide)
                ids, sims = np.concatenate([ids, found], axis=1), np.concatenate([sims, values], axis=1)
                top = np.argpartition(-sims, min(wide, sims.shape[1]) - 1, axis=1)[:, :wide]
                ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
            ids = np.where(sims > NONE, ids, -1)
            chosen = diverse(x, new, ids, sims, LINKS)
            links[a:b, :LINKS] = chosen
            used[a:b] = (chosen >= 0).sum(axis=1)
            self._back(x, links, used, np.repeat(new, LINKS), chosen.ravel(), width)
            a = b
        full = np.flatnonzero(used > width)
        self._trim(x, links, used, full, width)
        self.layers.append(links[:, :width].copy())

    def _back(self, x: np.ndarray, links: np.ndarray, used: np.ndarray, src: np.ndarray, dst: np.ndarray, width: int) -> None:
        """Link dst to src too; nodes whose places are full are trimmed first."""
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        known = (links[dst] == src[:, None]).any(axis=1)
        src, dst = src[~known], dst[~known]
        while len(dst):
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
            start = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1])))
            rank = np.arange(len(dst)) - np.repeat(start, np.diff(np.append(start, len(dst))))
            place = used[dst] + rank
            fits = place < links.shape[1]
            links[dst[fits], place[fits]] = src[fits]
            used += np.bincount(dst[fits], minlength=len(used))
            src, dst = src[~fits], dst[~fits]
            if len(dst):
                self._trim(x, links, used, np.unique(dst), width)

    @staticmethod
    def _trim(x: np.ndarray, links: np.ndarray, used: np.ndarray, full: np.ndarray, width: int) -> None:
        for part in np.array_split(full, max(1, -(-len(full) // 512))):
            if not len(part):
                continue
            ids = links[part]
            sims = np.where(ids >= 0, np.einsum("ijk,ik->ij", x[np.maximum(ids, 0)], x[part]), NONE)
            kept = diverse(x, part, ids, sims, width)
            links[part] = -1
            links[part, :width] = kept
            used[part] = (kept >= 0).sum(axis=1)

    def entries(self, queries: np.ndarray, among: int, many: int = 8) -> np.ndarray:
        """Where a search of the next layer begins: the nearest nodes of the layers above, of those below ``among``; with none, the first node."""
        at = np.zeros((len(queries), 1), np.int32)
        for links in self.layers:
            at, near = beam(self.vectors[: len(links)], links, queries, at, many, opened=2)
            at = np.where(near > NONE, at, -1)
        none = ~((at >= 0) & (at < among)).any(axis=1)
        at = np.where(at < among, at, -1)
        at[none, 0] = 0
        return at

    def search(self, queries: np.ndarray, wide: int, batch: int = 256) -> np.ndarray:
        """For each query ``wide`` nodes found, in no order, all nodes where there are no more; -1 where there are fewer."""
        out = np.full((len(queries), wide), -1, np.int32)
        if len(self.vectors) <= wide:
            out[:, : len(self.vectors)] = np.arange(len(self.vectors))
            return out
        queries = queries / np.maximum(np.abs(queries).max(axis=1, initial=0), np.finfo(queries.dtype).tiny)[:, None]
        upper = Graph(self.vectors, self.layers[:0:-1])
        for a in range(0, len(queries), batch):
            q = np.concatenate([queries[a : a + batch], np.zeros((len(queries[a : a + batch]), 1))], axis=1).astype(np.float32)
            out[a : a + batch], _ = beam(self.vectors, self.layers[0], q, upper.entries(q, len(self.vectors)), wide)
        return out
