"""Hierarchical navigable small-world graphs, built and searched for many vectors at a time."""

from __future__ import annotations

import io

import numpy as np

#: Links of a node in upper layers and in the lowest; beam of the construction.
M, M0, EF_BUILD = 12, 24, 64
#: Layers of at most so many nodes are scanned.
SCAN = 64
#: Places of a beam whose links are followed at a time; vectors searched at a time; bytes that a search or an insertion may take for each of its arrays.
STEP, BATCH, ROOM = 4, 1024, 64_000_000


def batch_size(size: int, dim: int) -> int:
    """Vectors to search at a time: their marks on ``size`` nodes, and the vectors met in a step, keep to ROOM bytes each."""
    return max(16, min(BATCH, ROOM // max(1, size), ROOM // (2 * 4 * STEP * M0 * max(1, dim))))


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, largest first."""
    if sims.shape[1] > k:
        part = np.argpartition(sims, sims.shape[1] - k, axis=1)[:, -k:]
        order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
        return np.take_along_axis(part, order, 1)
    return np.argsort(-sims, axis=1, kind="stable")


def select_diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to ``m`` of each row's candidates (nearest first, -1 for none): those nearer to the row's vector than to one chosen before."""
    rows, width = ids.shape
    few = max(1, ROOM // 8 // (4 * width * max(width, x.shape[1])))
    if rows > few:
        return np.concatenate([select_diverse(x, ids[k : k + few], sims[k : k + few], m) for k in range(0, rows, few)])
    c = x[np.maximum(ids, 0)]
    between = np.einsum("rid,rjd->rij", c, c)
    chosen = np.zeros((rows, width), dtype=bool)
    for i in range(width):
        near = np.where(chosen, between[:, i, :], -2).max(axis=1)
        chosen[:, i] = (ids[:, i] >= 0) & (sims[:, i] > near) & (chosen.sum(axis=1) < m)
    for i in range(width):  # fill up with the nearest of the rest
        chosen[:, i] |= (ids[:, i] >= 0) & (chosen.sum(axis=1) < m)
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :m]
    out = np.full((rows, m), -1, dtype=np.int32)
    out[:, : order.shape[1]] = np.where(np.take_along_axis(chosen, order, 1), np.take_along_axis(ids, order, 1), -1)
    return out


class Layer:
    """A graph over ``nodes``, which are rows of ``x``; ``links`` holds places in ``nodes``."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray, m: int) -> None:
        self.x, self.nodes, self.m = x if len(nodes) == len(x) else x[nodes], nodes, m
        self.links = np.full((len(nodes), m), -1, dtype=np.int32)
        self.size = 0

    def build(self) -> None:
        """Add the nodes in growing batches; a batch is linked to the graph so far and within itself."""
        while self.size < len(self.nodes):
            a = self.size
            b = min(len(self.nodes), a + max(SCAN, min(512, a, batch_size(a, self.x.shape[1]))))
            q, own = self.x[a:b], np.arange(a, b)
            inner = q @ q.T
            np.fill_diagonal(inner, -2)
            pick = _top(inner, min(EF_BUILD, len(q)))
            ids, sims = own[pick], np.take_along_axis(inner, pick, 1)
            if a:
                old_ids, old_sims = self.search(q, EF_BUILD, self.start(q))
                ids, sims = np.concatenate([ids, old_ids], 1), np.concatenate([sims, old_sims], 1)
            ids = np.where(sims > -1.5, ids, -1)
            best = _top(sims, EF_BUILD)
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            self.links[a:b] = select_diverse(self.x, ids, sims, self.m)
            self.size = b
            self._link_back(a, b)

    def _link_back(self, a: int, b: int) -> None:
        source, target = np.repeat(np.arange(a, b), self.m), self.links[a:b].ravel()
        keep = target >= 0
        source, target = source[keep], target[keep]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, first, count = np.unique(target, return_index=True, return_counts=True)
        widest = int(min(count.max(initial=0), 4 * self.m))
        more = np.full((len(touched), widest), -1, dtype=np.int32)
        place = np.arange(len(target)) - np.repeat(first, count)
        fits = place < widest
        more[np.repeat(np.arange(len(touched)), count)[fits], place[fits]] = source[fits]
        few = max(1, ROOM // 8 // ((self.m + widest) * max(self.m + widest, 4 * self.x.shape[1])))
        for k in range(0, len(touched), few):
            t, ids = touched[k : k + few], np.concatenate([self.links[touched[k : k + few]], more[k : k + few]], 1)
            again = (ids[:, :, None] == ids[:, None, :]) & (np.arange(ids.shape[1])[:, None] > np.arange(ids.shape[1]))
            ids = np.where(again.any(axis=2), -1, ids)
            sims = np.where(ids >= 0, np.einsum("rd,rjd->rj", self.x[t], self.x[np.maximum(ids, 0)]), -2)
            best = _top(sims, min(ids.shape[1], 2 * self.m))
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            full = (ids >= 0).sum(axis=1) > self.m
            self.links[t[~full]] = ids[~full][:, : self.m]
            if full.any():
                self.links[t[full]] = select_diverse(self.x, ids[full], sims[full], self.m)

    def start(self, q: np.ndarray) -> np.ndarray:
        """The nearest of the first SCAN nodes, as entry points while the layer is built."""
        return (q @ self.x[: min(SCAN, self.size)].T).argmax(axis=1)

    def search(self, q: np.ndarray, ef: int, entry: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of a beam of ``ef`` for each query, nearest first; -1 and -2 where there are fewer."""
        n, ef = len(q), min(ef, self.size)
        ids, sims = np.full((n, ef), -1, dtype=np.int64), np.full((n, ef), -2, dtype=np.float32)
        open_ = np.zeros((n, ef), dtype=bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("rd,rd->r", q, self.x[entry]), True
        seen = np.zeros((n, self.size), dtype=bool)
        seen[np.arange(n), entry] = True
        live = np.arange(n)
        while len(live):
            o = open_[live]
            rank = np.cumsum(o, axis=1)
            pick = o & (rank <= step)
            row, col = np.nonzero(pick)
            open_[live[row], col] = False
            found = self.links[ids[live[row], col]]
            row = np.repeat(row, found.shape[1])
            found = found.ravel()
            fresh = found >= 0
            row, found = row[fresh], found[fresh]
            fresh = ~seen[live[row], found]
            keys = np.sort(row[fresh] * self.size + found[fresh])
            keys = keys[np.diff(keys, prepend=-1) > 0]
            row, found = keys // self.size, keys % self.size
            seen[live[row], found] = True
            if len(keys):
                new = np.einsum("rd,rd->r", q[live[row]], self.x[found])
                count = np.bincount(row, minlength=len(live))
                place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                width = int(count.max())
                wide_ids, wide_sims = np.full((len(live), width), -1, dtype=np.int64), np.full((len(live), width), -2, dtype=np.float32)
                wide_ids[row, place], wide_sims[row, place] = found, new
                all_ids, all_sims = np.concatenate([ids[live], wide_ids], 1), np.concatenate([sims[live], wide_sims], 1)
                all_open = np.concatenate([open_[live], wide_ids >= 0], 1)
                best = _top(all_sims, ef)
                ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
                open_[live] = np.take_along_axis(all_open, best, 1) & (ids[live] >= 0)
            live = live[open_[live].any(axis=1)]
        return ids, sims


class Graph:
    """Layers of a shard's unit vectors, the lowest first; a node's highest layer is drawn by a fixed seed."""

    def __init__(self, x: np.ndarray, seed: int = 11) -> None:
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(x))) / np.log(M)).astype(int)
        self.layers = []
        for k in range(int(level.max(initial=0)) + 1):
            nodes = np.flatnonzero(level >= k)
            layer = Layer(self.x, nodes, M if k else M0)
            layer.build()
            self.layers.append(layer)
            if len(nodes) <= SCAN:
                break

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Down the layers by short beams, then a beam of ``ef`` in the lowest."""
        q, top = q.astype(np.float32), self.layers[-1]
        at = top.nodes[(q @ top.x[: max(1, min(len(top.x), SCAN))].T).argmax(axis=1)] if len(top.nodes) else np.zeros(len(q), dtype=int)
        for layer in self.layers[-1:0:-1]:
            ids, _ = layer.search(q, 4, np.searchsorted(layer.nodes, at))
            at = layer.nodes[ids[:, 0]]
        return self.layers[0].search(q, ef, at)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The links of all layers, node by node and the lowest layer first, and how many belong to each node."""
        levels = np.zeros(len(self.x), dtype=np.int64)
        for layer in self.layers[1:]:
            levels[layer.nodes] += 1
        counts = M0 + M * levels
        ends = np.cumsum(counts)
        flat = np.empty(int(counts.sum()), dtype=np.int32)
        for k, layer in enumerate(self.layers):
            flat[self._places(ends - counts, layer.nodes, k)] = layer.links
        return flat, counts

    @staticmethod
    def _places(starts: np.ndarray, nodes: np.ndarray, k: int) -> np.ndarray:
        """Where ``rows`` has the links of these nodes in layer ``k``."""
        return starts[nodes][:, None] + (np.arange(M) + M0 + M * (k - 1) if k else np.arange(M0))

    @classmethod
    def from_rows(cls, x: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> Graph:
        """The graph over unit vectors ``x`` from what ``rows`` gave."""
        own = cls.__new__(cls)
        own.x, own.layers = np.ascontiguousarray(x, dtype=np.float32), []
        levels, starts = (counts - M0) // M, np.cumsum(counts) - counts
        for k in range(int(levels.max(initial=0)) + 1):
            layer = Layer(own.x, np.flatnonzero(levels >= k), M if k else M0)
            layer.links, layer.size = flat[cls._places(starts, layer.nodes, k)], len(layer.nodes)
            own.layers.append(layer)
        return own

    def dump(self) -> bytes:
        out, (flat, counts) = io.BytesIO(), self.rows()
        np.savez(out, x=self.x, flat=flat, counts=counts)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as z:
            return cls.from_rows(z["x"], z["flat"], z["counts"])
