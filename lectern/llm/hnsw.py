"""Hierarchical navigable small-world graph on flat neighbour arrays.

Nodes are inserted layer by layer, those of the higher layers first, in batches that are searched in lockstep: one
step expands the best open nodes of every query of the batch at once. A node keeps up to ``2 * links`` neighbours, one row of
an integer array; rows of unit vectors are compared by their inner product.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

NONE = -1
#: Marks of nodes seen, one for each query and node, that a search holds at a time.
MARKED = 1 << 25


def _ranked(rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, ids, sims): per row the ``keep`` best of a flat list, padded, in descending order."""
    order = np.lexsort((ids, -sims, rows))
    rows, ids, sims = rows[order], ids[order], sims[order]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    nth = np.arange(len(rows)) - at[group]
    ok = nth < keep
    out_ids = np.full((len(at), keep), NONE, dtype=np.int32)
    out_sims = np.full((len(at), keep), -np.inf, dtype=np.float32)
    out_ids[group[ok], nth[ok]] = ids[ok]
    out_sims[group[ok], nth[ok]] = sims[ok]
    return rows[at], out_ids, out_sims


def _best(ids: np.ndarray, sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best columns of every row, in descending order, and where they were."""
    rows, width = np.arange(len(sims))[:, None], sims.shape[1]
    worst_first = np.negative(sims)
    if width > keep:
        part = np.argpartition(worst_first, keep - 1, axis=1)[:, :keep]
        inner = np.argsort(np.take(worst_first, part + rows * width), axis=1, kind="stable")
        order = np.take(np.ascontiguousarray(part), inner + rows * keep)
    else:
        order = np.argsort(worst_first, axis=1, kind="stable")
    flat = order + rows * width
    return np.take(ids, flat), np.take(sims, flat), order


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, ascending; sorts in place."""
    keys.sort()
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


@dataclass
class Layer:
    """Neighbours of the nodes of one layer; nodes are the first ``len(neighbours)`` rows of the vectors."""

    neighbours: np.ndarray
    sims: np.ndarray
    size: int = 0

    def search(self, x: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, width: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sims) of the ``ef`` best nodes found for every query, from its entry nodes; best first."""
        step = max(16, MARKED // max(1, self.size))
        parts = [self._search(x, q[at : at + step], entry[at : at + step], ef, width) for at in range(0, len(q), step)]
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(p) for p in zip(*parts))

    def _search(self, x: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, count = self.size, len(q)
        seen = np.zeros(count * n, dtype=bool)
        ids = np.full((count, ef), NONE, dtype=np.int32)
        sims = np.full((count, ef), -np.inf, dtype=np.float32)
        done = np.ones((count, ef), dtype=bool)
        rows, at = np.nonzero(entry >= 0)
        keys = _distinct(rows * n + entry[rows, at])
        live = np.arange(count)
        while len(keys):
            seen[keys] = True
            r, v = keys // n, keys % n
            s = np.einsum("nd,nd->n", np.take(x, v, axis=0), np.take(q, r, axis=0))
            better = s > sims[r, -1]
            r, v, s = r[better], v[better], s[better]
            if len(r):
                touched, new_ids, new_sims = self._padded(r, v, s)
                all_ids = np.concatenate([ids[touched], new_ids], 1)
                all_sims = np.concatenate([sims[touched], new_sims], 1)
                all_done = np.concatenate([done[touched], new_ids < 0], 1)
                ids[touched], sims[touched], order = _best(all_ids, all_sims, ef)
                done[touched] = np.take_along_axis(all_done, order, 1)
            live = live[~done[live].all(1)]
            if not len(live):
                break
            nth = np.cumsum(~done[live], axis=1)
            pick = ~done[live] & (nth <= width)  # rows are sorted: the first open ones are the best
            row, column = np.nonzero(pick)
            row = live[row]
            done[row, column] = True
            near = np.take(self.neighbours, ids[row, column], axis=0)
            keys = (row[:, None] * n + near)[near >= 0]
            keys = _distinct(keys[~np.take(seen, keys)])
        return ids, sims

    @staticmethod
    def _padded(r: np.ndarray, v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])  # keys are sorted, so rows are together
        counts = np.diff(np.r_[first, len(r)])
        group = np.repeat(np.arange(len(first)), counts)
        nth = np.arange(len(r)) - first[group]
        ids = np.full((len(first), counts.max()), NONE, dtype=np.int32)
        sims = np.full(ids.shape, -np.inf, dtype=np.float32)
        ids[group, nth], sims[group, nth] = v, s
        return r[first], ids, sims

    def link(self, x: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, links: int) -> None:
        """Give new nodes diverse neighbours out of their candidates, and the candidates the reverse links."""
        ids, sims = ids[:, : 2 * links], sims[:, : 2 * links]
        vectors = x[np.maximum(ids, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        kept = np.zeros(ids.shape, dtype=bool)
        for j in range(ids.shape[1]):
            close = np.where(kept, between[:, j], -np.inf).max(1) if j else np.full(len(ids), -np.inf)
            kept[:, j] = (ids[:, j] >= 0) & (close < sims[:, j]) & (kept.sum(1) < links)
        kept[:, : links // 4] |= ids[:, : links // 4] >= 0  # the nearest in any case
        row, column = np.nonzero(kept)
        source, target, sim = new[row], ids[row, column], sims[row, column]
        room = self.neighbours.shape[1]
        for a, b in ((source, target), (target, source)):
            nodes, more_ids, more_sims = _ranked(a, b, sim, room)
            all_ids = np.concatenate([self.neighbours[nodes], more_ids], 1)
            all_sims = np.concatenate([self.sims[nodes], more_sims], 1)
            self.neighbours[nodes], self.sims[nodes], _ = _best(all_ids, all_sims, room)


class Graph:
    """Graph over the rows of a matrix of unit vectors."""

    def __init__(self, x: np.ndarray, order: np.ndarray, layers: list[Layer], links: int):
        self.x, self.order, self.layers, self.links = x, order, layers, links

    @classmethod
    def build(
        cls, vectors: np.ndarray, keep: int, links: int = 16, ef: int = 96, batch: int = 3_072, seed: int = 0, searched: bool = True
    ) -> tuple[Graph, np.ndarray, np.ndarray]:
        """(graph, ids, sims): also the ``keep`` nearest other rows of every row as met during the insertion.

        Each insertion meets the nearest of the earlier nodes and is itself met by later ones, so that one search
        for each row serves both sides of every pair. The rows of a batch are compared with each other in one product.
        A graph that will not be searched later goes without the links of its last batch.
        """
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1.0 - rng.random(n)) / np.log(links)).astype(np.int64)
        order = np.lexsort((rng.random(n), -level))  # neighbours in the matrix must not be inserted together
        x = np.ascontiguousarray(vectors[order], dtype=np.float32)
        sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        while len(sizes) > 1 and sizes[-1] < 4 * links:
            sizes.pop()
        layers: list[Layer] = []
        graph = cls(x, order, layers, links)
        best_ids = np.full((n, keep), NONE, dtype=np.int32)
        best_sims = np.full((n, keep), -np.inf, dtype=np.float32)
        for size in reversed(sizes):
            layer = Layer(np.full((size, 2 * links), NONE, dtype=np.int32), np.full((size, 2 * links), -np.inf, dtype=np.float32))
            base = size == sizes[0]
            start = 0
            while start < size:
                stop = min(size, start + batch, max(batch, 2 * start) if start else batch)
                new = np.arange(start, stop)
                among = x[new] @ x[new].T
                np.fill_diagonal(among, -np.inf)
                ids = np.broadcast_to(new.astype(np.int32), among.shape)
                ids, sims, _ = _best(ids, among, min(ef, len(new)))
                ids = np.where(np.isfinite(sims), ids, NONE)
                if start:
                    entry = graph._entry(x[new], len(layers))
                    entry = np.where(entry < start, entry, NONE) if entry.shape[1] else entry
                    entry = np.concatenate([entry, np.zeros((len(new), 1), dtype=np.int32)], 1)
                    old_ids, old_sims = layer.search(x, x[new], entry, ef)
                    ids, sims, _ = _best(np.concatenate([old_ids, ids], 1), np.concatenate([old_sims, sims], 1), ef)
                layer.size = stop
                if searched or stop < size or not base:
                    layer.link(x, new, ids, sims, links)
                if base:
                    graph._meet(new, ids, sims, best_ids, best_sims)
                start = stop
            layers.append(layer)
        back = np.empty(n, dtype=np.int64)
        back[order] = np.arange(n)
        ids = best_ids[back]
        return graph, np.where(ids >= 0, order[np.maximum(ids, 0)], NONE), best_sims[back]

    def _meet(self, new, ids, sims, best_ids, best_sims) -> None:
        keep = best_ids.shape[1]
        best_ids[new], best_sims[new] = ids[:, :keep] if ids.shape[1] >= keep else np.pad(ids, ((0, 0), (0, keep - ids.shape[1])), constant_values=NONE), (
            sims[:, :keep] if sims.shape[1] >= keep else np.pad(sims, ((0, 0), (0, keep - sims.shape[1])), constant_values=-np.inf)
        )
        row, column = np.nonzero((ids >= 0) & (ids < new[0]))
        target, sim = ids[row, column], sims[row, column]
        ok = sim > best_sims[target, -1]
        nodes, more_ids, more_sims = _ranked(target[ok], new[row[ok]], sim[ok], keep)
        if len(nodes):
            all_ids = np.concatenate([best_ids[nodes], more_ids], 1)
            all_sims = np.concatenate([best_sims[nodes], more_sims], 1)
            best_ids[nodes], best_sims[nodes], _ = _best(all_ids, all_sims, keep)

    def _entry(self, q: np.ndarray, layers: int) -> np.ndarray:
        """Entry nodes for the layer below the first ``layers`` ones, by descent through these."""
        entry = np.zeros((len(q), 0), dtype=np.int32)
        for layer in self.layers[:layers]:
            start = entry if entry.shape[1] else np.zeros((len(q), 1), dtype=np.int32)
            entry = layer.search(self.x, q, start, 8, 2)[0][:, :4]
        return entry

    def search(self, queries: np.ndarray, keep: int, ef: int = 96, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(rows, sims) of the nearest rows of the matrix for every query; best first, padded."""
        keep_ids, keep_sims = [], []
        for at in range(0, len(queries), batch):
            q = np.ascontiguousarray(queries[at : at + batch], dtype=np.float32)
            entry = self._entry(q, len(self.layers) - 1)
            entry = np.concatenate([entry, np.zeros((len(q), 1), dtype=np.int32)], 1)
            ids, sims = self.layers[-1].search(self.x, q, entry, max(ef, keep))
            keep_ids.append(np.where(ids[:, :keep] >= 0, self.order[np.maximum(ids[:, :keep], 0)], NONE))
            keep_sims.append(sims[:, :keep])
        if not keep_ids:
            return np.zeros((0, keep), dtype=np.int64), np.zeros((0, keep), dtype=np.float32)
        return np.concatenate(keep_ids), np.concatenate(keep_sims)

    def to_bytes(self) -> bytes:
        """The flat arrays of the graph."""
        out = io.BytesIO()
        arrays = {f"layer{i}": layer.neighbours for i, layer in enumerate(self.layers)}
        np.savez(out, x=self.x, order=self.order, links=self.links, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        """The graph of such arrays."""
        held = np.load(io.BytesIO(data))
        layers = []
        while f"layer{len(layers)}" in held:
            near = held[f"layer{len(layers)}"]
            layers.append(Layer(near, np.zeros((0, 0), np.float32), len(near)))
        return cls(held["x"], held["order"], layers, int(held["links"]))
