"""A navigable small-world graph over unit vectors, built and searched many vectors at a time.

Vectors stand in a random order; layer l holds the first n / 16^l of them, so the nodes of a layer are those of
geometrically drawn levels. The top layer is small and scanned whole; each layer below is a graph of DEGREE neighbours,
grown by batches that at most double it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEGREE = 24
SHRINK, TOP_NODES = 16, 256
#: Beam of insertions; open nodes of a beam that one step expands; entry points of a layer.
BUILD_BEAM, STEP, ENTRIES = 32, 4, 4
#: Queries of one lockstep search, most rows inserted at once.
TOGETHER, BATCH = 256, 1024


def _best(ids: np.ndarray, sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` most similar of each row (unordered): positions, ids, similarities."""
    if sims.shape[1] <= keep:
        at = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    else:
        at = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
    return at, np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)


def _beam(near: np.ndarray, x: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and similarities of the ``width`` best nodes that a best-first search meets, for each query."""
    met = np.zeros((len(q), len(x)), bool)
    rows = np.arange(len(q))
    np.put_along_axis(met, entries, True, 1)
    sims = np.einsum("qd,qed->qe", q, x[entries])
    ids, open_ = entries, np.ones(entries.shape, bool)
    if ids.shape[1] < width:
        more = width - ids.shape[1]
        ids = np.pad(ids, ((0, 0), (0, more)), constant_values=-1)
        sims = np.pad(sims, ((0, 0), (0, more)), constant_values=-np.inf)
        open_ = np.pad(open_, ((0, 0), (0, more)))
    while len(rows):
        waiting = np.where(open_[rows], sims[rows], -np.inf)
        at = np.argpartition(-waiting, min(STEP, width) - 1, axis=1)[:, :STEP] if width > STEP else np.broadcast_to(np.arange(width), waiting.shape)
        live = np.isfinite(np.take_along_axis(waiting, at, 1))
        go = live.any(1)
        rows, at, live = rows[go], at[go], live[go]
        if not len(rows):
            break
        chosen = np.take_along_axis(ids[rows], at, 1)
        open_[rows[:, None], at] = False
        found = np.where(live[:, :, None], near[np.maximum(chosen, 0)], -1).reshape(len(rows), -1)
        found.sort(axis=1)
        fresh = found >= 0
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        safe = np.maximum(found, 0)
        fresh &= ~met[rows[:, None], safe]
        r, c = np.nonzero(fresh)
        met[rows[r], safe[r, c]] = True
        new = np.full(found.shape, -np.inf, np.float32)
        new[r, c] = np.einsum("nd,nd->n", q[rows[r]], x[safe[r, c]])
        all_ids, all_sims = np.concatenate([ids[rows], found], 1), np.concatenate([sims[rows], new], 1)
        at, ids[rows], sims[rows] = _best(all_ids, all_sims, width)
        open_[rows] = np.take_along_axis(np.concatenate([open_[rows], fresh], 1), at, 1)
    return np.where(np.isfinite(sims), ids, -1), sims


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """DEGREE neighbours of each row out of candidates (-1: none): nearest first, those nearer to a chosen one than to
    the row only where places are left."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    v = x[np.maximum(ids, 0)]
    among = v @ v.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        nearer = np.where(chosen, among[:, c], -np.inf).max(1) > sims[:, c]
        chosen[:, c] = (ids[:, c] >= 0) & ~nearer & (chosen.sum(1) < DEGREE)
    order = np.argsort(np.where(chosen, 0, 1) + np.where(ids < 0, 2, 0), axis=1, kind="stable")[:, :DEGREE]
    picked = np.take_along_axis(ids, order, 1)
    if picked.shape[1] < DEGREE:
        picked = np.pad(picked, ((0, 0), (0, DEGREE - picked.shape[1])), constant_values=-1)
    return picked.astype(np.int32)


def _link_back(near: np.ndarray, x: np.ndarray, new: np.ndarray) -> None:
    """Adds the edges from the neighbours of the ``new`` nodes to them, choosing again where there are too many."""
    u = np.repeat(new, DEGREE)
    v = near[new].ravel()
    u, v = u[v >= 0], v[v >= 0].astype(np.int64)
    touched = np.unique(v)
    old = near[touched]
    v = np.concatenate([v, np.repeat(touched, DEGREE)[old.ravel() >= 0]])
    u = np.concatenate([u, old.ravel()[old.ravel() >= 0]])
    sims = np.einsum("nd,nd->n", x[u], x[v])
    order = np.lexsort((-sims, v))
    u, v, sims = u[order], v[order], sims[order]
    starts = np.searchsorted(v, touched)
    at = np.arange(len(v)) - np.repeat(starts, np.diff(np.append(starts, len(v))))
    fits = at < 2 * DEGREE  # the nearest; the choice takes DEGREE of them
    row = np.searchsorted(touched, v)
    ids = np.full((len(touched), 2 * DEGREE), -1, np.int64)
    all_sims = np.full(ids.shape, -np.inf, np.float32)
    ids[row[fits], at[fits]], all_sims[row[fits], at[fits]] = u[fits], sims[fits]
    for part in np.array_split(np.arange(len(touched)), -(-len(touched) // BATCH)):
        near[touched[part]] = _diverse(x, ids[part], all_sims[part])


@dataclass
class Graph:
    """Vectors (float32) and the layers' neighbours, the bottom layer first; the top layer has no graph."""

    x: np.ndarray
    layers: list[np.ndarray]

    @staticmethod
    def sizes(n: int) -> list[int]:
        found = [n]
        while found[-1] > TOP_NODES:
            found.append(max(1, found[-1] // SHRINK))
        return found

    @staticmethod
    def build(x: np.ndarray) -> Graph:
        graph = Graph(x, [])
        *below, top = Graph.sizes(len(x))
        for n in reversed(below):
            near = np.full((n, DEGREE), -1, np.int32)
            graph.layers.insert(0, near)
            done = top = min(n, max(top, TOP_NODES))
            sims = x[:done] @ x[:done].T
            np.fill_diagonal(sims, -np.inf)
            _, ids, best = _best(np.broadcast_to(np.arange(done), sims.shape), sims, BUILD_BEAM)
            near[:done] = _diverse(x, np.where(np.isfinite(best), ids, -1), best)
            _link_back(near, x, np.arange(done))
            while done < n:
                new = np.arange(done, min(n, done + min(done, BATCH)))
                ids, sims = graph.search(x[new], BUILD_BEAM, 0)
                own = x[new] @ x[new].T
                np.fill_diagonal(own, -np.inf)
                _, beside, own = _best(np.broadcast_to(new, own.shape), own, DEGREE // 2)
                beside = np.where(np.isfinite(own), beside, -1)
                near[new] = _diverse(x, np.concatenate([ids, beside], 1), np.concatenate([sims, own], 1))
                _link_back(near, x, new)
                done = new[-1] + 1
        return graph

    def search(self, queries: np.ndarray, width: int, bottom: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and similarities of the ``width`` best nodes met of each query, unordered."""
        top = Graph.sizes(len(self.x) if not self.layers else len(self.layers[-1]))[1:] or [len(self.x)]
        out = []
        for at in range(0, len(queries), TOGETHER):
            q = queries[at : at + TOGETHER]
            scanned = self.x[: top[0]]
            sims = q @ scanned.T
            if not self.layers:
                _, ids, sims = _best(np.broadcast_to(np.arange(len(scanned)), sims.shape), sims, width)
                ids = ids.copy()
            for number, near in reversed(list(enumerate(self.layers))):
                if number == len(self.layers) - 1:
                    _, ids, _ = _best(np.broadcast_to(np.arange(len(scanned)), sims.shape), sims, ENTRIES)
                else:
                    _, ids, _ = _best(ids, sims, ENTRIES)
                    ids = np.where(ids < 0, 0, ids)
                ids, sims = _beam(near, self.x[: len(near)], q, np.ascontiguousarray(ids), width if number == bottom else 2 * ENTRIES)
            if ids.shape[1] < width:
                ids = np.pad(ids, ((0, 0), (0, width - ids.shape[1])), constant_values=-1)
                sims = np.pad(sims, ((0, 0), (0, width - sims.shape[1])), constant_values=-np.inf)
            out.append((ids, sims))
        return np.concatenate([i for i, _ in out]), np.concatenate([s for _, s in out])
