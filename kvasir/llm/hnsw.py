"""Hierarchical navigable small-world graphs over unit vectors, searched for many queries in step (NumPy only).

Vectors are put in a random order; layer l has the first n / M**l of them, so each layer is a prefix of the
one below and neighbours are plain row numbers. Layers are built from the top: a batch of rows searches
what is built, and each row keeps diverse neighbours (one that is nearer to a kept neighbour than to the
row is only kept if there is room), which keeps tight groups of copies reachable from outside.
"""

from __future__ import annotations

import io

import numpy as np

M, M0, EF_BUILD, EXPAND, BATCH = 12, 24, 48, 4, 512
#: How far below the threshold neighbours are still followed, as the way between two hits may lead past it.
SLACK = 0.05


def _diverse(vecs: np.ndarray, base: np.ndarray, cand: np.ndarray, sims: np.ndarray, room: int) -> np.ndarray:
    """For each row its ``room`` neighbours of the candidates, which are in descending similarity; -1 is none."""
    none = cand < 0
    between = np.einsum("rcd,red->rce", vecs[cand], vecs[cand], optimize=True)
    keep = np.zeros(cand.shape, bool)
    keep[:, 0] = ~none[:, 0]
    for j in range(1, cand.shape[1]):
        nearest = np.where(keep[:, :j], between[:, j, :j], -2.0).max(axis=1)
        keep[:, j] = ~none[:, j] & (nearest < sims[:, j])
    # Kept ones first, then the nearest of the others.
    rank = np.argsort(np.where(none, 2, np.where(keep, 0, 1)), axis=1, kind="stable")[:, :room]
    out = np.take_along_axis(cand, rank, axis=1)
    if out.shape[1] < room:
        out = np.pad(out, ((0, 0), (0, room - out.shape[1])), constant_values=-1)
    return out


def beam(vecs: np.ndarray, adj: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sims, visited): each query's best ``ef`` rows found from its entry row, best first."""
    q, n = len(queries), len(adj)
    visited = np.zeros((q, n + 1), bool)
    visited[:, n] = True
    at = np.arange(q)
    visited[at, entry] = True
    ids, sims, done = np.full((q, ef), n), np.full((q, ef), -np.inf, np.float32), np.ones((q, ef), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("qd,qd->q", vecs[entry], queries), False
    active = at
    width = min(EXPAND, ef)
    while len(active):
        pick = np.argsort(done[active], axis=1, kind="stable")[:, :width]
        rows = active[:, None]
        fresh = ~done[rows, pick]
        some = fresh.any(axis=1)
        if not some.all():
            active, pick, fresh = active[some], pick[some], fresh[some]
            rows = active[:, None]
            if not len(active):
                break
        done[rows, pick] = True
        source = np.where(fresh, ids[rows, pick], -1)
        near = adj[source]
        near[source < 0] = -1
        near = np.sort(near.reshape(len(active), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[near < 0] = n
        near[visited[rows, near]] = n
        visited[rows, near] = True
        # Columns in which no query has anything new aren't compared.
        near = np.sort(near, axis=1)
        near = near[:, : max(1, int((near < n).sum(axis=1).max()))]
        new = np.einsum("qmd,qd->qm", vecs[np.minimum(near, len(vecs) - 1)], queries[active])
        new[near == n] = -np.inf
        all_ids, all_sims = np.concatenate((ids[active], near), axis=1), np.concatenate((sims[active], new), axis=1)
        all_done = np.concatenate((done[active], near == n), axis=1)
        if all_sims.shape[1] > ef:
            top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            all_ids, all_sims, all_done = (np.take_along_axis(x, top, axis=1) for x in (all_ids, all_sims, all_done))
        order = np.argsort(-all_sims, axis=1, kind="stable")
        ids[active], sims[active], done[active] = (np.take_along_axis(x, order, axis=1) for x in (all_ids, all_sims, all_done))
    return ids, sims, visited


class Graph:
    def __init__(self, vecs: np.ndarray, layers: list[np.ndarray], ef: int = 12):
        self.vecs, self.layers, self.ef = vecs, layers, ef  # an ef of 0: all rows are compared

    def entry(self, queries: np.ndarray, above: int = 0) -> np.ndarray:
        """The row near each query that the layers over ``above`` lead to."""
        at = np.zeros(len(queries), np.int64)
        for adj in self.layers[:above:-1]:
            ids, _, _ = beam(self.vecs, adj, queries, at, 4)
            at = ids[:, 0]
        return at

    @classmethod
    def build(cls, vecs: np.ndarray) -> Graph:
        """A graph of unit vectors (float32), which are in random order."""
        sizes = [len(vecs)]
        while sizes[-1] > 4 * M:
            sizes.append(-(-sizes[-1] // M))
        self = cls(vecs, [np.zeros((0, M0), np.int64)] * len(sizes))
        for layer in range(len(sizes) - 1, -1, -1):
            self._fill(layer, sizes)
        return self

    def _fill(self, layer: int, sizes: list[int]) -> None:
        n, room = sizes[layer], M0 if layer == 0 else M
        adj, vecs = np.full((n, room), -1, np.int64), self.vecs
        placed = 0
        while placed < n:
            end = min(n, max(64, placed + min(BATCH, max(placed, 1))))
            rows = np.arange(placed, end)
            own = vecs[rows]
            near = own @ own.T
            near[np.arange(len(rows)), np.arange(len(rows))] = -np.inf
            k = min(M0, len(rows) - 1)
            cand, sims = np.zeros((len(rows), 0), np.int64), np.zeros((len(rows), 0), np.float32)
            if k > 0:
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                cand, sims = rows[top], np.take_along_axis(near, top, axis=1)
            if placed:
                start = self.entry(own, layer)
                ids, s, _ = beam(vecs, adj[:placed], own, np.where(start < placed, start, 0), EF_BUILD)
                ids[~np.isfinite(s)] = -1
                cand, sims = np.concatenate((cand, ids), axis=1), np.concatenate((sims, s), axis=1)
            if cand.shape[1]:
                order = np.argsort(-sims, axis=1, kind="stable")[:, : EF_BUILD + M0]
                cand, sims = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sims, order, axis=1)
                adj[rows, :room] = _diverse(vecs, rows, cand, sims, room)
                self._link_back(adj, rows, room)
            placed = end
        self.layers[layer] = adj

    def _link_back(self, adj: np.ndarray, rows: np.ndarray, room: int) -> None:
        """Make the rows' new links two-way; lists that overflow keep diverse neighbours."""
        vecs = self.vecs
        to, frm = adj[rows].ravel(), np.repeat(rows, room)
        frm, to = frm[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(to)])))
        rank = np.arange(len(to)) - np.repeat(starts, sizes)
        fits = rank < 2 * room  # of more newcomers than twice the room, the batch's first ones
        targets = to[starts]
        extra = np.full((len(targets), min(2 * room, int(sizes.max()))), -1, np.int64)
        extra[np.repeat(np.arange(len(targets)), sizes)[fits], rank[fits]] = frm[fits]
        for at in range(0, len(targets), BATCH):
            t = targets[at : at + BATCH]
            cand = np.sort(np.concatenate((adj[t], extra[at : at + BATCH]), axis=1), axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            sims = np.einsum("rcd,rd->rc", vecs[cand], vecs[t])
            sims[cand < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")
            cand, sims = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sims, order, axis=1)
            few = (cand >= 0).sum(axis=1) <= room
            adj[t[few]] = cand[few, :room]
            if not few.all():
                adj[t[~few]] = _diverse(vecs, t[~few], cand[~few], sims[~few], room)

    def within(self, queries: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        """For each query the rows found with a similarity of its ``least`` or more.

        From what the beam finds, all neighbours that are near enough, or nearly so, are followed, so that
        groups larger than the beam come whole.
        """
        out: list[np.ndarray] = []
        for at in range(0, len(queries), BATCH):
            q, bound = queries[at : at + BATCH], least[at : at + BATCH]
            if not self.ef:
                out += [np.flatnonzero(s >= x) for s, x in zip(q @ self.vecs.T, bound, strict=True)]
                continue
            ids, sims, visited = beam(self.vecs, self.layers[0], q, self.entry(q), self.ef)
            near_hits = sims >= (bound - SLACK)[:, None]
            for i in range(len(q)):
                if not near_hits[i, 0]:
                    out.append(np.zeros(0, np.int64))
                    continue
                front = ids[i][near_hits[i]]
                found = [front[sims[i][near_hits[i]] >= bound[i]]]
                if near_hits[i, -1]:  # the beam is full of them: there may be more that it dropped
                    visited[i, :-1] = False
                    visited[i, front] = True
                while len(front):
                    near = self.layers[0][front].ravel()
                    near = near[near >= 0]
                    near = np.unique(near[~visited[i, near]])
                    visited[i, near] = True
                    s = self.vecs[near] @ q[i]
                    front = near[s >= bound[i] - SLACK]
                    found.append(near[s >= bound[i]])
                out.append(np.concatenate(found))
        return out

    def audit(self, least: float, wanted: float, queries: int = 256, seed: int = 7) -> float:
        """Widen the beam until the recall of audit queries is ``wanted``; returns the recall.

        One half of the queries are rows, the other half rows turned away until they are just near enough. What
        they must find is known by brute force. Recall is each query's own, averaged over each half, so a group
        of many near rows has no more weight than a row alone. Where even a beam of all rows doesn't do, as in
        a graph that has fallen apart, all rows are compared from then on.
        """
        rng, n = np.random.default_rng(seed), len(self.vecs)
        pick = rng.choice(n, min(n, queries), replace=False)
        base = self.vecs[pick]
        noise = rng.normal(size=base.shape).astype(np.float32)
        noise -= np.einsum("qd,qd->q", noise, base)[:, None] * base
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        turned = min(1.0, least + 1e-3)
        probe = (turned * base + np.sqrt(1 - turned**2) * noise).astype(np.float32)
        both = np.concatenate((probe, base))
        truth = [np.flatnonzero(self.vecs @ v >= least) for v in both]
        while True:
            got = self.within(both, np.full(len(both), least, np.float32))
            each = np.array([len(np.intersect1d(a, b)) / max(1, len(a)) if len(a) else 1.0 for a, b in zip(truth, got, strict=True)])
            recall = float(min(each[: len(base)].mean(), each[len(base) :].mean()))
            if recall >= wanted:
                return recall
            self.ef = 0 if self.ef >= n else min(n, 2 * self.ef)

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, ef=self.ef, **{f"l{i}": a.astype(np.int32) for i, a in enumerate(self.layers)})
        return f.getvalue()

    @classmethod
    def load(cls, blob: bytes, vecs: np.ndarray) -> Graph:
        z = np.load(io.BytesIO(blob))
        return cls(vecs, [z[f"l{i}"].astype(np.int64) for i in range(len(z.files) - 1)], int(z["ef"]))
