"""Groups of near-equal unit vectors as balls, and the links between two balls without comparing all their pairs.

A ball is a centre and its members with their angles to it. By the triangle inequality two members are linked
for certain if their angles and the one between the centres add up to no more than the threshold's, and not
linked if no sum or difference of these allows it; only what is left is compared, in blocks of matrix products.
"""

from __future__ import annotations

import numpy as np

#: Members of a ball are at least this similar to the vector that the ball began with.
TIGHT = 0.975
#: Rounding of an angle; what is nearer to a bound than this is compared.
MARGIN = 1e-5
BLOCK = 2048


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def gather(unit: np.ndarray, tables: int = 8, bits: int = 14, seed: int = 3) -> np.ndarray:
    """For each row the row of the ball it belongs to: itself, or one before it that is TIGHT to it.

    Rows with the same signs on random directions meet the first of them that is in no other ball.
    """
    n, dim = unit.shape
    ball, rng = np.arange(n), np.random.default_rng(seed)
    led = np.zeros(n, bool)
    for _ in range(tables):
        signs = (unit @ rng.normal(size=(dim, bits)).astype(np.float32)) > 0
        code = signs @ (1 << np.arange(bits))
        free = np.flatnonzero(ball == np.arange(n))
        order = free[np.argsort(code[free], kind="stable")]
        first = np.concatenate(([True], code[order][1:] != code[order][:-1])) if len(order) else np.zeros(0, bool)
        lead = order[first][np.cumsum(first) - 1]
        near = (order != lead) & ~led[order] & (np.einsum("nd,nd->n", unit[order], unit[lead]) >= TIGHT)
        ball[order[near]] = lead[near]
        led[lead[near]] = True
    return ball


class Ball:
    """Members' unit vectors in double precision, ids and weights, by ascending angle to the centre."""

    def __init__(self, exact: np.ndarray, reps: np.ndarray, sizes: np.ndarray):
        centre = exact.sum(axis=0)
        norm = np.linalg.norm(centre)
        self.centre = centre / norm if norm > 0 else exact[0]
        theta = angle(exact @ self.centre) if len(exact) > 1 else np.zeros(1)
        order = np.lexsort((reps, theta))
        self.exact, self.reps, self.sizes, self.theta = exact[order], reps[order], sizes[order], theta[order]
        self.radius = float(self.theta[-1])
        self.upto = np.concatenate(([0], np.cumsum(self.sizes)))


def _components(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least row of the component of each row and column of a block of links."""
    none = len(hits)
    rows = np.where(hits.any(axis=1), np.arange(none), none)
    while True:
        cols = np.where(hits, rows[:, None], none).min(axis=0)
        again = np.minimum(rows, np.where(hits, cols[None, :], none).min(axis=1))
        if (again == rows).all():
            return rows, cols
        rows = again


def link(a: Ball, b: Ball, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(for each member of a the weight of b's members linked with it, edges that join what is linked).

    A member isn't linked with itself, where a and b have one.
    """
    most, between = float(np.arccos(threshold)), float(angle(a.centre @ b.centre))
    # Of b, by angle: the first ``sure`` are linked for certain; those before ``near`` or from ``far`` on can't be.
    sure = np.searchsorted(b.theta, most - between - a.theta - MARGIN, side="right")
    near = np.searchsorted(b.theta, between - most - a.theta - MARGIN, side="left")
    far = np.searchsorted(b.theta, most + between + a.theta + MARGIN, side="right")
    weight, edges = b.upto[sure].astype(np.int64), []
    if sure[0]:  # members are by angle, so the first of a has the most, and the first of b is in all
        edges += [(int(x), int(b.reps[0])) for x in a.reps[sure > 0] if x != b.reps[0]]
        edges += [(int(a.reps[0]), int(x)) for x in b.reps[: sure[0]] if x != a.reps[0]]
        by_id = np.argsort(b.reps)
        seat = by_id[np.minimum(np.searchsorted(b.reps, a.reps, sorter=by_id), len(by_id) - 1)]
        weight -= np.where((b.reps[seat] == a.reps) & (seat < sure), b.sizes[seat], 0)
    low, high = np.maximum(sure, near), far
    for i in range(0, len(a.reps), BLOCK):
        rows = slice(i, i + BLOCK)
        begin, end = int(low[rows].min()), int(high[rows].max())
        for j in range(begin, end, BLOCK):
            cols = np.arange(j, min(end, j + BLOCK))
            hits = a.exact[rows] @ b.exact[cols].T >= threshold
            hits &= (cols[None, :] >= low[rows][:, None]) & (cols[None, :] < high[rows][:, None])
            hits &= a.reps[rows][:, None] != b.reps[cols][None, :]
            if not hits.any():
                continue
            weight[rows] += hits @ b.sizes[cols]
            of_row, of_col = _components(hits)
            mine = a.reps[rows]
            edges += [(int(mine[k]), int(mine[r])) for k, r in enumerate(of_row) if r < len(mine) and r != k]
            edges += [(int(mine[r]), int(x)) for x, r in zip(b.reps[cols], of_col, strict=True) if r < len(mine)]
    return weight, edges
