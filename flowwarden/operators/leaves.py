"""Exact nearest neighbours of many queries in one work unit, for vectors of few dimensions.

References are halved along their widest side until a leaf holds at most ``LEAF`` rows, queries likewise into tiles.  A tile
is compared with its nearest leaves first; of the others only those are taken whose box is not farther from some query than
what that query has found.  Distances are summed by difference, dimension by dimension, as box distances are, so that
no leaf is left out by rounding and ties are true ties.
"""

from __future__ import annotations

import numpy as np

LEAF = 64
NEAR = 4  # leaves a tile is compared with first
FEW_DIMENSIONS = 8  # up to these, boxes always leave most leaves out
MOST_LEAVES = 0.3  # share of the leaves left to compare from which a product of all pairs is cheaper


def halved(x: np.ndarray, size: int) -> np.ndarray:
    """Row positions dealt into compact leaves of at most ``size`` rows: ``(leaves, width)``, -1 where a leaf has fewer."""
    levels = max(0, int(np.ceil(np.log2(max(1, len(x)) / size))))
    width = -(-len(x) >> levels) if levels else len(x)
    at = np.arange(width << levels)
    for level in range(levels):
        at = at.reshape(1 << level, -1)
        part = x[np.where(at < len(x), at, 0)]  # what is missing stands in as row 0, and is marked in the end
        widest = np.ptp(part, axis=1).argmax(1)
        side = np.take_along_axis(part, widest[:, None, None], 2)[:, :, 0]
        half = at.shape[1] // 2
        at = np.take_along_axis(at, np.argpartition(side, half, axis=1), 1)
    at = at.reshape(1 << levels, width)
    return np.where(at < len(x), at, -1)


class Leaves:
    """References in leaves.  With ``part`` (a number for each row) no leaf has rows of two parts."""

    def __init__(self, r: np.ndarray, part: np.ndarray | None = None, size: int = LEAF):
        if part is None:
            self.at, self.part = halved(r, size), None
        else:
            found, labels = [], []
            order = np.argsort(part, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                at = halved(r[rows], size)
                at = np.where(at < 0, -1, rows[at])
                found.append(np.pad(at, ((0, 0), (0, max(0, size - at.shape[1]))), constant_values=-1))
                labels += [part[rows[0]]] * len(at)
            self.at, self.part = np.concatenate(found), np.array(labels)
        keep = (self.at >= 0).any(1)
        self.at, self.part = self.at[keep], None if part is None else self.part[keep]
        there = (self.at >= 0)[:, :, None]
        rows = r[self.at]
        self.low, self.high = np.where(there, rows, np.inf).min(1), np.where(there, rows, -np.inf).max(1)
        self.middle = (self.low + self.high) / 2
        rows = np.where(there, rows, np.inf)
        self.sides = [np.ascontiguousarray(rows[:, :, j]) for j in range(r.shape[1])]
        self.width = self.at.shape[1]

    def __len__(self) -> int:
        return len(self.at)

    def to_boxes(self, low: np.ndarray, high: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Least squared distance from each box (or point, if ``low`` is ``high``) to each leaf: ``(boxes, leaves)``."""
        out = np.zeros((len(low), len(leaves)))
        for j in range(low.shape[1]):
            gap = np.maximum(self.low[leaves, j] - high[:, j, None], low[:, j, None] - self.high[leaves, j])
            np.maximum(gap, 0.0, out=gap)
            gap *= gap
            out += gap
        return out

    def to_rows(self, q: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Squared distances to all rows of these leaves; infinite where a leaf has no row."""
        out = np.zeros((len(q), len(leaves) * self.width))
        for j, side in enumerate(self.sides):
            step = np.subtract.outer(q[:, j], side[leaves].ravel())
            step *= step
            out += step
        return out


def _tiles(q: np.ndarray, leaves: Leaves, bounds: np.ndarray, first, allowed: np.ndarray | None):
    """For each tile: its query rows, and pieces ``(leaves, squared distances)``, the nearest leaves first.

    ``first`` gives the bound of each query that its nearest leaves leave.  ``allowed``: queries by parts.
    """
    everything = np.arange(len(leaves))
    for rows in halved(q, LEAF):
        rows = rows[rows >= 0]
        if not len(rows):
            continue
        x = q[rows]
        low, high = x.min(0), x.max(0)
        far = leaves.to_boxes(low[None], high[None], everything)[0]
        if allowed is not None:
            mine = allowed[rows][:, leaves.part]
            far = np.where(mine.any(0), far, np.inf)
        bound = bounds[rows]
        open_ = np.flatnonzero((far <= bound.max()) & np.isfinite(far))
        if not len(open_):
            continue
        apart = ((leaves.middle[open_] - (low + high) / 2) ** 2).sum(1)
        nearest = open_[np.argpartition(apart, NEAR)[:NEAR]] if len(open_) > NEAR else open_

        def piece(chosen):
            d2 = leaves.to_rows(x, chosen)
            if allowed is not None:
                d2.reshape(len(x), len(chosen), -1)[~mine[:, chosen]] = np.inf
            return chosen, d2

        pieces = [piece(nearest)]
        bound = np.minimum(bound, first(pieces[0][1]))
        rest = np.setdiff1d(open_[far[open_] <= bound.max()], nearest, assume_unique=True)
        if len(rest):
            needed = leaves.to_boxes(x, x, rest) <= bound[:, None]
            if allowed is not None:
                needed &= mine[:, rest]
            rest = rest[needed.any(0)]
        yield rows, x, bound, pieces, rest, piece


def worthwhile(q: np.ndarray, leaves: Leaves, bounds: np.ndarray, first) -> bool:
    """Whether leaves leave out enough, by a few tiles of these queries."""
    if q.shape[1] <= FEW_DIMENSIONS:
        return True
    some = np.linspace(0, len(q) - 1, min(len(q), 8)).astype(int)
    left = [len(rest) for i in some for *_, rest, _ in _tiles(q[i:i + 1], leaves, bounds[i:i + 1], first, None)]
    return sum(left) <= MOST_LEAVES * len(leaves) * len(some)


def kth(k: int):
    """The k-th smallest of each row, infinite where there are fewer."""
    def bound(d2):
        return np.partition(d2, k - 1, axis=1)[:, k - 1] if d2.shape[1] >= k else np.full(len(d2), np.inf)

    return bound


def top(q: np.ndarray, leaves: Leaves, bounds: np.ndarray, k: int, allowed: np.ndarray | None = None):
    """Top-k of each query: positions in q, positions of references, squared distances; sorted, ties by position."""
    found, done, held = [], [], 0

    def finish():
        qi, ri, dist = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((ri, dist, qi))
        qi = qi[order]
        first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.zeros(0, int)
        keep = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)])) < k
        done.append((qi[keep], ri[order[keep]], dist[order[keep]]))
        found.clear()

    for rows, x, bound, pieces, rest, piece in _tiles(q, leaves, bounds, kth(k), allowed):
        for low in (-1, *range(0, len(rest), 16)):
            chosen, d2 = pieces[0] if low < 0 else piece(rest[low:low + 16])
            if low < 0:
                pieces.clear()
            at = np.flatnonzero((d2 <= bound[:, None]) & (d2 < np.inf))
            which, column = at // d2.shape[1], at % d2.shape[1]
            ri = leaves.at[chosen[column // leaves.width], column % leaves.width]
            found.append((rows[which], ri, d2.ravel()[at]))
            held += len(at)
        if held > 400_000:
            finish()
            held = 0
    if found:
        finish()
    if not done:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    qi, ri, dist = (np.concatenate(v) for v in zip(*done))
    order = np.argsort(qi, kind="stable")
    return qi[order], ri[order], dist[order]


def least_positive(d2: np.ndarray) -> np.ndarray:
    return np.where(d2 > 0, d2, np.inf).min(1)


def summary(q: np.ndarray, leaves: Leaves, bounds: np.ndarray):
    """Per query: exact copies, and the smallest positive squared distance (infinite if none)."""
    zeros, nearest = np.zeros(len(q), np.int64), np.full(len(q), np.inf)
    for rows, x, bound, pieces, rest, piece in _tiles(q, leaves, bounds, least_positive, None):
        for low in (-1, *range(0, len(rest), 16)):
            _, d2 = pieces[0] if low < 0 else piece(rest[low:low + 16])
            copies = d2 == 0
            if copies.any():
                zeros[rows] += copies.sum(1)
                d2[copies] = np.inf
            nearest[rows] = np.minimum(nearest[rows], d2.min(1))
    return zeros, nearest
