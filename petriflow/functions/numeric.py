"""Small numerical routines for grouped functions: distributions, splines, hulls, assignment."""

from __future__ import annotations

import itertools
import math

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        step = 1.0
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            step *= d * c
        total *= step
        if abs(step - 1) < 1e-15:
            break
    return front * total


def student_two_sided(t: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|)."""
    return np.array([np.nan if not (math.isfinite(x) and f > 0) else incomplete_beta(f / 2, 0.5, f / (f + x * x)) if x else 1.0 for x, f in zip(t, freedom, strict=True)])


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline through (x, y); a line or parabola for two or three points."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at) if n > 1 else np.full(len(at), y[0] if n else np.nan)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a, rhs = np.zeros((n, n)), np.zeros(n)
    i = np.arange(1, n - 1)
    a[i, i - 1], a[i, i], a[i, i + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    rhs[1:-1] = 6 * np.diff(slope)
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, rhs)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u, v = x[k + 1] - at, at - x[k]
    return (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v


def hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def polygon(vertices: np.ndarray) -> tuple[float, float]:
    """Area and perimeter."""
    nxt = np.roll(vertices, -1, axis=0)
    area = 0.5 * abs(float((vertices[:, 0] * nxt[:, 1] - vertices[:, 1] * nxt[:, 0]).sum()))
    return area, float(np.sqrt(((nxt - vertices) ** 2).sum(axis=1)).sum()) if len(vertices) > 1 else 0.0


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least total cost: all permutations up to seven rows, else shortest augmenting paths."""
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    if n <= 7 and m <= 7:
        best = min(itertools.permutations(range(m), n), key=lambda p: sum(cost[i, j] for i, j in enumerate(p)))
        return list(enumerate(best))
    owner, price, gain = [-1] * m, np.zeros(m), np.zeros(n)
    for row in range(n):
        least, prev, used, at, i = np.full(m, np.inf), [-1] * m, np.zeros(m, bool), -1, row
        while True:
            reach = cost[i] - gain[i] - price
            better = ~used & (reach < least)
            least[better] = reach[better]
            for j in np.flatnonzero(better):
                prev[j] = at
            j = int(np.argmin(np.where(used, np.inf, least)))
            d = least[j]
            gain[row] += d
            for k in np.flatnonzero(used):
                gain[owner[k]] += d
                price[k] -= d
            least[~used] -= d
            used[j], at = True, j
            if owner[j] < 0:
                break
            i = owner[j]
        while at >= 0:
            before = prev[at]
            owner[at] = owner[before] if before >= 0 else row
            at = before
    return sorted((i, j) for j, i in enumerate(owner) if i >= 0)


class Links:
    """A symmetric matrix of n x n numbers by its entries (r, c, v), both ways; entries of one place are added up."""

    #: Entries times columns that a product holds at once.
    HELD = 1 << 20

    def __init__(self, n: int, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> None:
        # an entry of 0 on the diagonal: each row has one
        at, place = np.unique(np.concatenate([r * n + c, np.arange(n) * (n + 1)]), return_inverse=True)
        self.n, self.r, self.c = n, at // n, at % n
        self.v = np.bincount(place[: len(v)], v, len(at))
        self.start = np.searchsorted(self.r, np.arange(n + 1))

    def normalised(self) -> Links:
        """Each entry over the root of both rows' sums."""
        root = 1 / np.sqrt(np.maximum(np.bincount(self.r, self.v, self.n), 1e-12))
        return Links(self.n, self.r, self.c, root[self.r] * self.v * root[self.c])

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        out[self.r, self.c] = self.v
        return out

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out, most, at = np.empty(x.shape), max(1, self.HELD // x.shape[1]), 0
        while at < self.n:
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + most, "right")) - 1)
            s, e = self.start[at], self.start[to]
            out[at:to] = np.add.reduceat(self.v[s:e, None] * x[self.c[s:e]], self.start[at:to] - s, axis=0)
            at = to
        return out


def largest(m: Links, count: int, tolerance: float, spare: int = 10, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, bool]:
    """The `count` largest eigenvalues, descending, of a symmetric matrix with spectrum in [-1, 1], their vectors as columns, and whether all
    residuals are at most the tolerance.

    A block of vectors goes through Chebyshev polynomials of the matrix that stay small from -1 to the block's least value and grow
    above; their degree is such that the vectors do not all become the first one. Holds some blocks of n x 1.5 count doubles."""
    block = min(m.n, count + max(spare, count // 2))
    x, low, best = np.random.default_rng(0).standard_normal((m.n, block)), 0.5, math.inf
    for _ in range(rounds):
        middle, half = (low - 1) / 2, (low + 1) / 2
        degree = int(min(400, max(4, math.log(1e8) / math.acosh((1 - middle) / half))))
        before, x = x, (m @ x - middle * x) / half
        for _ in range(degree - 1):
            before, x = x, 2 / half * (m @ x - middle * x) - before
        q = np.linalg.qr(x)[0]
        mq = m @ q
        t = q.T @ mq
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        x, mx = q @ y, mq @ y
        best = np.linalg.norm(mx[:, :count] - x[:, :count] * values[:count], axis=0).max()
        if best <= tolerance:
            break
        low = float(np.clip(values[-1], -0.5, 0.9999))
    return values[:count], x[:, :count], bool(best <= tolerance)
