"""Generalised Stirling numbers, and draws of the number of tables of a dish.

``S(c, t)`` weighs all seatings of ``c`` customers of one dish at ``t`` tables
in a Pitman-Yor restaurant of discount ``d``:

    S(c, t) = c! / (t! d^t) * [z^c] (1 - (1 - z)^d)^t

Up to ``EXACT`` customers their logarithms are a table made by the recurrence
S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t). Above, the coefficient is a
contour integral, taken on a grid of c and log t / log c and interpolated; the
grid grows with the largest count asked for, so no count is cut off.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EXACT = 64
POINTS = 24  # at which a dish's distribution is taken, if it has more tables likely
DROP = 18.0  # of log weight below the mode, beyond which tables are not likely
_NODES = 96  # of log t / log c
_PER_OCTAVE = 4  # rows of c
_STEPS = 64  # of a contour
_BATCH = 8192  # dishes that are drawn at a time
_TABLED = 1 << 16  # whole numbers whose log Gamma is looked up


def _log_sums(x: np.ndarray) -> np.ndarray:
    """Logarithms of the absolute values of the sums of exp(x) over the last axis (complex x)."""
    top = x.real.max(axis=-1, keepdims=True)
    return top[..., 0] + np.log(np.abs(np.exp(x - top).sum(axis=-1).real))


def log_coefficients(c: float, t: np.ndarray, d: float) -> np.ndarray:
    """log [z^c] (1 - (1 - z)^d)^t for real t from 1 to c."""
    t = np.asarray(t, float)
    lo, hi = np.full(t.shape, -80.0), np.full(t.shape, 80.0)  # of log(z / (1 - z)) at the saddle
    for _ in range(60):
        mid = (lo + hi) / 2
        v = 1 / (1 + np.exp(mid))
        z = 1 / (1 + np.exp(-mid))
        f = -np.expm1(d * np.log(v))
        f = np.where(z < 1e-9, d * z, f)
        low = t * d * v ** (d - 1) * z / f < c
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    v, z = 1 / (1 + np.exp(lo)), 1 / (1 + np.exp(-lo))
    out = np.empty(t.shape)
    many = t > c / 2  # a circle about 0; else a parabola about the branch at z = 1
    i = (np.arange(4 * _STEPS) + 0.5) / (4 * _STEPS)
    if many.any():
        tt, r = t[many, None], z[many, None]
        near = np.minimum(1.0, 12 / np.sqrt(np.maximum(1.0, (c - tt) * np.minimum(1.0, 1 - d))) / np.pi)
        phi = np.pi * near * i
        # f(z) / z, of which the t-th power is taken, loses no digits for small z
        w = r * np.exp(1j * phi)
        ratio = np.where(np.abs(w) < 1e-5, d + d * (1 - d) / 2 * w, (1 - np.exp(d * np.log1p(-w))) / np.where(w == 0, 1, w))
        x = tt * np.log(ratio) - (c - tt) * (np.log(np.maximum(r, 1e-300)) + 1j * phi)
        out[many] = _log_sums(x) + np.log(near[:, 0] / (4 * _STEPS))
        out[many & (t >= c)] = c * np.log(d)
    few = ~many
    if few.any():
        tt = t[few, None]
        v0 = np.maximum(v[few, None], 2 / c)
        curve = (c + 1) / (1 - v0) ** 2 + tt * d * ((1 - d) * v0 ** (d - 2) - v0 ** (2 * d - 2)) / (1 - v0**d) ** 2
        wide = np.minimum(1 / np.sqrt(2 * v0 * c), 1 / (2 * v0 * np.sqrt(np.maximum(curve, 1e-300))))
        y = wide * np.minimum(0.25, 0.15 / wide) * (np.arange(4 * _STEPS) + 0.5)
        at = v0 * (1 + 1j * y) ** 2
        x = tt * np.log1p(-np.exp(d * np.log(at))) - (c + 1) * np.log1p(-at) + np.log(1 + 1j * y)
        out[few] = _log_sums(x) + np.log(2 * v0[:, 0] * (y[:, 1] - y[:, 0]) / np.pi)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x), x > 0, by Stirling's series from x + 8."""
    x = np.asarray(x, float)
    small = x < 8
    y = np.where(small, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y
    if small.any():
        xs = x[small]
        out[small] -= np.log(np.prod([xs + k for k in range(8)], axis=0))
    return out


@lru_cache(maxsize=1)
def _log_gammas() -> np.ndarray:
    return np.concatenate(([np.inf], _log_gamma(np.arange(1, _TABLED))))


def _log_factorial(t: np.ndarray) -> np.ndarray:
    """log Gamma(t + 1) for whole t."""
    n = t.astype(np.int64) + 1
    return _log_gammas()[n] if n.max(initial=0) < _TABLED else _log_gamma(t + 1)


class Stirling:
    """log S(c, t), less a constant of c, for one discount."""

    def __init__(self, discount: float):
        self.discount = d = discount
        table = np.full((EXACT + 1, EXACT + 2), -np.inf)
        table[1, 1] = 0.0
        t = np.arange(1, EXACT + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in range(1, EXACT):
                stay = np.where(t <= c, np.log(np.maximum(c - d * t, 1e-300)) + table[c, 1:-1], -np.inf)
                table[c + 1, 1:-1] = np.logaddexp(table[c, :-2], stay)
        self.table = table
        # close together at both ends
        self.nodes = (1 - np.cos(np.pi * np.arange(_NODES) / (_NODES - 1))) / 2
        self.grid = np.empty((0, _NODES))

    def _reach(self, most: float) -> None:
        rows = []
        for k in range(len(self.grid), 2 + int(np.log2(most / EXACT) * _PER_OCTAVE)):
            c = EXACT * 2 ** (k / _PER_OCTAVE)
            t = c**self.nodes
            got = log_coefficients(c, t, self.discount) - np.log(t)
            rows.append(got - got[0])
        if rows:
            self.grid = np.concatenate((self.grid, rows))

    def log_weight(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Of t (1..c) tables for c customers; arrays that broadcast."""
        c, t = np.broadcast_arrays(c, t)
        out = np.empty(c.shape)
        few = c <= EXACT
        out[few] = self.table[c[few], t[few].astype(np.int64)]
        if not few.all():
            out[~few] = self._far(c[~few].astype(float), t[~few].astype(float))
        return out

    def _far(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        log_c, nodes = self._rows(c)
        return self._between(log_c, nodes, np.arange(len(c)), t)

    def _rows(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log c, and what the grid holds for c at each node, linear between its rows."""
        self._reach(float(c.max()))
        log_c = np.log(c)
        row = (log_c / np.log(2) - np.log2(EXACT)) * _PER_OCTAVE
        k = np.clip(row.astype(np.int64), 0, len(self.grid) - 2)
        b = (row - k)[:, None]
        return log_c, (1 - b) * self.grid[k] + b * self.grid[k + 1]

    def _between(self, log_c: np.ndarray, nodes: np.ndarray, of: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Cubic through four nodes; ``of``: the row of each t in the other two."""
        log_t = np.log(t)
        at = np.arccos(np.maximum(np.minimum(1 - 2 * log_t / log_c[of], 1), -1)) / np.pi * (_NODES - 1)
        j = np.minimum(np.maximum(at.astype(np.int64), 1), _NODES - 3)
        u = at - j
        weights = (-u * (u - 1) * (u - 2) / 6, (u + 1) * (u - 1) * (u - 2) / 2, -(u + 1) * u * (u - 2) / 2, (u + 1) * u * (u - 1) / 6)
        value, flat, first = 0.0, nodes.ravel(), of * _NODES + (j - 1)
        for i, w in enumerate(weights):
            value = value + w * flat[first + i]
        return value + log_t - _log_factorial(t) - t * np.log(self.discount)

    def draw(self, c: np.ndarray, log_x: np.ndarray, rng: np.random.Generator, others: np.ndarray | None = None) -> np.ndarray:
        """Numbers of tables of dishes with ``c`` customers each, drawn in
        proportion to S(c, t) x^t; with ``others``, in proportion to
        S(c, t) x^t Gamma(others + t)."""
        out = np.minimum(c, 1).astype(np.int64)
        some = np.flatnonzero(c > 1)
        if len(some):
            order = some[np.argsort(c[some], kind="stable")]
            sizes = c[order]
            for n in range(2, 9):  # all numbers of tables at once
                mine = order[np.searchsorted(sizes, n) : np.searchsorted(sizes, n, side="right")]
                if len(mine):
                    t = np.arange(1, n + 1)
                    w = self.table[n, 1 : n + 1] + np.multiply.outer(log_x[mine], t)
                    if others is not None:
                        w += _log_gamma(others[mine, None] + t)
                    w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
                    out[mine] = 1 + (w < (rng.random(len(mine)) * w[:, -1])[:, None]).sum(axis=1)
            rest = order[np.searchsorted(sizes, 9) :]
            far = np.searchsorted(c[rest], EXACT, side="right")
            for part in (rest[:far], rest[far:]):
                for i in range(0, len(part), _BATCH):
                    mine = part[i : i + _BATCH]
                    out[mine] = self._drawn(c[mine], log_x[mine], rng, None if others is None else others[mine])
        return out

    def _drawn(self, c, log_x, rng, others) -> np.ndarray:
        """As :meth:`draw`, for dishes of up to EXACT customers each, or of more."""
        c = c.astype(np.int64)
        rows = np.arange(len(c))
        if c.max() > EXACT:
            log_c, nodes = self._rows(c.astype(float))

        def weight(t, of=rows):
            w = self.table[c[of], t] if c[0] <= EXACT else self._between(log_c, nodes, of, t.astype(float))
            w = w + t * log_x[of]
            return w if others is None else w + _log_gamma(others[of] + t)

        # the weights rise to one mode and fall; a bisection of 1..c for it, then for either end of what is likely
        def bisect(lo, hi, above):
            lo, hi = lo.copy(), hi.copy()
            left = np.flatnonzero(lo < hi)  # dishes whose end is not found
            while len(left):
                a, z = lo[left], hi[left]
                mid = (a + z) // 2
                up = above(mid, left)
                lo[left], hi[left] = np.where(up, mid + 1, a), np.where(up, z, mid)
                left = left[lo[left] < hi[left]]
            return lo

        one = np.ones_like(c)
        mode = bisect(one, c, lambda t, of: weight(np.minimum(t + 1, c[of]), of) > weight(t, of))
        least = weight(mode) - DROP
        first = bisect(one, mode, lambda t, of: weight(t, of) < least[of])
        last = bisect(mode, c, lambda t, of: weight(t, of) > least[of])
        # at points of that range; each stands for the numbers up to half-way to its neighbours
        span = (last - first).astype(float)
        steps = np.arange(POINTS) / (POINTS - 1)
        t = np.rint(first[:, None] + span[:, None] * steps).astype(np.int64)
        new = np.concatenate((np.ones((len(c), 1), bool), t[:, 1:] > t[:, :-1]), axis=1)
        w = np.full(t.shape, -np.inf)
        w[new] = weight(t[new], np.nonzero(new)[0])
        w = np.exp(w - w.max(axis=1, keepdims=True))
        # piecewise linear between the points, which is exact where they are neighbours
        dense = span < POINTS
        mass = np.where(dense[:, None], w, 0.0)
        mass[~dense, 1:] = (w[~dense, 1:] + w[~dense, :-1]) / 2
        upto = np.cumsum(mass, axis=1)
        u = rng.random(len(c)) * upto[:, -1]
        at = np.minimum((upto <= u[:, None]).sum(axis=1), POINTS - 1)
        out = t[rows, at].astype(float)
        far = ~dense & (at > 0)
        if far.any():
            r, k = rows[far], at[far]
            a, b = w[r, k - 1], w[r, k]
            v = (u[r] - upto[r, k - 1]) / np.maximum(mass[r, k], 1e-300) * (a + b) / 2
            part = 2 * v / (a + np.sqrt(np.maximum(a * a + 2 * (b - a) * v, 0.0)) + 1e-300)
            out[far] = t[r, k - 1] + np.clip(part, 0, 1) * (t[r, k] - t[r, k - 1])
        return np.clip(np.rint(out), 1, c).astype(np.int64)


@lru_cache(maxsize=16)
def stirling(discount: float) -> Stirling:
    return Stirling(discount)
