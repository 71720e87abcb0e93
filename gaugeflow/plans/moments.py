"""Spline fits of all prefixes of a series from prefix sums.

A cubic B-spline fit at 0 .. 1 has three knot intervals at most, so what it needs of n values are sums of i^r y, r = 0 .. 3, over
each third of them: differences of prefix sums at four places. A prefix is fitted without looking at its values again.
"""

from __future__ import annotations

from math import comb

import numpy as np

from .smoothers import pieces

BASES = 6
_PIECES = np.array(pieces(BASES))


def starts(n: np.ndarray) -> np.ndarray:
    """For lengths n (4 or more): how many values lie before each of the three knot intervals, and n; absent intervals are empty."""
    m = np.minimum(n, BASES) - 3
    at = [np.where(p < m, -(-p * (n - 1) // m), n) for p in range(3)]
    return np.stack([*at, n], -1)


def _power_sums(n: np.ndarray) -> list[np.ndarray]:
    """Sums of t^r for t = 0 .. n - 1 and r = 0 .. 6."""
    n = n.astype(float)
    out = [n]
    for r in range(1, 7):  # (n)^(r+1) = sum of the differences of t^(r+1)
        out.append((n ** (r + 1) - sum(comb(r + 1, s) * out[s] for s in range(r))) / (r + 1))
    return out


def last_fits(n: np.ndarray, prefix: np.ndarray, penalty: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, slope, root mean square error) at the last of n values of the fit of B-splines (penalty 0) or P-splines.

    `prefix` is rows x 4 x 5: the sums of i^0 y .. i^3 y and y^2 before each place of `starts`. Values should be taken from
    about their level, so that errors aren't lost in the squares.
    """
    at, m = starts(n), np.minimum(n, BASES) - 3
    alpha, size = m / (n - 1), m + 3
    by, gram = np.zeros((len(n), BASES)), np.zeros((len(n), BASES, BASES))
    for p in range(3):
        a, long, d = at[:, p].astype(float), at[:, p + 1] - at[:, p], prefix[:, p + 1] - prefix[:, p]
        own = [sum(comb(r, s) * (-a) ** (r - s) * d[:, s] for s in range(r + 1)) for r in range(4)]  # of the place within the interval
        first, sums = alpha * a - p, _power_sums(long)
        local = lambda q, of: sum(comb(q, r) * first ** (q - r) * alpha**r * of[r] for r in range(q + 1))  # noqa: E731, B023
        c = _PIECES[np.minimum(p + m * (m - 1) // 2, len(_PIECES) - 1)]
        by += np.einsum("rkq,qr->rk", c, np.stack([local(q, own) for q in range(4)]))
        powers = np.stack([local(q, sums) for q in range(7)])
        hankel = powers[np.add.outer(np.arange(4), np.arange(4))]
        gram += np.einsum("rkq,qsr,rls->rkl", c, hankel, c)
    system = gram.copy()
    for k in range(4, BASES + 1):
        rows = np.flatnonzero(size == k)
        second = np.diff(np.eye(k), 2, axis=0)
        system[rows[:, None, None], np.arange(k)[:, None], np.arange(k)] += penalty * second.T @ second
        system[rows[:, None], np.arange(k, BASES), np.arange(k, BASES)] = 1.0
    c = np.linalg.solve(system, by[..., None])[..., 0]
    row = np.arange(len(n))
    rest = prefix[:, 3, 4] - 2 * (c * by).sum(1) + np.einsum("rk,rkl,rl->r", c, gram, c)
    rest = np.where((penalty == 0) & (n <= BASES), 0.0, np.maximum(rest, 0.0))  # as many functions as values
    return c[row, size - 1], 3 * m * (c[row, size - 1] - c[row, size - 2]), np.sqrt(rest / n)
