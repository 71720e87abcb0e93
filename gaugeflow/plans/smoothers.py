"""Linear smoothers as constant matrices.

A series of n values at 0 .. 1 is fitted by a clamped B-spline, with or without a penalty: fitted values and derivatives are
fixed matrices times the values. A matrix depends on n alone, so the few that occur are made once and joined.
"""

from __future__ import annotations

import numpy as np


def knots(n: int, degree: int = 3, most: int = 6) -> np.ndarray:
    """Clamped knot vector with uniform interior knots for max(degree + 1, min(most, n)) basis functions."""
    k = max(degree + 1, min(most, n))
    inner = np.linspace(0, 1, k - degree + 1)
    return np.concatenate([np.zeros(degree), inner, np.ones(degree)])


def basis(x: np.ndarray, t: np.ndarray, degree: int) -> np.ndarray:
    """B-spline basis by the Cox-de Boor recursion; the last interval is closed."""
    n = len(t) - degree - 1
    if degree == 0:
        out = ((x[:, None] >= t[:-1]) & (x[:, None] < t[1:])).astype(float)
        last = np.max(np.flatnonzero(t[:-1] < t[1:]))
        out[x == t[-1], last] = 1.0
        return out[:, :n]
    low = basis(x, t, degree - 1)
    out = np.zeros((len(x), n))
    for i in range(n):
        a, b = t[i + degree] - t[i], t[i + degree + 1] - t[i + 1]
        if a > 0:
            out[:, i] += (x - t[i]) / a * low[:, i]
        if b > 0:
            out[:, i] += (t[i + degree + 1] - x) / b * low[:, i + 1]
    return out


def derivative_map(t: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, knots): coefficients of the derivative, of one degree less, from those of the spline."""
    n = len(t) - degree - 1
    d = np.zeros((n - 1, n))
    for i in range(n - 1):
        w = t[i + degree + 1] - t[i + 1]
        if w > 0:
            d[i, i], d[i, i + 1] = -degree / w, degree / w
    return d, t[1:-1]


def smoother(n: int, penalty: float = 0.0, degree: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(H, H', H'', effective degrees of freedom) for n values; the penalty is on second differences of the coefficients."""
    x, t = np.linspace(0, 1, n), knots(n, degree)
    b = basis(x, t, degree)
    p = np.diff(np.eye(b.shape[1]), 2, axis=0)
    solve = np.linalg.solve(b.T @ b + penalty * p.T @ p, b.T) if penalty else np.linalg.pinv(b)
    d1, t1 = derivative_map(t, degree)
    d2, t2 = derivative_map(t1, degree - 1)
    h = b @ solve
    edf = float(np.trace(h)) if penalty else float(np.linalg.matrix_rank(b))
    return h, basis(x, t1, degree - 1) @ d1 @ solve, basis(x, t2, degree - 2) @ d2 @ d1 @ solve, edf


def smoother_rows(sizes, penalty: float = 0.0) -> list[tuple]:
    """(n, i, j, h, h1, h2, edf) of the matrices for the given lengths."""
    out = []
    for n in sizes:
        h, h1, h2, edf = smoother(n, penalty)
        out += [(int(n), i, j, float(h[i, j]), float(h1[i, j]), float(h2[i, j]), edf) for i in range(n) for j in range(n)]
    return out


def pieces(most: int = 6) -> list[list[list[float]]]:
    """The cubic basis functions as powers of the place 0 .. 1 within a knot interval, for 4, 5 .. `most` functions in turn.

    An entry an interval: `most` functions by four coefficients, zero for functions that aren't there.
    """
    u = np.linspace(0.1, 0.9, 4)
    out = []
    for k in range(4, most + 1):
        for p in range(k - 3):
            c = np.linalg.solve(np.vander(u, 4, increasing=True), basis((p + u) / (k - 3), knots(k), 3)).T
            out.append(np.vstack([c, np.zeros((most - k, 4))]).tolist())
    return out


def solver(n: int, penalty: float = 0.0, most: int = 6) -> tuple[np.ndarray, float]:
    """(M, effective degrees of freedom): coefficients are M times the sums B'y, whatever the length; zero beyond the basis."""
    b = basis(np.linspace(0, 1, n), knots(n), 3)
    k, gram = b.shape[1], b.T @ b
    p = np.diff(np.eye(k), 2, axis=0)
    least = np.linalg.pinv(b)
    m = np.linalg.inv(gram + penalty * p.T @ p) if penalty else least @ least.T
    edf = float(np.trace(m @ gram)) if penalty else float(np.linalg.matrix_rank(b))
    return np.pad(m, (0, most - k)), edf


def smoothing_grid(n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(B'B, R) of min(most, n) basis functions for n values at 0 .. 1, R being the integrals of products of their second
    derivatives; summed a block of values at a time, so that memory is that of the basis alone."""
    t = knots(n, 3, most)
    k = len(t) - 4
    gram = np.zeros((k, k))
    for start in range(0, n, 65536):
        b = basis(np.arange(start, min(n, start + 65536)) / (n - 1), t, 3)
        gram += b.T @ b
    d1, t1 = derivative_map(t, 3)
    d2, t2 = derivative_map(t1, 2)
    cuts = np.unique(t)
    rough = np.zeros((k, k))
    for at, weight in ((0.0, 1 / 6), (0.5, 4 / 6), (1.0, 1 / 6)):  # second derivatives are linear between knots: exact
        x = cuts[:-1] + np.diff(cuts) * np.clip(at, 1e-12, 1 - 1e-12)
        v = basis(x, t2, 1) @ d2 @ d1
        rough += (v * (weight * np.diff(cuts))[:, None]).T @ v
    return gram, rough


def smoothest(gram: np.ndarray, rough: np.ndarray, by: np.ndarray, yy: float, budget: float) -> tuple[np.ndarray, float]:
    """(coefficients, effective degrees of freedom) of the smoothest fit whose squared residuals are `budget` at most.

    A straight line within the budget is taken; where the budget is out of reach, the least squares fit. In the common
    eigenvectors of the two matrices each penalty is a vector of factors, so that the bisection costs no solving.
    """
    low = np.linalg.cholesky(gram)
    inner = np.linalg.solve(low, np.linalg.solve(low, rough).T)
    s, u = np.linalg.eigh((inner + inner.T) / 2)
    s = np.where(np.arange(len(s)) < 2, 0.0, np.maximum(s, 0.0))  # straight lines have no roughness
    z = u.T @ np.linalg.solve(low, by)
    rest = max(0.0, yy - float(z @ z))
    spent = lambda keep: rest + float((z * (1 - keep)) @ (z * (1 - keep)))
    keep = (s == 0).astype(float)
    if spent(keep) > budget:
        few, many = -40.0, 40.0
        keep = 1 / (1 + 10.0**few * s)
        for _ in range(200):
            mid = (few + many) / 2
            tried = 1 / (1 + 10.0**mid * s)
            if spent(tried) > budget:
                many = mid
            else:
                few, keep = mid, tried
    return np.linalg.solve(low.T, u @ (keep * z)), float(keep.sum())
