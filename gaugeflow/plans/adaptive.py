"""Cubic smoothing splines whose knots come where the residuals are.

After P. Dierckx, "Curve and Surface Fitting with Splines" (1993): knots are inserted at values in the intervals with the
largest residuals until least squares keeps the budget; then the jumps of the third derivative at the knots are made as small
as the budget allows. All matrices are banded.
"""

from __future__ import annotations

import heapq

import numpy as np


def local(x: np.ndarray, t: np.ndarray, degree: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(first, values): the degree + 1 basis functions that aren't zero at each x, and the index of the first."""
    j = np.clip(np.searchsorted(t, x, "right") - 1, degree, len(t) - degree - 2)
    values = np.ones((len(x), 1))
    for d in range(1, degree + 1):
        left, right = t[j[:, None] + np.arange(1 - d, 1)], t[j[:, None] + np.arange(1, d + 1)]
        share = values / (right - left)
        values = np.pad(share * (right - x[:, None]), ((0, 0), (0, 1))) + np.pad(share * (x[:, None] - left), ((0, 0), (1, 0)))
    return j - degree, values


def _gram(first: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Bands (size x width) of the sum of products of rows that begin at `first`: band d holds the entries (k, k + d)."""
    width = rows.shape[1]
    out = np.zeros((size, width))
    for a in range(width):
        for b in range(a, width):
            out[:, b - a] += np.bincount(first + a, rows[:, a] * rows[:, b], size)
    return out


def solve_banded(bands: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a positive definite banded system by Cholesky's factors."""
    size, width = bands.shape
    low = np.zeros((size, width))
    z = np.zeros(size)
    for k in range(size):
        row = bands[k].copy()
        for e in range(1, min(width, k + 1)):
            above = low[k - e]
            row[: width - e] -= above[e] * above[e:]
        root = np.sqrt(max(row[0], 1e-300))
        low[k] = row / root
        z[k] = (right[k] - sum(low[k - e, e] * z[k - e] for e in range(1, min(width, k + 1)))) / root
    for k in range(size - 1, -1, -1):
        reach = min(width, size - k)
        z[k] = (z[k] - low[k, 1:reach] @ z[k + 1 : k + reach]) / low[k, 0]
    return z


def _jumps(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, rows): the jump of the third derivative at each inner knot as a row of five coefficients."""
    j = np.arange(3, len(t) - 4)
    third = np.tile(np.eye(4), (len(j), 1, 1))
    for d in (3, 2, 1):
        i = j[:, None] + np.arange(1 - d, 1)
        third = d * np.diff(third, axis=1) / (t[i + d] - t[i])[..., None]
    third = third[:, 0]
    rows = np.zeros((len(j) - 1, 5))
    rows[:, 1:] += third[1:]
    rows[:, :4] -= third[:-1]
    return j[:-1] - 3, rows


def _system(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple:
    first, values = local(x, t)
    size = len(t) - 4
    by = np.zeros(size)
    for a in range(4):
        by += np.bincount(first + a, values[:, a] * y, size)
    return first, values, np.pad(_gram(first, values, size), ((0, 0), (0, 1))), by


def _fitted(c: np.ndarray, first: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (c[first[:, None] + np.arange(values.shape[1])] * values).sum(1)


def _solved(bands: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Small systems are solved whole, which is quicker; large ones by their bands."""
    size, width = bands.shape
    if size > 64:
        return solve_banded(bands, by)
    full = np.diag(bands[:, 0])
    for d in range(1, min(width, size)):
        k = np.arange(size - d)
        full[k, k + d] = full[k + d, k] = bands[: size - d, d]
    return np.linalg.solve(full, by)


def _more_knots(knots: list[int], residual: np.ndarray, n: int, add: int) -> list[int]:
    """Knots at values, with `add` more: each at the middle value of the interval with the largest residuals."""
    ends = [0, *knots, n - 1]
    squares = residual**2
    held = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        # A value at a knot counts for both sides by half.
        held.append((-(squares[a : b + 1].sum() - (squares[a] / 2 if a else 0.0) - (squares[b] / 2 if b < n - 1 else 0.0)), a, b))
    heapq.heapify(held)
    new = list(knots)
    while add and held:
        cost, a, b = heapq.heappop(held)
        inner = b - a - 1
        if inner < 1:
            continue
        mid, add = a + 1 + inner // 2 if a + 1 + inner // 2 < b else a + 1, add - 1
        new.append(mid)
        for c, d in ((a, mid), (mid, b)):
            heapq.heappush(held, (cost * (d - c - 1) / inner, c, d))
    return sorted(new)


def smoothing_spline(y: np.ndarray, budget: float, near: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(knot vector, coefficients) of a cubic spline through values at 0 .. 1 whose squared residuals sum to `budget` at most.

    A cubic within the budget is taken as it stands. Otherwise the sum is the budget, but for a share of `near` where the knots
    alone come so close.
    """
    n = len(y)
    x = np.linspace(0, 1, n)
    knots: list[int] = []
    add, before = 1, None
    while True:
        t = np.concatenate([np.zeros(4), x[knots], np.ones(4)])
        first, values, gram, by = _system(x, y, t)
        c = _solved(gram, by)
        residual = y - _fitted(c, first, values)
        spent = float(residual @ residual)
        if spent <= budget * (1 + near) and (not knots or spent >= budget * (1 - near)):
            return t, c
        if spent < budget or len(knots) >= n - 4:
            break
        if before is not None:
            wanted = add * (spent - budget) / (before - spent) if before - spent > near * budget else 2 * add
            add = int(min(2 * add, max(wanted, add // 2, 1)))
        before = spent
        if len(knots) + add >= n - 4:
            knots = list(range(2, n - 2))  # as many functions as values
        else:
            knots = _more_knots(knots, residual, n, add)
    at, rows = _jumps(t)
    rough = _gram(at, rows, len(t) - 4)
    scale = gram[:, 0].sum() / rough[:, 0].sum()
    low, high, best = -16.0, 16.0, c
    for _ in range(60):
        mid = (low + high) / 2
        tried = _solved(gram + 10.0**mid * scale * rough, by)
        residual = y - _fitted(tried, first, values)
        spent = float(residual @ residual)
        if spent > budget:
            high = mid
        else:
            low, best = mid, tried
            if spent > budget * (1 - 1e-9):
                break
    return t, best


def evaluate(t: np.ndarray, c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spline and its first two derivatives at x."""
    out = [_fitted(c, *local(x, t))]
    for degree in (3, 2):
        width = t[degree + 1 : -1] - t[1 : -degree - 1]
        c, t = degree * np.diff(c) / width, t[1:-1]
        out.append(_fitted(c, *local(x, t, degree - 1)))
    return out[0], out[1], out[2]
