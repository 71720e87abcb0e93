"""Smoothing splines with knots of their own: the budget holds at any length, and the fit is the smoothest one on its knots."""

from __future__ import annotations

import numpy as np
import pytest

from gaugeflow.operators import trends as tr
from gaugeflow.plans import adaptive as ad
from gaugeflow.plans.smoothers import basis


def wave(n: int, seed: int = 0) -> np.ndarray:
    return np.sin(40 * np.linspace(0, 1, n) ** 2) + 0.1 * np.random.default_rng(seed).normal(size=n)


def dense(t: np.ndarray, n: int) -> np.ndarray:
    return basis(np.linspace(0, 1, n), t, 3)


@pytest.mark.parametrize(("n", "budget"), [(5, 1e-5), (12, 1e-3), (70, 0.01), (70, 1e-6), (500, 0.012), (3000, 0.012), (3000, 0.002)])
def test_the_budget_is_kept(n, budget):
    y = wave(n)
    t, c = ad.smoothing_spline(y, budget * n)
    spent = float(((y - dense(t, n) @ c) ** 2).sum())
    assert budget * n * 0.998 <= spent <= budget * n * 1.002 and len(c) <= n
    if n == 3000 and budget < 0.01:
        assert len(c) > 64  # beyond any fixed number of functions, solved by bands


def test_the_fit_is_the_smoothest_on_its_knots():
    n = 120
    y = wave(n)
    t, c = ad.smoothing_spline(y, 0.02 * n)
    b = dense(t, n)
    first, rows = ad._jumps(t)
    d = np.zeros((len(rows), len(c)))
    d[np.arange(len(rows))[:, None], first[:, None] + np.arange(5)] = rows
    up, down = d.T @ d @ c, b.T @ (y - b @ c)
    assert len(rows) > 3 and np.allclose(up / np.linalg.norm(up), down / np.linalg.norm(down), atol=1e-6)


def test_a_cubic_within_the_budget_has_no_knots():
    x = np.linspace(0, 1, 40)
    t, c = ad.smoothing_spline(1 + x - 3 * x**3, 1e-9)
    g, d1, d2 = ad.evaluate(t, c, x)
    assert len(c) == 4 and np.allclose(g, 1 + x - 3 * x**3) and np.allclose(d1, 1 - 9 * x**2) and np.allclose(d2, -18 * x)


def test_bands_solve_as_the_whole():
    n = 200
    y = wave(n)
    t, _ = ad.smoothing_spline(y, 1e-3 * n)
    first, values, gram, by = ad._system(np.linspace(0, 1, n), y, t)
    b = dense(t, n)
    assert np.allclose(ad.solve_banded(gram, by), np.linalg.solve(b.T @ b, b.T @ y), atol=1e-8) and np.allclose(ad._fitted(by, first, values), b @ by)


def test_series_of_all_lengths_in_one_table(spark):
    lengths = {"a": 4, "b": 70, "c": 500, "d": 3000, "short": 3}
    df = spark.createDataFrame([(k, i, float(v)) for k, n in lengths.items() for i, v in enumerate(wave(n, n))], "acquisition_id string, window_order long, y double").repartition(6)
    for most in (1 << 18, 100):  # some series on uniform knots
        spent: dict = {}
        for r in tr.smoothing_fit(df, 0.05, adaptive=most).collect():
            spent.setdefault(r["acquisition_id"], []).append((r["y"] - r["fitted"]) ** 2)
        assert {k: len(v) for k, v in spent.items()} == {k: n for k, n in lengths.items() if n > 3}
        assert all(sum(v) <= 0.0501 * len(v) for k, v in spent.items() if lengths[k] <= most)
