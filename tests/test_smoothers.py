"""Properties of the constant matrices, which the SQL of the trend queries takes as given."""

from __future__ import annotations

import numpy as np
import pytest

from gaugeflow.plans.smoothers import basis, knots, smoother, smoothest, smoothing_grid


@pytest.mark.parametrize("n", [4, 5, 8, 12, 25])
def test_least_squares_matrix(n):
    h, h1, h2, edf = smoother(n)
    assert np.allclose(h.sum(1), 1) and np.allclose(h1.sum(1), 0, atol=1e-8) and np.allclose(h2.sum(1), 0, atol=1e-6)
    assert np.allclose(h @ h, h) and np.isclose(np.trace(h), edf)
    b = basis(np.linspace(0, 1, n), knots(n), 3)
    y = np.sin(np.arange(n))
    assert np.allclose(b.T @ (y - h @ y), 0, atol=1e-9)


@pytest.mark.parametrize("n", [6, 10])
def test_cubics_and_their_derivatives_are_exact(n):
    x = np.linspace(0, 1, n)
    h, h1, h2, _ = smoother(n)
    y = 1 + 2 * x - x**2 + 3 * x**3
    assert np.allclose(h @ y, y) and np.allclose(h1 @ y, 2 - 2 * x + 9 * x**2) and np.allclose(h2 @ y, -2 + 18 * x)


def test_penalty_goes_to_least_squares():
    assert np.allclose(smoother(9, 1e-10)[0], smoother(9)[0], atol=1e-6)
    assert round(smoother(25, 10.0)[3], 4) == 2.4358


def _smoothed(y, budget, most=16):
    n = len(y)
    x, t = np.linspace(0, 1, n), knots(n, 3, most)
    b = basis(x, t, 3)
    c, edf = smoothest(*smoothing_grid(n, most), b.T @ y, float(y @ y), budget)
    return b @ c, edf, t, c


def test_smoothing_spline_takes_a_line_within_its_budget():
    line = 2 * np.linspace(0, 1, 12) + 1
    g, edf, *_ = _smoothed(line, 0.1)
    assert np.allclose(g, line) and edf == 2


@pytest.mark.parametrize("n", [5, 12, 16, 200])
def test_smoothing_spline_is_the_smoothest_within_its_budget(n):
    y = np.sin(6 * np.linspace(0, 1, n)) + np.cos(np.arange(n)) / 10
    budget = 0.02 * n
    g, edf, t, c = _smoothed(y, budget)
    assert np.isclose(((y - g) ** 2).sum(), budget, rtol=1e-6) and 2 < edf < min(n, 16)
    # the optimality condition: the gradients of roughness and residuals are opposite
    gram, rough = smoothing_grid(n, 16)
    b = basis(np.linspace(0, 1, n), t, 3)
    up, down = rough @ c, b.T @ (y - g)
    assert np.allclose(up / np.linalg.norm(up), down / np.linalg.norm(down), atol=1e-5)


def test_roughness_is_the_integral_of_the_squared_second_derivative():
    n = 9
    t = knots(n, 3, 16)
    c = np.linalg.lstsq(basis(np.linspace(0, 1, n), t, 3), np.linspace(0, 1, n) ** 3, rcond=None)[0]
    assert np.isclose(c @ smoothing_grid(n, 16)[1] @ c, 12)  # of x^3: the integral of 36 x^2
