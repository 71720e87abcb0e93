"""Series longer than the given tables hold: every window takes part in the fits."""

from __future__ import annotations

import numpy as np
import pytest

from gaugeflow.operators import trends as tr
from gaugeflow.plans.smoothers import basis, knots, smoother
from gaugeflow.streaming.online import Prefixes


@pytest.mark.parametrize("penalty", [0.0, tr.PENALTY])
def test_long_series_are_fitted_like_short_ones(spark, penalty):
    ys = {n: np.sin(np.arange(n) / 7) for n in (4, 5, 6, 64, 65, 300)}
    table = spark.createDataFrame([(n, k, float(v)) for n, y in ys.items() for k, v in enumerate(y)], "acquisition_id int, window_order int, y double")
    got = {}
    for r in tr.linear_fit(table, penalty).collect():
        got.setdefault(r["acquisition_id"], {})[r["i"]] = (r["fitted"], r["d1"], r["d2"], r["edf"])
    assert {n: len(f) for n, f in got.items()} == {n: n for n in ys}
    for n, y in ys.items():
        h, h1, h2, edf = smoother(n, penalty)
        assert np.allclose([got[n][i] for i in range(n)], np.stack([h @ y, h1 @ y, h2 @ y, np.full(n, edf)], 1), atol=1e-8)


def test_prefixes_of_a_long_series_are_whole(spark):
    table = spark.createDataFrame([(1, k, float(k)) for k in range(70)], "acquisition_id int, window_order int, y double")
    n = {r["boundary"]: r["count"] for r in tr.expanding(table).groupBy("boundary").count().collect()}
    assert n == {k: k + 1 for k in range(70)}


def test_long_series_are_smoothed(spark):
    """A series of any length has the fit of the same knots; one that the knots can't follow has least squares."""
    n = 3000
    x = np.linspace(0, 1, n)
    ys = {1: np.sin(6 * x), 2: np.cos(np.arange(n) * 2.0), 3: 3 * x}
    table = spark.createDataFrame([(k, i, float(v)) for k, y in ys.items() for i, v in enumerate(y)], "acquisition_id int, window_order int, y double")
    got = {}
    for r in tr.smoothing_fit(table, 0.01, adaptive=0).collect():
        got.setdefault(r["acquisition_id"], {})[r["i"]] = (r["fitted"], r["d1"], r["d2"], r["edf"])
    fit = {k: np.array([f[i] for i in range(n)]) for k, f in got.items()}
    assert np.isclose(np.mean((fit[1][:, 0] - ys[1]) ** 2), 0.01, rtol=1e-6)
    b = basis(x, knots(n, 3, 16), 3)
    assert np.allclose(fit[2][:, 0], b @ np.linalg.lstsq(b, ys[2], rcond=None)[0], atol=1e-8) and np.isclose(fit[2][0, 3], 16)
    assert np.allclose(fit[3][:, 0], ys[3], atol=1e-9) and np.allclose(fit[3][:, 1], 3, atol=1e-6) and np.allclose(fit[3][:, 3], 2)
    assert np.allclose(np.gradient(fit[1][:, 0], x)[1:-1], fit[1][1:-1, 1], atol=1e-3)


def test_last_fit_is_the_fit_of_the_whole_prefix():
    for n, penalty in ((4, 0.0), (5, 10.0), (70, 0.0), (70, 10.0)):
        y = np.sin(np.arange(n) / 5)
        h, h1, _, _ = smoother(n, penalty)
        held = Prefixes(0, 0, 0.0, np.zeros((0, 5)))
        for v in y:
            held.add(float(v))
        assert np.allclose(held.fit(penalty), (h[-1] @ y, h1[-1] @ y, np.sqrt(np.mean((y - h @ y) ** 2))))
