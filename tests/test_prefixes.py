"""Fits of prefixes from prefix sums: the same as fits of the values, in batch and in a stream that is stopped and resumed."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import trends as tr
from gaugeflow.plans import moments
from gaugeflow.plans.smoothers import basis, derivative_map, knots, solver
from gaugeflow.streaming import online as on


def plain_fit(y: np.ndarray, penalty: float) -> tuple[float, float, float]:
    n, t = len(y), knots(len(y))
    b = basis(np.arange(n) / (n - 1), t, 3)
    c = solver(n, penalty)[0][: b.shape[1], : b.shape[1]] @ (b.T @ y)
    d, t1 = derivative_map(t, 3)
    return float(b[-1] @ c), float((basis(np.ones(1), t1, 2) @ d @ c)[0]), float(np.sqrt(np.mean((y - b @ c) ** 2)))


@pytest.mark.parametrize("penalty", [0.0, 10.0])
def test_prefix_sums_give_the_fit_of_the_values(penalty):
    rng = np.random.default_rng(0)
    y = rng.normal(size=400).cumsum() + 1000
    held = on.Prefixes(0, 0, 0.0, np.zeros((0, 5)))
    for k, v in enumerate(y, 1):
        held.add(float(v))
        if k >= 4:
            assert held.fit(penalty) == pytest.approx(plain_fit(y[:k], penalty), abs=1e-8)
        if k % 7 == 0:  # through the state and back
            first, sums = held.kept()
            assert len(sums) <= 2 * k / 3 + 8
            held = on.Prefixes(held.n, first, held.level, sums)


def test_prefixes_of_a_long_series(spark):
    rng = np.random.default_rng(1)
    y = {"a": rng.normal(size=3000).cumsum(), "b": rng.normal(size=5), "c": rng.normal(size=3)}
    rows = [(k, 10 * i, float(v)) for k, s in y.items() for i, v in enumerate(s)] + [("d", i, float("nan") if i == 6 else float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "acquisition_id string, window_order long, y double").repartition(5)
    got = {(r["acquisition_id"], r["n"]): (r["trend_value"], r["first_derivative"], r["fit_rmse"]) for r in tr.prefix_fits(df).collect()}
    assert len(got) == 2997 + 2 + 3 and max(n for k, n in got if k == "d") == 6
    for n in [4, 5, 6, 7, 10, 333, 1024, 3000]:
        assert got["a", n] == pytest.approx(plain_fit(y["a"][:n], 0.0), abs=1e-7)
    assert got["d", 6] == pytest.approx((5.0, 5.0, 0.0), abs=1e-9)


def test_a_stream_goes_on_from_its_state(spark, tmp_path, request):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled"))
    y = np.random.default_rng(2).normal(size=40).cumsum()
    rows = spark.createDataFrame([("s", i, float(v), 100, i) for i, v in enumerate(y)], "acquisition_id string, window_order long, y double, boundary long, arrival long")
    for where in ("arrival < 2", "arrival >= 2 AND arrival < 25", "arrival >= 25"):
        rows.where(where).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = on.online_trend(on.read_stream(spark, rows, f"{tmp_path}/in"), idle_ms=3_600_000)
        s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r["window_order"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 40 and [got[k]["status"] for k in range(4)] == ["INSUFFICIENT_HISTORY"] * 3 + ["FIT_OK"]
    for k in range(3, 40):
        assert (got[k]["trend_value"], got[k]["first_derivative"], got[k]["fit_rmse"]) == pytest.approx(plain_fit(y[: k + 1], 0.0), abs=1e-9)


def test_places_of_the_knots():
    n = np.arange(4, 200)
    at = moments.starts(n)
    assert (np.diff(at, axis=1) >= 0).all() and (at[:, 0] == 0).all() and (at[:, 3] == n).all()
    assert (np.diff(at[3:, 1]) >= 0).all()  # what is dropped isn't asked for later
