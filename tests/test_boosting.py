"""Boosted trees against a plain version that splits one leaf after another, and the odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from gaugeflow.operators import boosting as bo


def plain(x, y, bounds, classes, iterations, leaves, least, rate):
    """Raw scores of the rows: every split is searched over all rows of its leaf, the best leaf first."""
    bins = np.stack([np.searchsorted(b, x[:, k], "left") for k, b in enumerate(bounds)], axis=1)
    raw = np.tile(np.log(np.maximum(np.bincount(y, minlength=classes) / len(y), 1e-15)), (len(y), 1))
    for _ in range(iterations):
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        for k in range(classes):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])

            def search(rows, g=g, h=h):
                best = (0.0, None, None)
                for f in range(x.shape[1]):
                    for cut in np.unique(bins[rows, f])[:-1]:
                        a, b = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                        if min(len(a), len(b)) < least or min(h[a].sum(), h[b].sum()) < 1e-3:
                            continue
                        gain = round(g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[rows].sum() ** 2 / h[rows].sum(), 9)
                        if gain > best[0]:
                            best = (gain, a, b)
                return best

            ends = [(search(r), r) for r in [np.arange(len(y))]]
            while len(ends) < leaves and max(b[0] for b, _ in ends) > 0:
                (_, a, b), _ = ends.pop(int(np.argmax([s[0] for s, _ in ends])))
                ends += [(search(a), a), (search(b), b)]
            for _, r in ends:
                raw[r, k] += -rate * g[r].sum() / (h[r].sum() + 1e-15)
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, 3)), 3)
    y = (x[:, 0] > 0).astype(int) + 2 * ((x[:, 1] * x[:, 0] + 0.3 * x[:, 2]) > 0.1)
    return x, np.where(rng.random(700) < 0.1, rng.integers(0, 4, 700), y)


def _table(spark, x, y):
    rows = [(i, int(c), *map(float, v)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, label int, a double, b double, c double").repartition(5)


def test_boosting_against_one_split_after_another(spark, data):
    x, y = data
    df = _table(spark, x, y)
    model = bo.fit_boosted(df, "abc", "label", 4, iterations=3, leaves=9, least=10, bins=32)
    got = {r["id"]: r["p"] for r in bo.boosted_probabilities(df, model, ["id"]).collect()}
    expected = plain(x, y, model.bounds, 4, 3, 9, 10, 0.1)
    assert np.allclose([got[i] for i in range(len(y))], expected, atol=1e-9)
    assert all(sum(f < 0 for f in t.feature) <= 9 for trees in model.rounds for t in trees)
    assert max(sum(f < 0 for f in t.feature) for trees in model.rounds for t in trees) == 9


def test_boosting_learns_what_is_held_out(spark, data):
    x, y = data
    df = _table(spark, x, y)
    model = bo.fit_boosted(df.where("id % 3 > 0"), "abc", "label", 4, iterations=3, leaves=8, rate=0.8)
    p = {r["id"]: int(np.argmax(r["p"])) for r in bo.boosted_probabilities(df.where("id % 3 = 0"), model, ["id"]).collect()}
    assert np.mean([p[i] == y[i] for i in p]) > 0.75


def test_boosting_of_odd_rows(spark):
    schema = "id long, label int, a double, b double, y string, x string, c0 double"
    nan = float("nan")
    rows = [(i, i % 2, None if i % 2 else 1.0, nan, "clash", "clash", 0.0) for i in range(80)] + [(100, None, 5.0, 1.0, None, None, None), (None, 9, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    model = bo.fit_boosted(df, ["a", "b"], "label", 3, iterations=2)
    got = {r["id"]: r["p"] for r in bo.boosted_probabilities(df, model, ["id"]).collect()}
    assert len(got) == 82 and got[0][0] > got[0][1] and got[1][1] > got[1][0] and max(p[2] for p in got.values()) < 1e-9
    none = bo.fit_boosted(df.where("false"), ["a", "b"], "label", 3)
    assert bo.boosted_probabilities(df, none, ["id"]).first()["p"] == pytest.approx([1 / 3] * 3)
    assert bo.boosted_probabilities(df.where("false"), model, ["id"]).count() == 0
    same = bo.fit_boosted(df.withColumn("label", df.id * 0), ["a"], "label", 2, iterations=5)
    assert len(same.rounds) == 1
    with pytest.raises(ValueError):
        bo.fit_boosted(df, ["a"], "label", 2, bins=1)
