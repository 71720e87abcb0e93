"""Every query with SQL gives DuckDB's rows; the others keep their invariants."""

from __future__ import annotations

import pytest

import gaugeflow.queries as library
from conftest import DATA
from oracle import both, connect

SMALL = DATA / "sf0.001"
CON = connect(SMALL)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    a, b = both(spark, CON, library.queries()[name], library.oracle_sql()[name], SMALL)
    assert a == b


@pytest.mark.parametrize("name", ["fit_logistic", "fit_forest"])
def test_models_score_held_out_windows(spark, name):
    rows = library.queries()[name](spark, str(SMALL)).collect()
    assert rows
    assert all(0.25 - 1e-9 <= r["confidence"] <= 1 and 0 <= r["entropy"] <= 1 for r in rows)


def test_smoothing_keeps_its_budget(spark):
    rows = library.queries()["trend_smoothing"](spark, str(SMALL)).collect()
    spent = {}
    for r in rows:
        s = spent.setdefault(r["acquisition_id"], [0.0, r["n"]])
        s[0] += (r["y"] - r["fitted"]) ** 2
    assert spent and all(s <= 0.25 * n + 1e-4 for s, n in spent.values())


def test_manifest_has_a_row_a_file(spark):
    rows = library.queries()["checksum_manifest"](spark, str(SMALL)).collect()
    assert len(rows) == len(list(SMALL.glob("*.parquet"))) and all(len(r["sha256"]) == 64 for r in rows)
