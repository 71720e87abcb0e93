"""Trends over ordered windows.

Input rows are (acquisition_id, window_order, y). A spline has six basis functions at most, so a
fit is six sums a series, a small matrix for its length, and the basis row by row; a failed fit keeps its row, with a status and nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import finite, first_reason
from ..plans.adaptive import evaluate, smoothing_spline
from ..plans.moments import last_fits
from ..plans.smoothers import basis, derivative_map, knots, pieces, smoothest, smoothing_grid, solver
from ..plans.storage import stored

LEAST = 4
PENALTY = 10.0


# The codes of window order checks, in the order in which they are looked at, with the status of each.
ORDER_CODES = {
    "MIXED_ASSIGNMENTS": "INVALID_CONFIGURATION",
    "UNKNOWN_WINDOW_PARTITION": "INVALID_CONFIGURATION",
    "MIXED_WINDOW_PARTITIONS": "INVALID_CONFIGURATION",
    "DUPLICATE_WINDOW_ID": "UNORDERED_WINDOWS",
    "DUPLICATE_WINDOW_ORDER": "UNORDERED_WINDOWS",
    "UNORDERED_WINDOWS": "UNORDERED_WINDOWS",
    "INCONSISTENT_FEATURE_VECTOR_SHAPE": "INVALID_CONFIGURATION",
    "NONFINITE_INPUT": "NONFINITE_INPUT",
    "CONSISTENT_TIMESTAMP_OR_ORDINAL_POSITION_REQUIRED": "INVALID_CONFIGURATION",
    "UNORDERED_ORDINAL_POSITIONS": "UNORDERED_WINDOWS",
    "INVALID_OR_UNORDERED_TIMESTAMPS": "UNORDERED_WINDOWS",
    "FUTURE_WINDOW_FORBIDDEN": "UNORDERED_WINDOWS",
    "INSUFFICIENT_HISTORY": "INSUFFICIENT_HISTORY",
}
#: Partitions that windows may come from.
PARTITIONS = ("train", "validation", "test", "production")


def validate_order(windows: DataFrame, key: str = "acquisition_id", arrival: str = "arrival", boundary: str | None = None) -> DataFrame:
    """(key, status, reason): the first fault of an acquisition's windows in the order they arrived, ORDER_OK and null without.

    Looked at where the table has them: assignment_id, partition, window_id, features (an array), ordinal_position and
    timestamp. Positions count where all windows have one, else timestamps where all have one; a table with neither column
    is ordered by window_order alone.
    """
    have = set(windows.columns)
    w = W.partitionBy(key).orderBy(arrival)
    steps = {"_back": F.col("window_order") <= F.lag("window_order").over(w)}
    faults: dict[str, Column] = {"UNORDERED_WINDOWS": F.bool_or("_back"), "DUPLICATE_WINDOW_ORDER": F.count("*") != F.count_distinct("window_order")}
    mixed = lambda c: ~F.min(c).eqNullSafe(F.max(c)) | (F.count(c) != F.count("*")) & (F.count(c) > 0)
    if "assignment_id" in have:
        faults["MIXED_ASSIGNMENTS"] = mixed("assignment_id")
    if "partition" in have:
        faults["UNKNOWN_WINDOW_PARTITION"] = F.bool_or(~F.coalesce(F.col("partition").isin(*PARTITIONS), F.lit(False)))
        faults["MIXED_WINDOW_PARTITIONS"] = mixed("partition")
    if "window_id" in have:
        faults["DUPLICATE_WINDOW_ID"] = F.count("*") != F.count_distinct("window_id")
    if "features" in have:
        width = F.coalesce(F.size("features"), F.lit(0))
        faults["INCONSISTENT_FEATURE_VECTOR_SHAPE"] = (F.max(width) <= 0) | (F.min(width) != F.max(width))
        faults["NONFINITE_INPUT"] = F.bool_or(F.exists("features", lambda v: ~finite(v)))
    else:
        faults["NONFINITE_INPUT"] = F.bool_or(~finite("y"))
    if have & {"ordinal_position", "timestamp"}:
        whole = {c: F.count(c) == F.count("*") if c in have else F.lit(False) for c in ("ordinal_position", "timestamp")}
        faults["CONSISTENT_TIMESTAMP_OR_ORDINAL_POSITION_REQUIRED"] = ~whole["ordinal_position"] & ~whole["timestamp"]
        if "ordinal_position" in have:
            place = F.col("ordinal_position").cast("double")
            steps["_place"] = ~finite(place) | (place <= F.lag(place).over(w))
            faults["UNORDERED_ORDINAL_POSITIONS"] = whole["ordinal_position"] & F.bool_or("_place")
        if "timestamp" in have:
            time = F.try_to_timestamp(F.col("timestamp").cast("string"))
            steps["_time"] = time.isNull() | (time <= F.lag(time).over(w))
            faults["INVALID_OR_UNORDERED_TIMESTAMPS"] = ~whole["ordinal_position"] & whole["timestamp"] & F.bool_or("_time")
    if boundary:
        faults["FUTURE_WINDOW_FORBIDDEN"] = F.bool_or(F.col("window_order") > F.col(boundary))
    faults["INSUFFICIENT_HISTORY"] = F.count("*") < LEAST
    g = windows.withColumns(steps).groupBy(key).agg(*[faults[c].alias(c) for c in ORDER_CODES if c in faults])
    g = g.select(key, first_reason(*[(F.col(c), c) for c in ORDER_CODES if c in faults]).alias("reason"))
    return g.select(key, first_reason(*[(F.col("reason") == c, s) for c, s in ORDER_CODES.items()], ok="ORDER_OK").alias("status"), "reason")


def _indexed(windows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, n, i, y): index of each window in its series, and the series' length, for series that can be fitted."""
    w = W.partitionBy(*key)
    r = windows.withColumn("i", (F.row_number().over(w.orderBy("window_order")) - 1).cast("int")).withColumn("n", F.count("*").over(w).cast("int")).withColumn("_bad", F.count_if(~finite("y")).over(w))
    return r.where((F.col("n") >= LEAST) & (F.col("_bad") == 0)).select(*key, "n", "i", "y")


#: Cubic basis functions of a series of six windows or more.
BASES = 6


def _basis() -> tuple[Column, Column, Column]:
    """The basis functions at window i of n as an array, and their first and second derivatives."""
    m = F.least("n", F.lit(BASES)) - 3
    x = F.col("i") * m / (F.col("n") - 1)
    p = F.least(F.floor(x).cast("int"), m - 1)
    table = F.array(*[F.array(*[F.array(*[F.lit(v) for v in c]) for c in functions]) for functions in pieces(BASES)])
    u, here = x - p, F.get(table, (p + m * (m - 1) / 2).cast("int"))
    value = F.transform(here, lambda c: c[0] + u * (c[1] + u * (c[2] + u * c[3])))
    return value, F.transform(here, lambda c: m * (c[1] + u * (2 * c[2] + u * 3 * c[3]))), F.transform(here, lambda c: m * m * (2 * c[2] + u * 6 * c[3]))


def linear_fit(windows: DataFrame, penalty: float = 0.0, key: Sequence[str] = ("acquisition_id",)) -> DataFrame:
    """(key, n, i, y, fitted, d1, d2, edf) of the B-spline (penalty 0) or P-spline fit of every series of 4 windows or more.

    The sums B'y combine before their shuffle; the inverse of the small normal matrix depends on the length alone and is
    made once for each length that occurs.
    """
    s = _indexed(windows, key)
    value, d1, d2 = _basis()
    sums = s.withColumn("_b", value).groupBy(*key, "n").agg(F.array(*[F.sum(F.col("_b")[k] * F.col("y")) for k in range(BASES)]).alias("_by"))

    def run(batches):
        for b in batches:
            found = [solver(int(n), penalty, BASES) for n in b["n"]]
            yield pd.DataFrame({"n": b["n"], "_m": [m.tolist() for m, _ in found], "edf": [e for _, e in found]})

    made = sums.select("n").distinct().mapInPandas(run, "n int, _m array<array<double>>, edf double")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    c = sums.join(made, "n").select(*key, "edf", F.transform("_m", lambda row: dot(row, F.col("_by"))).alias("_c"))
    j = s.join(c, list(key))
    return j.select(*key, "n", "i", "y", dot(value, F.col("_c")).alias("fitted"), dot(d1, F.col("_c")).alias("d1"), dot(d2, F.col("_c")).alias("d2"), "edf")


#: Windows of a series that one task fits with knots of its own; longer ones have SMOOTHING_BASES functions on uniform knots.
ADAPTIVE_MOST, SMOOTHING_BASES = 1 << 18, 16


def smoothing_fit(windows: DataFrame, budget: float = 0.25, key: Sequence[str] = ("acquisition_id",), adaptive: int = ADAPTIVE_MOST) -> DataFrame:
    """(key, n, i, y, fitted, d1, d2, edf) of a cubic smoothing spline whose squared residuals sum to `budget` times n at most.

    Knots are inserted where the residuals are largest until the budget can be kept, and the fit is the smoothest one on them;
    edf is the number of coefficients. A series of up to `adaptive` windows is a few arrays of its length in one task.
    """
    s = stored(_indexed(windows, key), "series")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        t, c = smoothing_spline(rows["y"].to_numpy(float), budget * len(rows))
        fitted, d1, d2 = evaluate(t, c, np.linspace(0, 1, len(rows)))
        return rows.assign(fitted=fitted, d1=d1, d2=d2, edf=float(len(c)))

    kinds = ", ".join(f"{c} {windows.schema[c].dataType.simpleString()}" for c in key)
    own = s.where(F.col("n") <= adaptive).groupBy(*key).applyInPandas(fit, f"{kinds}, n int, i int, y double, fitted double, d1 double, d2 double, edf double")
    long = s.where(F.col("n") > adaptive)
    return own if long.isEmpty() else own.unionByName(uniform_smoothing(long, budget, key))


def uniform_smoothing(s: DataFrame, budget: float, key: Sequence[str], most: int = SMOOTHING_BASES) -> DataFrame:
    """(key, n, i, y, fitted, d1, d2, edf) of the smoothest cubic spline on uniform knots, for rows (key, n, i, y).

    min(most, n) basis functions on uniform knots, roughness being the integral of the squared second derivative. A series
    whose least squares fit on these knots leaves more residuals gets that fit. Whatever its length, a series is `most`
    sums and y'y, which combine before their shuffle, and the fit is evaluated row by row.
    """

    def products(batches):
        for b in batches:
            out = np.zeros((len(b), most))
            n, i, y = (b[c].to_numpy() for c in ("n", "i", "y"))
            for k in np.unique(np.minimum(n, most)):
                at = np.minimum(n, most) == k
                out[at, :k] = basis(i[at] / (n[at] - 1), knots(k, 3, most), 3) * y[at, None]
            yield b.assign(_b=list(out))

    kinds = ", ".join(f"{c} {s.schema[c].dataType.simpleString()}" for c in key)
    rows = s.mapInPandas(products, f"{kinds}, n int, i int, y double, _b array<double>")
    sums = rows.groupBy(*key, "n").agg(F.array(*[F.sum(F.col("_b")[k]) for k in range(most)]).alias("_by"), F.sum(F.col("y") * F.col("y")).alias("_yy"))

    def solve(batches):
        grids: dict[int, tuple] = {}
        for b in batches:
            found = []
            for n, by, yy in zip(b["n"], b["_by"], b["_yy"], strict=True):
                if n not in grids:
                    if len(grids) == 1000:
                        grids.clear()
                    grids[n] = smoothing_grid(int(n), most)
                found.append(smoothest(*grids[n], np.asarray(by)[: min(n, most)], yy, budget * n))
            yield b.drop(columns=["_by", "_yy"]).assign(_c=[c for c, _ in found], edf=[e for _, e in found])

    solved = sums.mapInPandas(solve, f"{kinds}, n int, _c array<double>, edf double").drop("n")

    def evaluate(batches):
        for b in batches:
            out = np.zeros((3, len(b)))
            size = b["_c"].map(len).to_numpy()
            for k in np.unique(size):
                at = size == k
                t = knots(k, 3, most)
                d1, t1 = derivative_map(t, 3)
                d2, t2 = derivative_map(t1, 2)
                x, c = b["i"].to_numpy()[at] / (b["n"].to_numpy()[at] - 1), np.stack(b["_c"].to_numpy()[at])
                for m, part in enumerate((basis(x, t, 3), basis(x, t1, 2) @ d1, basis(x, t2, 1) @ d2 @ d1)):
                    out[m, at] = (part * c).sum(1)
            yield b.drop(columns="_c").assign(fitted=out[0], d1=out[1], d2=out[2])[[*key, "n", "i", "y", "fitted", "d1", "d2", "edf"]]

    return s.join(solved, list(key)).mapInPandas(evaluate, f"{kinds}, n int, i int, y double, fitted double, d1 double, d2 double, edf double")


def finite_difference_fit(windows: DataFrame, key: Sequence[str] = ("acquisition_id",)) -> DataFrame:
    """(key, n, i, y, fitted, d1, d2, edf): the values themselves, central differences at unit spacing, one-sided at the ends."""
    s = _indexed(windows, key)
    w = W.partitionBy(*key).orderBy("i")

    def slope(c: str) -> Column:
        a, b = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce((b - a) / 2, b - F.col(c), F.col(c) - a)

    return s.withColumn("fitted", F.col("y")).withColumn("d1", slope("y")).withColumn("d2", slope("d1")).withColumn("edf", F.col("n").cast("double"))


def descriptors(fit: DataFrame, key: Sequence[str] = ("acquisition_id",)) -> DataFrame:
    """Trend evidence of each series: last values, curvature, error, roughness by trapezoids on 0 .. 1, uncertainty."""
    curve = F.abs(F.col("d2")) / F.pow(1 + F.col("d1") * F.col("d1"), F.lit(1.5))
    w = W.partitionBy(*key).orderBy("i")
    sq = F.col("d2") * F.col("d2")
    f = fit.withColumn("_c", curve).withColumn("_t", (sq + F.lag(sq).over(w)) / 2 / (F.col("n") - 1)).withColumn("_r", (F.col("y") - F.col("fitted")) * (F.col("y") - F.col("fitted")))
    last = lambda c: F.max_by(c, "i")
    g = f.groupBy(*key).agg(last("fitted").alias("trend_value"), last("d1").alias("first_derivative"), last("d2").alias("second_derivative"), last("_c").alias("curvature"), F.max("_c").alias("maximum_curvature"), F.sqrt(F.avg("_r")).alias("fit_rmse"), F.sum("_t").alias("roughness"), F.first("edf").alias("effective_degrees_of_freedom"), F.sqrt(F.sum("_r") / F.greatest(F.first("n") - F.first("edf"), F.lit(1.0))).alias("uncertainty"))
    return g


def with_status(windows: DataFrame, evidence: DataFrame, key: Sequence[str] = ("acquisition_id",)) -> DataFrame:
    """All series with window_count, fit_status and reason; those that weren't fitted have null numbers."""
    n = windows.groupBy(*key).agg(F.count("*").alias("window_count"), F.count_if(~finite("y")).alias("_bad"))
    j = n.join(evidence, list(key), "left")
    status = first_reason((F.col("window_count") < LEAST, "INSUFFICIENT_HISTORY"), (F.col("_bad") > 0, "NON_FINITE_SIGNAL"), (F.col("trend_value").isNull(), "FIT_FAILED"), ok="FIT_OK")
    reason = F.when(F.col("window_count") < LEAST, F.concat(F.lit("needs "), F.lit(LEAST).cast("string"), F.lit(" windows, has "), F.col("window_count").cast("string")))
    return j.withColumn("fit_status", status).withColumn("reason", reason).drop("_bad")


def expanding(windows: DataFrame, key: str = "acquisition_id") -> DataFrame:
    """(key, boundary, window_order, y): each prefix of each series as a series of its own; what an online model sees.

    The prefixes of n windows have n * (n + 1) / 2 rows, dealt out by the window that ends them.
    """
    w = W.partitionBy(key)
    s = windows.withColumn("_i", F.row_number().over(w.orderBy("window_order"))).withColumn("_n", F.count("*").over(w).cast("int"))
    ends = s.select(key, F.col("_i").alias("_j"), F.col("window_order").alias("boundary"))
    later = s.select(key, "window_order", "y", F.explode(F.sequence("_i", "_n")).alias("_j"))
    return later.join(ends, [key, "_j"]).select(key, "boundary", "window_order", "y")


def prefix_fits(windows: DataFrame, penalty: float = 0.0, key: str = "acquisition_id") -> DataFrame:
    """(key, boundary, n, trend_value, first_derivative, fit_rmse): the fit of each prefix of 4 windows or more, at its last window.

    The same numbers as `linear_fit` of `expanding`, but a row a prefix: prefix sums of the values' moments are looked up at the
    ends of the prefix's knot intervals. Prefixes that hold a value that isn't finite have no row.
    """
    w = W.partitionBy(key).orderBy("window_order")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    i = (F.row_number().over(w) - 1).cast("double")
    s = windows.select(key, "window_order", "y", i.alias("_i"), F.count_if(~finite("y")).over(run).alias("_bad"), F.first("y").over(w).alias("level")).where("_bad = 0")
    z = F.col("y") - F.col("level")
    sums = [F.sum(F.pow("_i", F.lit(float(r))) * z).over(run) if r else F.sum(z).over(run) for r in range(4)]
    s = stored(s.select(key, F.col("window_order").alias("boundary"), "level", (F.col("_i") + 1).cast("int").alias("n"), F.array(*sums, F.sum(z * z).over(run)).alias("sums")), "prefixes")
    m = F.least("n", F.lit(BASES)) - 3
    at = lambda p: F.when(F.lit(p) < m, F.ceil(p * (F.col("n") - 1) / m)).otherwise(F.col("n")).cast("int")
    asked = s.where(F.col("n") >= LEAST).select(key, F.col("n").alias("of"), F.explode(F.array(at(1), at(2))).alias("n"))
    told = asked.distinct().join(s.select(key, "n", "sums"), [key, "n"]).groupBy(key, "of").agg(F.map_from_entries(F.collect_list(F.struct("n", "sums"))).alias("before"))
    rows = s.where(F.col("n") >= LEAST).join(told.withColumnRenamed("of", "n"), [key, "n"])
    rows = rows.select(key, "boundary", "level", "n", F.array(F.element_at("before", at(1)), F.element_at("before", at(2)), "sums").alias("sums"))

    def fit(batches):
        for b in batches:
            if len(b):
                prefix = np.concatenate([np.zeros((len(b), 1, 5)), np.array([[list(x) for x in row] for row in b["sums"]])], 1)
                value, slope, error = last_fits(b["n"].to_numpy(), prefix, penalty)
                yield b.assign(trend_value=b["level"] + value, first_derivative=slope, fit_rmse=error)[[key, "boundary", "n", "trend_value", "first_derivative", "fit_rmse"]]

    kind = lambda c: windows.schema[c].dataType.simpleString()
    return rows.mapInPandas(fit, f"{key} {kind(key)}, boundary {kind('window_order')}, n int, trend_value double, first_derivative double, fit_rmse double")


def status_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("fit_status").agg(F.count("*").alias("n"))


def trend_failures(plan: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plan units with the status TREND_FAILED where their trend wasn't fitted, all keys equal."""
    failed = evidence.where("fit_status <> 'FIT_OK'").select(*keys).distinct().withColumn("_f", F.lit(True))
    j = plan.join(failed, list(keys), "left")
    return j.withColumn("status", F.when(F.col("_f"), "TREND_FAILED").otherwise(F.col("status"))).drop("_f")


def fit_quality(fit: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, quality): 1 - var(residual) / var(y), at least 0; a constant series fits fully."""
    v = F.var_pop("y")
    return fit.groupBy(*key).agg(F.when(v > 0, F.greatest(F.lit(0.0), 1 - F.var_pop(F.col("y") - F.col("fitted")) / v)).otherwise(1.0).alias("quality"))
