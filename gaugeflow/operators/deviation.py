"""Deviation from the training distribution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import content_hash, fixed
from ..plans.storage import stored
from .ranks import cumulative


def fit_covariance(df: DataFrame, view: Sequence[str], x: str = "x") -> DataFrame:
    """(view, i, j, mean_i, mean_j, scale_i, scale_j, cov): Ledoit-Wolf covariance of the standardised training rows.

    Everything is sums over rows: each batch gives one product Z'Z, which add up to the sample covariance S, and its sum of
    fourth powers of norms.
    With m = tr(S) / p, d2 = |S - m I|^2, b2 = min((mean |z|^4 - |S|^2) / n, d2), the result is b2/d2 m I + (1 - b2/d2) S.
    """
    train = df.where(F.col("split_role") == "train")
    cells = train.select(*view, F.posexplode(x).alias("i", "v"))
    stats = cells.groupBy(*view, "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stats = stats.groupBy(*view).agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("t"))
    z = train.join(stats, list(view)).select(*view, F.zip_with(x, "t", lambda v, t: (v - t["m"]) / t["s"]).alias("z"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, part in b.groupby(list(view), dropna=False, sort=False):
                m = np.stack(part["z"].to_numpy())
                squares = (m * m).sum(1)
                out.append([*key, len(m), m.shape[1], float(squares @ squares), (m.T @ m).ravel()])
            yield pd.DataFrame(out, columns=[*view, "n", "p", "fourth", "products"])

    kinds = ", ".join(f"{v} {df.schema[v].dataType.simpleString()}" for v in view)
    sums = stored(z.mapInPandas(run, f"{kinds}, n long, p int, fourth double, products array<double>"), "products")
    norms = sums.groupBy(*view).agg(F.sum("n").alias("n"), (F.sum("fourth") / F.sum("n")).alias("fourth"), F.first("p").alias("p"))
    cell = sums.select(*view, "n", "p", F.posexplode("products").alias("at", "s"))
    s = cell.groupBy(*view, F.floor(F.col("at") / F.col("p")).cast("int").alias("i"), (F.col("at") % F.col("p")).alias("j")).agg((F.sum("s") / F.sum("n")).alias("s"))
    shape = s.groupBy(*view).agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("s")).otherwise(0.0)).alias("trace"), F.sum(F.col("s") * F.col("s")).alias("square"))
    k = shape.join(norms, list(view))
    m = F.col("trace") / F.col("p")
    d2 = F.col("square") - 2 * m * F.col("trace") + m * m * F.col("p")
    b2 = F.greatest(F.lit(0.0), F.least((F.col("fourth") - F.col("square")) / F.col("n"), d2))
    k = k.select(*view, m.alias("mu"), F.when(d2 > 0, b2 / d2).otherwise(0.0).alias("shrink"))
    out = s.join(k, list(view)).join(stats, list(view))
    cov = (1 - F.col("shrink")) * F.col("s") + F.when(F.col("i") == F.col("j"), F.col("shrink") * F.col("mu")).otherwise(0.0)
    at = lambda c, f: F.get("t", F.col(c))[f].alias(f"{'mean' if f == 'm' else 'scale'}_{c}")
    return out.select(*view, "i", "j", at("i", "m"), at("j", "m"), at("i", "s"), at("j", "s"), cov.alias("cov"))


def invert_precision(cov: DataFrame, view: Sequence[str]) -> DataFrame:
    """(view, mean, scale, precision): one small matrix a view, inverted by numpy; its size is the number of features, squared."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["i", "j"])
        p = int(rows["i"].max()) + 1
        inv = np.linalg.inv(rows["cov"].to_numpy().reshape(p, p))
        first = rows[rows["j"] == 0]
        return pd.DataFrame([[*key, first["mean_i"].tolist(), first["scale_i"].tolist(), inv.tolist()]], columns=[*view, "mean", "scale", "precision"])

    kinds = ", ".join(f"{v} {cov.schema[v].dataType.simpleString()}" for v in view)
    return cov.groupBy(*view).applyInPandas(run, f"{kinds}, mean array<double>, scale array<double>, precision array<array<double>>")


def mahalanobis(df: DataFrame, scorer: DataFrame, view: Sequence[str], x: str = "x") -> DataFrame:
    """Rows with d2, the squared distance to their own view's training rows, at least 0; rows of unknown views have none."""
    j = df.join(scorer, list(view), "left")
    z = F.zip_with(F.zip_with(x, "mean", lambda a, b: a - b), "scale", lambda a, b: a / b)
    j = j.withColumn("_z", z)
    row = lambda r: F.aggregate(F.zip_with(r, "_z", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    d2 = F.aggregate(F.zip_with("_z", F.transform("precision", row), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return j.withColumn("d2", F.greatest(F.lit(0.0), d2)).drop("_z", "mean", "scale", "precision")


def deviation_score(df: DataFrame, view: Sequence[str], distance: str = "d2") -> DataFrame:
    """Rows with deviation = (1 + number of training rows at most as far) / (training rows + 1) in their view.

    Training rows are counted by distance, so ties count in, and ranked by ranges of it, however large a view is. Rows meet
    their counts by the distance itself, so it is worked out once and stored: made again from sums in another order, it may
    differ in its last place, and the row would be lost.
    """
    df = stored(df, "distances")
    n = df.groupBy(*view, distance).agg(F.count_if(F.col("split_role") == "train").alias("n"))
    ranked = cumulative(n, view, distance).select(*view, distance, F.col("upto").alias("_le"), F.col("total").alias("_n"))
    j = df.join(ranked, [*view, distance])
    return j.withColumn("deviation", (1 + F.col("_le")) / (F.col("_n") + 1)).drop("_le", "_n")


def score_records(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Held-out rows with a hash of keys and score; training rows aren't scored."""
    held = scored.where(F.col("split_role") != "train")
    return held.select(*keys, "d2", "deviation", content_hash(*keys, fixed("deviation")).alias("score_hash"))


def score_distribution(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, lowest, mean, highest, saturated) of deviation."""
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.min("deviation").alias("lowest"), F.avg("deviation").alias("mean"), F.max("deviation").alias("highest"), F.avg((F.col("deviation") == 1.0).cast("double")).alias("saturated"))
