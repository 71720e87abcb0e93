"""Hashed sparse linear models, trained with follow-the-regularised-leader updates on a bounded sample.

A bounded sample's rows are dealt to a fixed number of shards (one by default: the updates are sequential, and the sample
is small enough for one task); each shard runs the updates in hash order in its own task, and the shards' weights are
averaged in Spark. What reaches the driver is one weight per hash bucket, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Ftrl:
    """State of FTRL-proximal logistic regression (McMahan et al. 2013) over `dims` buckets."""

    def __init__(self, dims: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(dims), np.zeros(dims)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def update(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """`at` holds no bucket twice; w are its weights, g its gradients."""
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def fit_shards(sample: DataFrame, fit: Callable[[list[bytes], list[int]], tuple[np.ndarray, np.ndarray]], dims: int, shards: int) -> np.ndarray:
    """Average over the shards of the weights that `fit(texts, labels)` gives as (buckets, weights). An empty sample gives zeros."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["text", "y"])
        rows = rows.sample(frac=1, random_state=11)  # the same order in every run, copies of a text apart
        at, w = fit(list(rows["text"]), [int(y) for y in rows["y"]])
        return pd.DataFrame({"bucket": at.astype(np.int32), "w": w.astype(float), "rows": len(rows)})

    parts = sample.groupBy("shard").applyInPandas(run, "bucket int, w double, rows long")
    # Shards weigh by their rows; each shard tells them with bucket -1.
    total = parts.groupBy("bucket").agg(F.sum(F.col("w") * F.col("rows")).alias("w"), F.sum("rows").alias("rows")).toPandas()
    rows = total.loc[total["bucket"] == -1, "rows"].sum()
    total = total[total["bucket"] >= 0]
    out = np.zeros(dims)
    if rows:
        out[total["bucket"].to_numpy()] = np.round(total["w"].to_numpy() / rows, 9)  # the order of a sum must not show
    return out


def sparse(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of the weights that aren't zero, after bucket -1 that stands for the shard."""
    at = np.flatnonzero(w)
    return np.append(-1, at), np.append(0.0, w[at])


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
