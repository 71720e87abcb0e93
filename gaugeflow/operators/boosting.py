"""Gradient boosting of several classes at once: histograms of gradients by bin, trees grown leaf by leaf.

An iteration grows one tree a class on the softmax gradients. A pass over the rows sums gradients, curvatures and counts by
(tree, node, feature, bin): each task adds up its own rows, Spark adds up the tasks and finds the best cut of every node by
prefix sums over the bins. What reaches the driver is one row a node. Growing leaf by leaf takes one split after another; here,
with m splits left, a pass opens the next leaf and the m best of all leaves found so far, and the order of splits is replayed
on what is then known. What was opened in vain is dropped: the tree is that of one split after another, for about as many passes
as it is deep. Scores are written after each iteration, so a lost executor costs no more than the pass it was in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..plans.storage import stored

MOST_BINS = 255
#: The least sum of curvatures on either side of a cut.
LEAST_CURVATURE = 1e-3


@dataclass
class Tree:
    """Nodes by number, the root being 0. A node without children is a leaf; `known` has (gain, feature, cut, gradient, curvature)."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    known: dict[int, tuple] = field(default_factory=dict)

    def open(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        """Splits a leaf; its children are two new nodes next to each other."""
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for _ in range(2):
            self.feature.append(-1), self.cut.append(0), self.left.append(-1), self.value.append(0.0)
        return self.left[node], self.left[node] + 1

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins; a value beyond the cut goes right."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(bins), np.int64)
        while len(rows := np.flatnonzero(feature[at] >= 0)):
            node = at[rows]
            at[rows] = left[node] + (bins[rows, feature[node]] > cut[node])
        return at

    def splits(self, leaves: int) -> tuple[list[int], list[int]]:
        """(nodes in the order in which they are split, leaves to open before the order can go on)."""
        done, ends = [], [0]
        while len(done) < leaves - 1:
            able = sorted((n for n in ends if self.known[n][0] > 0), key=lambda n: (-self.known[n][0], n))
            if not able:
                break
            if self.left[able[0]] < 0:
                shut = sorted((n for n, k in self.known.items() if self.left[n] < 0 and k[0] > 0), key=lambda n: (-self.known[n][0], n))
                return done, sorted({able[0], *shut[: leaves - 1 - len(done)]})
            done.append(able[0])
            ends.remove(able[0])
            ends += [self.left[able[0]], self.left[able[0]] + 1]
        return done, []

    def pruned(self, done: Sequence[int], rate: float, ridge: float) -> Tree:
        """The tree of these splits alone, with the Newton step of each leaf times the learning rate."""
        out, todo = Tree(), [(0, 0)]
        while todo:
            mine, old = todo.pop()
            if old in done:
                todo += zip(out.open(mine, self.feature[old], self.cut[old]), (self.left[old], self.left[old] + 1), strict=True)
            else:
                out.value[mine] = -rate * self.known[old][3] / (self.known[old][4] + ridge + 1e-15)
        return out


@dataclass(frozen=True)
class Boosted:
    """Bounds of the bins of each column, scores before the first tree, and the trees by iteration and class."""

    columns: tuple[str, ...]
    bounds: tuple[np.ndarray, ...]
    start: np.ndarray
    rounds: tuple[tuple[Tree, ...], ...]


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The rows of a batch's last column, arrays of doubles, nulls being NaN."""
    values = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(-1, width)


def _binned(x: np.ndarray, bounds: Sequence[np.ndarray]) -> np.ndarray:
    """Bin i holds what is over bound i - 1 and at most bound i; NaN is in the last bin."""
    return np.stack([np.searchsorted(b, x[:, k], "left") for k, b in enumerate(bounds)], axis=1).astype(np.uint8)


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def _scores(batch: pa.RecordBatch, classes: int) -> np.ndarray:
    return batch.column("raw").flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)


def _bytes(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)


def bin_bounds(rows: DataFrame, columns: Sequence[str], bins: int = MOST_BINS) -> tuple[np.ndarray, ...]:
    """The different quantiles of each column's values, at most `bins` of them (themselves at most 255), by Spark's quantile summaries."""
    steps = [k / bins for k in range(1, bins)]
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    found = rows.agg(*[F.percentile_approx(finite(c), steps, 20 * bins).alias(f"q{k}") for k, c in enumerate(columns)]).first()
    return tuple(np.unique(np.array(q if q is not None else [], float)) for q in found)


def _best_cuts(table: DataFrame, trees: Sequence[Tree], wanted: Sequence[tuple[int, int]], width: int, least: int, ridge: float) -> dict[tuple[int, int], tuple]:
    """{(tree, node): (gain, feature, cut, gradient, curvature)} of the wanted nodes; a node that can't be split has gain 0."""
    classes = len(trees)
    asked = [[n for k, n in wanted if k == tree] for tree in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = MOST_BINS + 1
        sums = [np.zeros((3, len(nodes), width, size)) for nodes in asked]
        for batch in batches:
            bins, y = _bytes(batch, width), batch.column("y").to_numpy()
            p = _softmax(_scores(batch, classes))
            for k, (tree, nodes) in enumerate(zip(trees, asked, strict=True)):
                spot = np.full(len(tree.feature), -1)
                spot[nodes] = np.arange(len(nodes))
                node = spot[tree.places(bins)]
                rows = np.flatnonzero(node >= 0)
                g, h = p[rows, k] - (y[rows] == k), p[rows, k] * (1 - p[rows, k])
                for f in range(width):
                    cell = node[rows] * size + bins[rows, f]
                    for s, weights in zip(sums[k], (g, h, None), strict=True):
                        s[:, f] += np.bincount(cell, weights, len(nodes) * size).reshape(-1, size)
        for k, nodes in enumerate(asked):
            at, f, cut = np.nonzero(sums[k][2])
            names = [np.full(len(at), k, np.int32), np.array(nodes, np.int32)[at] if nodes else at.astype(np.int32), f.astype(np.int32), cut.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in [*names, *(s[at, f, cut] for s in sums[k])]], ["tree", "node", "feature", "cut", "g", "h", "n"])

    cells = table.mapInArrow(run, "tree int, node int, feature int, cut int, g double, h double, n double")
    # Tasks have added up their rows: one shuffle by node and feature serves the sums of bins and the prefix sums over them.
    cells = cells.repartition("tree", "node", "feature").groupBy("tree", "node", "feature", "cut").agg(*[F.sum(c).alias(c) for c in "ghn"])
    whole = W.partitionBy("tree", "node", "feature")
    upto = whole.orderBy("cut").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = cells.select("tree", "node", "feature", "cut", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(whole).alias(f"{c}w") for c in "ghn"])
    part = lambda g, h: g * g / (h + ridge)
    left, right = {c: F.col(f"{c}l") for c in "ghn"}, {c: F.col(f"{c}w") - F.col(f"{c}l") for c in "ghn"}
    sound = (F.least(left["n"], right["n"]) >= least) & (F.least(left["h"], right["h"]) >= LEAST_CURVATURE)
    gain = F.when(sound, part(left["g"], left["h"]) + part(right["g"], right["h"]) - part(F.col("gw"), F.col("hw"))).otherwise(0.0)
    # Sums in another order must not break ties differently: of equal gains the first feature, then the first cut.
    best = F.max(F.struct(F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("cut")).alias("c"), "gw", "hw"))
    rows = s.groupBy("tree", "node").agg(best.alias("b")).select("tree", "node", "b.*").collect()  # a row a node: classes times leaves at most
    return {(r["tree"], r["node"]): (r["gain"], -r["f"], -r["c"], r["gw"], r["hw"]) for r in rows}


def _grown(table: DataFrame, classes: int, width: int, leaves: int, least: int, rate: float, ridge: float) -> tuple[Tree, ...]:
    """One tree a class, all of them grown in the same passes."""
    trees = [Tree() for _ in range(classes)]
    wanted = [(k, 0) for k in range(classes)]
    while wanted:
        for (k, node), found in _best_cuts(table, trees, wanted, width, least, ridge).items():
            trees[k].known[node] = found
        wanted = [(k, child) for k, t in enumerate(trees) for node in t.splits(leaves)[1] for child in t.open(node, *t.known[node][1:3])]
    return tuple(t.pruned(t.splits(leaves)[0], rate, ridge) for t in trees)


def fit_boosted(rows: DataFrame, columns: Sequence[str], label: str, classes: int, iterations: int = 200, leaves: int = 31, least: int = 20, rate: float = 0.1, ridge: float = 0.0, bins: int = MOST_BINS) -> Boosted:
    """Boosted trees of the rows, whose `label` is the class number from 0; rows of other or null labels aren't learnt from.

    leaves is the most of a tree and least the fewest rows of a leaf. NaN and null values count as larger than all others. A class without rows gets a
    probability of almost 0; a table without rows gives equal probabilities.
    """
    if not 2 <= bins <= MOST_BINS:
        raise ValueError("2 to 255 bins")
    rows = rows.where(F.col(label).between(0, classes - 1)).select(F.col(label).cast("int").alias("y"), _vector(columns).alias("x"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # a row a class
    total = sum(counts.values())
    if not total:
        return Boosted(tuple(columns), tuple(np.zeros(0) for _ in columns), np.zeros(classes), ())
    start = np.log(np.maximum([counts.get(k, 0) / total for k in range(classes)], 1e-15))
    bounds, width = bin_bounds(rows, [f"c{k}" for k in range(len(columns))], bins), len(columns)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = [r.tobytes() for r in _binned(_matrix(b, width), bounds)]
            raw = pa.array([start] * len(coded), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(coded, pa.binary()), raw], ["y", "bins", "raw"])

    schema = "y int, bins binary, raw array<double>"
    table = stored(rows.select("y", "x").mapInArrow(encode, schema), "boosted")
    rounds: list[tuple[Tree, ...]] = []
    for k in range(iterations):
        trees = _grown(table, classes, width, leaves, least, rate, ridge)
        rounds.append(trees)
        if k + 1 == iterations or all(len(t.feature) == 1 for t in trees):
            break  # trees without a split: nothing more can be learnt

        def step(batches: Iterator[pa.RecordBatch], trees: tuple[Tree, ...] = trees) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw = _scores(b, classes) + _values(trees, _bytes(b, width))
                yield pa.RecordBatch.from_arrays([b.column("y"), b.column("bins"), pa.array(list(raw), pa.list_(pa.float64()))], ["y", "bins", "raw"])

        table = stored(table.mapInArrow(step, schema), "boosted")
    return Boosted(tuple(columns), bounds, start, tuple(rounds))


def _values(trees: Sequence[Tree], bins: np.ndarray) -> np.ndarray:
    return np.stack([np.array(t.value)[t.places(bins)] for t in trees], axis=1)


def boosted_probabilities(rows: DataFrame, model: Boosted, keys: Sequence[str]) -> DataFrame:
    """(keys, p): the probability of each class, in order. The model's size depends on its iterations, classes and leaves alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = _binned(_matrix(b, len(model.columns)), model.bounds)
            raw = np.tile(model.start, (len(bins), 1))
            for trees in model.rounds:
                raw += _values(trees, bins)
            p = pa.array(list(_softmax(raw)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], p], [*keys, "p"])

    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))])
    return rows.select(*keys, _vector(model.columns).alias("_x")).mapInArrow(run, schema)
