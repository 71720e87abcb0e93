"""Quality classifier: hashed word n-grams, logistic regression by FTRL updates, scores as sparse dot products."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import labelled_sample
from .linear import Ftrl, fit_shards, sigmoid, sparse

#: Runs of word characters, or of other characters that aren't white space: punctuation is evidence too.
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]+")
_SAME = crc32(b" = ")
BITS = 18
MAX_TRAIN_ROWS = 16_000
MAX_TRAIN_BYTES = 32_000_000
SHARDS = 1


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's word 1-grams and 2-grams, each once, and their values: log counts scaled to length 10, and a bias.

    A word that repeats the one before counts as the same token whichever word it is. The last bucket is the bias; an empty
    text has the bias alone.
    """
    words = _TOKEN.findall(text.lower())
    h = np.fromiter(map(crc32, words), np.uint32, len(words))
    h[1:][h[1:] == h[:-1]] = _SAME
    pairs = h[:-1] * np.uint32(0x9E3779B1) ^ h[1:] * np.uint32(0x85EBCA6B)
    upper = np.uint32(32 - bits)
    at, counts = np.unique(np.concatenate([h, pairs]) * np.uint32(2654435761) >> upper, return_counts=True)
    at, counts = at[at != (1 << bits) - 1], counts[at != (1 << bits) - 1]
    x = np.log1p(counts)
    x /= max(1e-9, np.sqrt(x @ x))
    return np.append(at.astype(np.int64), (1 << bits) - 1), np.append(10 * x, 1.0)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS, max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES, shards: int = SHARDS, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.1, l2: float = 0.0) -> np.ndarray:
    """Weights of the 2**bits buckets, learnt from about `max_rows` labelled rows and `max_bytes` of text at most (a documented bound).

    Rows of the held-out fifth are never used. Without labelled rows all weights are 0, so every score is 0.5.
    """

    def fit(texts: list[bytes], ys: list[int]):
        model, rows = Ftrl(1 << bits, alpha, beta, l1, l2), [features(t, bits) for t in texts]
        for _ in range(epochs):
            for (at, x), y in zip(rows, ys, strict=True):
                w = model.weights(at)
                model.update(at, w, (sigmoid(w @ x) - y) * x)
        return sparse(model.weights(np.arange(1 << bits)))

    return fit_shards(labelled_sample(docs, labels, label, max_rows, max_bytes, shards), fit, 1 << bits, shards)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every row's whole text; null counts as empty. No shuffle; the weights have a fixed size.

    Repeated rows are scored each, ids may be null, an empty table gives an empty result; other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            found = [features(t, bits) for t in b.column("text").to_pylist()]
            scores = sigmoid(np.array([float(w[at] @ x) for at, x in found]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, bits: int = BITS) -> DataFrame:
    """The rows of `docs` that score at least `threshold`, each judged on its own text where it stands: nothing is shuffled.

    A null text counts as empty; rows of a repeated doc_id, or of none, are judged apart; all columns stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            found = [features(t or b"", bits) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array([float(sigmoid(w[at] @ x)) >= threshold for at, x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
