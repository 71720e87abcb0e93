"""Toxicity by multiple-instance learning.

Only documents have labels. Each sentence gets a probability of its own, the noisy-or of the sentences is the document's,
and the sentence weights are trained through it, so that the sentences that offend can be located afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import labelled_sample
from .linear import Ftrl, fit_shards, sigmoid, sparse

_SENTENCE = re.compile(rb"[^.!?\n]*[.!?\n]*")
_WORD = re.compile(rb"[a-z\x80-\xff]+")
BITS = 18
MAX_TRAIN_ROWS = 24_000
MAX_TRAIN_BYTES = 32_000_000
SHARDS = 1
_PREFIX = 6  # bytes


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Byte spans (start, end) of the text's sentences, which cover it; an empty text is one empty sentence."""
    return [m.span() for m in _SENTENCE.finditer(text) if m.end() > m.start()] or [(0, 0)]


def instances(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """(sentence number, bucket) of each sentence's different words and word beginnings, and the number of sentences."""
    low, buckets, owner, spans = text.lower(), [], [], sentences(text)
    for k, (a, b) in enumerate(spans):
        words = set(_WORD.findall(low, a, b))
        # a beginning cut inside a character is still the same bytes in every such word
        found = {crc32(w) for w in words} | {crc32(b"^" + w[:_PREFIX]) for w in words if len(w) > _PREFIX}
        buckets += found
        owner += [k] * len(found)
    at = (np.array(buckets, np.uint32) * np.uint32(2654435761) >> np.uint32(32 - bits)).astype(np.int64)
    return np.array(owner, np.int64), np.minimum(at, (1 << bits) - 2), len(spans)


def _sentence_scores(w: np.ndarray, owner: np.ndarray, at: np.ndarray, n: int, bias: float) -> np.ndarray:
    return sigmoid(bias + np.bincount(owner, w[at], n))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bits: int = BITS, max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES, shards: int = SHARDS, epochs: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 1.0, l2: float = 0.01, start: float = -7.0) -> np.ndarray:
    """Weights of the 2**bits buckets, the last being the bias, learnt from about `max_rows` labelled rows and
    `max_bytes` of text at most.

    The gradient of a sentence's logit is p for a clean document, and -p (1 - P) / P for a toxic one, P being the noisy-or.
    Rows of the held-out fifth are never used. Without labelled rows every sentence has probability 0.5.
    """
    last = (1 << bits) - 1

    def fit(texts: list[bytes], ys: list[int]):
        model, rows = Ftrl(1 << bits, alpha, beta, l1, l2), []
        for t in texts:
            owner, at, n = instances(t, bits)
            used, inverse = np.unique(at, return_inverse=True)
            rows.append((owner.astype(np.int32), used.astype(np.int32), inverse.astype(np.int32), n))
        bias, squares = start, 1.0
        for _ in range(epochs):
            for (owner, used, inverse, n), y in zip(rows, ys, strict=True):
                w = model.weights(used)
                p = sigmoid(bias + np.bincount(owner, w[inverse], n))
                whole = max(noisy_or(p), 1e-9)
                g = p if not y else -p * ((1 - whole) / whole)
                model.update(used, w, np.clip(np.bincount(inverse, g[owner], len(used)), -3, 3))
                step = float(np.clip(g.sum(), -3, 3))
                squares += step * step
                bias -= 0.1 * step / np.sqrt(squares)
        out = model.weights(np.arange(1 << bits))
        out[last] = bias
        return sparse(out)

    return fit_shards(labelled_sample(docs, labels, label, max_rows, max_bytes, shards), fit, 1 << bits, shards)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """(doc_id, score, worst_start, worst_end, worst_score) of every row's whole text; null counts as empty.

    The worst sentence is given in code points, the first of equals. No shuffle; the weights have a fixed size. Repeated rows
    are scored each, ids may be null, an empty table gives an empty result; other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, names = sent.value, ["doc_id", "score", "worst_start", "worst_end", "worst_score"]
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                owner, at, n = instances(text, bits)
                p = _sentence_scores(w, owner, at, n, w[-1])
                k = int(np.argmax(p))
                a, z = sentences(text)[k]
                a, z = (len(text[:x].decode(errors="replace")) for x in (a, z))
                out.append((noisy_or(p), a, z, float(p[k])))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names)

    rows = _texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, worst_start long, worst_end long, worst_score double")


def locate(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5, bits: int = BITS) -> DataFrame:
    """(doc_id, start, end, sentence, score) of the sentences that score at least `threshold` themselves, in code points.

    Null and empty texts have no sentences; repeated rows give theirs each; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                owner, at, n = instances(text, bits)
                p, spans = _sentence_scores(w, owner, at, n, w[-1]), sentences(text)
                for k in np.flatnonzero(p >= threshold):
                    a, z = spans[k]
                    said = text[a:z].decode(errors="replace")
                    first = len(text[:a].decode(errors="replace"))
                    out.append((doc, first, first + len(said), said, float(p[k])))
            cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
            kinds = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "start", "end", "sentence", "score"])

    rows = _texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, end long, sentence string, score double")


def drop_toxic(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5, bits: int = BITS) -> DataFrame:
    """The rows of `docs` that score under `threshold`, each judged on its own text where it stands: nothing is shuffled.

    A null text counts as empty; rows of a repeated doc_id are judged apart; all columns stay. A model that has learnt
    nothing, for want of labelled rows, rejects nothing.
    """
    if not weights.any():
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            clean = []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                owner, at, n = instances(text or b"", bits)
                clean.append(noisy_or(_sentence_scores(w, owner, at, n, w[-1])) < threshold)
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
