"""The learnt operators against plain re-implementations: dictionaries, one word and one row at a time."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import pandas as pd
from pyspark.sql import functions as F

from conftest import DATA
from gaugeflow.llm import quality, toxicity

BITS = 18
LAST = 2**BITS - 1


def bucket(h: int) -> int:
    return (h * 2654435761 % 2**32) >> (32 - BITS)


def squash(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


class PlainFtrl:
    def __init__(self, alpha, beta, l1, l2):
        self.z, self.n, self.c = defaultdict(float), defaultdict(float), (alpha, beta, l1, l2)

    def weight(self, k):
        alpha, beta, l1, l2 = self.c
        z = self.z[k]
        return 0.0 if abs(z) <= l1 else -math.copysign(abs(z) - l1, z) / ((beta + math.sqrt(self.n[k])) / alpha + l2)

    def update(self, k, w, g):
        sigma = (math.sqrt(self.n[k] + g * g) - math.sqrt(self.n[k])) / self.c[0]
        self.z[k] += g - sigma * w
        self.n[k] += g * g


def plain_features(text: str) -> dict[int, float]:
    words = re.findall(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]+", text.encode().lower())
    hashes = [crc32(b" = ") if k and w == words[k - 1] else crc32(w) for k, w in enumerate(words)]
    grams = hashes + [(a * 0x9E3779B1 % 2**32) ^ (b * 0x85EBCA6B % 2**32) for a, b in zip(hashes, hashes[1:])]
    logs = {k: math.log1p(c) for k, c in Counter(map(bucket, grams)).items() if k != LAST}
    norm = math.sqrt(sum(v * v for v in logs.values())) or 1.0
    return {k: 10 * v / norm for k, v in logs.items()} | {LAST: 1.0}


def plain_instances(text: str) -> list[list[int]]:
    said = [s for s in re.findall(rb"[^.!?\n]*[.!?\n]*", text.encode().lower()) if s] or [b""]
    out = []
    for s in said:
        words = set(re.findall(rb"[a-z\x80-\xff]+", s))
        hashes = {crc32(w) for w in words} | {crc32(b"^" + w[:6]) for w in words if len(w) > 6}
        out.append([min(bucket(h), LAST - 1) for h in hashes])
    return out


def in_order(rows: list[tuple[bytes, int]]) -> list[tuple[str, int]]:
    """The order of the updates, which is part of the operator's definition."""
    table = pd.DataFrame(rows, columns=["text", "y"]).sort_values(["text", "y"]).sample(frac=1, random_state=11)
    return [(t.decode(), int(y)) for t, y in zip(table["text"], table["y"])]


def some(spark, label: str):
    """Short labelled documents of either label, with ids that models see and ids that they don't."""
    docs, labels = (spark.read.parquet(str(DATA / "sf0.01" / f"{t}.parquet")) for t in ("documents", "labels"))
    both = docs.where("length(text) < 1500").join(labels, "doc_id").where(F.col(label).isNotNull())
    few = both.where(F.col(label) == 1).orderBy("doc_id").limit(30).unionByName(both.where(F.col(label) == 0).orderBy("doc_id").limit(60))
    rows = [(r["doc_id"], r["text"], r[label]) for r in few.collect()] + [(-1, None, None), (-2, "", None)]
    return rows, spark.createDataFrame(rows, f"doc_id long, text string, {label} int")


def learnt_from(rows) -> list[tuple[str, int]]:
    return in_order([((t or "").encode(), y) for i, t, y in rows if y is not None and crc32(str(i).encode()) % 5])


def agree(got: dict[int, float], rows, plain) -> None:
    assert len(got) == len(rows) and {y for _, _, y in rows} == {0, 1, None}
    worst = max(abs(got[i] - plain(t or "")) for i, t, _ in rows)
    assert worst < 1e-5, worst
    assert max(got.values()) - min(got.values()) > 0.3


def test_quality_against_plain_updates(spark):
    rows, table = some(spark, "quality")
    model = PlainFtrl(1.0, 1.0, 0.1, 0.0)
    logit = lambda x: sum(model.weight(k) * v for k, v in x.items())
    for _ in range(4):
        for text, y in learnt_from(rows):
            x = plain_features(text)
            g = squash(logit(x)) - y
            for k, w in [(k, model.weight(k)) for k in x]:
                model.update(k, w, g * x[k])
    weights = quality.train(table, table.select("doc_id", "quality"))
    got = {r["doc_id"]: r["score"] for r in quality.score(table, weights).collect()}
    agree(got, rows, lambda t: squash(logit(plain_features(t))))


def test_toxicity_against_plain_noisy_or(spark):
    rows, table = some(spark, "toxic")
    model, bias, squares = PlainFtrl(2.0, 1.0, 1.0, 0.01), -7.0, 1.0

    def said(parts):
        p = [squash(bias + sum(model.weight(k) for k in part)) for part in parts]
        return p, 1 - math.prod(1 - x for x in p)

    for _ in range(6):
        for text, y in learnt_from(rows):
            parts = plain_instances(text)
            p, whole = said(parts)
            g = [-x * (1 - whole) / max(whole, 1e-9) if y else x for x in p]
            sums = defaultdict(float)
            for part, slope in zip(parts, g):
                for k in part:
                    sums[k] += slope
            for k, w in [(k, model.weight(k)) for k in sums]:
                model.update(k, w, max(-3.0, min(3.0, sums[k])))
            step = max(-3.0, min(3.0, sum(g)))
            squares += step * step
            bias -= 0.1 * step / math.sqrt(squares)
    weights = toxicity.train(table, table.select("doc_id", "toxic"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table, weights).collect()}
    agree(got, rows, lambda t: said(plain_instances(t))[1])
