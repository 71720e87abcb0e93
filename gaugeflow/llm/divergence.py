"""Source divergence audit: how the terms of the sources of a language differ.

Each kept term has one count level in each source of its language, so the sources' indicator columns (source, level) over the
terms, multiplied by their transpose, give every joint table: how many terms have level a in one source and level b in the
other. A level has one price, so a pair's divergence is its joint table times the differences of prices. The products are
taken in blocks of terms by blocks of sources; zeros and ones in single precision are exact below 2**24 terms a block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._common import pieces, written

TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-zA-Z\x80-\xff]")
#: Documents of a language that hold a kept term, at least.
LEAST_DOCS = 30
#: Smoothing of the counts, and the unit of the prices.
SMOOTHING, UNIT = 5, 1_000_000_000
TOP = 50
#: Terms and sources of a block of the product, columns of a matrix, entries that a task counts before it hands them on.
TERMS, SOURCES, COLUMNS, HELD = 1024, 32, 2048, 1 << 19


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences, and documents with the term, by source. Each group also has a row of the empty term.

    Counted within a task first, so that a hot source is many rows of few tasks' sums and never one task's texts.
    """
    names = ["lang", "source", "term", "n", "d"]

    def batch(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.binary()), pa.array([source] * len(n), pa.binary()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for lang, source, text in zip(*(b.column(c) for c in ("lang", "source", "text")), strict=True):
                n, d = held.setdefault((lang.as_py(), source.as_py()), (Counter({b"": 0}), Counter()))
                own: set = set()
                for part in pieces(text.as_py().lower(), _GAP):
                    found = TERM.findall(part)
                    n.update(found)
                    own.update(found)
                d.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from batch(held)
                held = {}
        yield from batch(held)

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c)
    found = docs.select(plain("lang"), plain("source"), plain("text")).mapInArrow(run, "lang binary, source binary, term binary, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _price(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 * kept)) in whole numbers; null where nothing is kept."""
    whole = lambda c: c.cast("decimal(19,0)")
    share = whole(n + SMOOTHING) * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", share, whole(F.nullif(total + SMOOTHING * kept, F.lit(0)))) + 1


def _product(lang: bytes, sources: list, at: list[int], own_block: bool, zero: np.ndarray, level: np.ndarray, price: np.ndarray, columns: int) -> pd.DataFrame:
    """Sums of the priced joint tables of pairs of sources, of one block or of two (`at` is a source's); `level` and `price` are terms x sources."""
    n_terms, n = level.shape
    starts, of, prices, code = [0], [], [], np.zeros(level.shape, np.int64)
    for g in range(n):
        levels, first, back = np.unique(level[:, g], return_index=True, return_inverse=True)
        code[:, g] = starts[-1] + back
        prices.append(price[first, g])
        of.append(np.full(len(levels), g))
        starts.append(starts[-1] + len(levels))
    of, prices = np.concatenate([np.zeros(0, np.int64), *of]), np.concatenate([np.zeros(0, np.int64), *prices])
    total = np.zeros((n, n), np.int64)

    def indicators(a: int, b: int) -> np.ndarray:
        x = np.zeros((n_terms, b - a), np.float32)
        rows, cols = np.nonzero((code >= a) & (code < b))
        x[rows, code[rows, cols] - a] = 1
        return x

    for a in range(0, len(of), columns):
        left, own = indicators(a, min(a + columns, len(of))), slice(a, a + columns)
        for b in range(a, len(of), columns):
            other = slice(b, b + columns)
            joint = (left.T @ (left if a == b else indicators(b, min(b + columns, len(of))))).astype(np.int64)
            joint *= np.abs(prices[own, None] - prices[None, other])
            (i, first), (j, second) = (np.unique(of[s], return_index=True) for s in (own, other))
            part = np.add.reduceat(np.add.reduceat(joint, first, 0), second, 1)
            total[np.ix_(i, j)] += part
            if a != b:
                total[np.ix_(j, i)] += part.T
    pairs = [(g, h) for g in range(n) for h in range(n) if g != h and (own_block or at[g] != at[h])]
    g, h = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    named = np.array([*sources, None], object)[:-1]
    return pd.DataFrame({"lang": lang, "source": named[g], "item": named[h], "value": total[g, h], "seen": n_terms, "apart": np.abs(zero[g] - zero[h])})


def pair_divergence(cells: DataFrame, groups: DataFrame, terms: int = TERMS, sources: int = SOURCES, columns: int = COLUMNS) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language.

    `cells` is (lang, source, term, n, price) of the counts over zero, `groups` (lang, source, zero, kept, of_lang): the price of
    a count of zero, the kept terms and the sources of the language. A block of terms meets each pair of blocks of sources;
    terms that neither of two sources has differ by the prices of zero.
    """
    n_terms, n_sources = F.ceil(F.greatest("kept", F.lit(1)) / terms).cast("int"), F.ceil(F.col("of_lang") / sources).cast("int")
    block = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    marks = groups.select("lang", "source", F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("n"), F.col("zero").alias("price"), F.explode(F.sequence(F.lit(0), n_terms - 1)).alias("part"), n_sources.alias("sets"))
    sizes = groups.select("lang", "source", n_terms.alias("parts"), n_sources.alias("sets"))
    rows = cells.join(sizes, ["lang", "source"]).select("lang", "source", "term", "n", "price", block("term", F.col("parts")).alias("part"), "sets")
    rows = marks.unionByName(rows).withColumn("at", block("source", F.col("sets")))
    other = F.explode(F.sequence(F.lit(0), F.col("sets") - 1)).alias("other")
    rows = rows.select("*", other).select("lang", "part", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "source", "at", "term", "n", "price")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mark = rows["term"].isna()
        own = rows[mark].sort_values("source")
        place = pd.Series(range(len(own)), index=own["source"])
        rest = rows[~mark]
        t, found = pd.factorize(rest["term"])
        zero = own["price"].to_numpy(np.int64)
        level, price = np.zeros((len(found), len(own)), np.int64), np.tile(zero, (len(found), 1))
        g = place.loc[rest["source"]].to_numpy()
        level[t, g], price[t, g] = rest["n"], rest["price"]
        return _product(key[0], own["source"].tolist(), own["at"].tolist(), key[2] == key[3], zero, level, price, columns)

    parts = rows.groupBy("lang", "part", "i", "j").applyInPandas(run, "lang binary, source binary, item binary, value long, seen long, apart long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("apart").alias("apart"))
    return sums.join(groups.select("lang", "source", "kept"), ["lang", "source"]).select("lang", "source", "item", (F.col("value") + (F.col("kept") - F.col("seen")) * F.col("apart")).alias("value"))


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of the language by divergence, and each source's own terms.

    Null text, lang and source count as empty ones; repeated rows count each; very long texts are read in parts. A source whose
    documents have no kept term still has its pairs, at 0 where the language keeps nothing; a language with one source has no
    pairs; an empty table gives an empty result. Ties go to the smaller item. Columns other than lang, source and text aren't read.
    """
    counts = written(term_counts(docs), "counts")
    kept = counts.where(F.octet_length("term") > 0).groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("d").alias("d")).where(F.col("d") >= least_docs).drop("d")
    kept = written(kept, "kept")
    found = written(counts.join(kept, ["lang", "term"]), "found")
    # Tables with a row for each language or source.
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("lang_total"))
    every = counts.where(F.octet_length("term") == 0).select("lang", "source")
    groups = every.join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(every.groupBy("lang").agg(F.count("*").alias("of_lang")), "lang").join(langs, "lang", "left")
    groups = written(groups.fillna(0, ["total", "kept", "lang_total"]), "groups")
    zero = F.coalesce(_price(F.lit(0).cast("long"), F.col("total"), F.col("kept")), F.lit(0).cast("long"))
    groups = groups.withColumn("zero", zero)
    price, of_lang = _price(F.col("n"), F.col("total"), F.col("kept")), _price(F.col("whole"), F.col("lang_total"), F.col("kept"))
    cells = found.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", price.alias("price"), of_lang.alias("of_lang"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_divergence(cells.drop("of_lang"), groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = cells.where("n > 0 AND price > of_lang").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("price") - F.col("of_lang")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    text = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    return pairs.unionByName(terms).select(*text, "part", F.col("item").cast("string").alias("item"), "value", "rank")
