"""Benchmark decontamination: prefix-filtered join of documents with item-sized windows.

A window is `size` consecutive words of an item, or the whole of a shorter item. Its shingles, of three words or of all where
it has fewer, are ordered by rarity in the corpus; since containment must be exact, the rarest one alone is a sufficient
prefix. Documents and windows join on it, at a place that leaves room for the whole window before it (positional bound) and
after it (length bound), and then the words themselves are compared.

Nothing of the benchmark goes through the driver but two bitmaps of a fixed size, of the hashes of its shingles and of the
prefixes: they tell the tasks which shingles of a document can join. A large benchmark fills them, which costs rows in the
join and no hit. Of the documents only the words around such places are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ._common import row_name, written

#: Lower-cases A-Z and blanks every byte that isn't part of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F].
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
TOKEN = 3
BITS = 26
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def windows(item: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The item's windows; none for an item without words."""
    return {tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))} if item else set()


def tokens(tokens: list[bytes]) -> list[np.ndarray]:
    """Hashes of the shingles of 1 .. TOKEN words at each place where they fit."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    out, grown = [], np.zeros(len(h), np.uint64)
    for k in range(min(TOKEN, len(h))):
        grown = (grown[: len(h) - k] ^ h[k:]) * _FACTORS[k]
        grown ^= grown >> np.uint64(31)
        out.append(grown.view(np.int64))
    return out


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(window, item, tokens) of every different window of an item: its words and the hashes of its shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = list(windows(words(text), size))
                yield pa.RecordBatch.from_arrays([pa.array([[w.decode(errors="replace") for w in x] for x in found], pa.list_(pa.string())), pa.array([item] * len(found), pa.string()), pa.array([tokens(list(x))[-1] for x in found], pa.list_(pa.int64()))], ["window", "item", "tokens"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "window array<string>, item string, tokens array<long>")


def _bitmap(hashes: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test, without false negatives, of which of an array's hashes are among those of a table (token): 2**BITS bits."""
    bit = F.col("token").bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = np.zeros(1 << BITS - 3, np.uint8)
    for r in parts:
        held = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["k"] - 1) * 4096 :][: len(held)] = held
    sent = hashes.sparkSession.sparkContext.broadcast(bits)

    def test(found: np.ndarray) -> np.ndarray:
        at = found & ((1 << BITS) - 1)
        return np.flatnonzero(sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)

    return test


def rarity(docs: DataFrame, listed: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(token, n): number of occurrences in `docs` of the shingles that `listed` picks, counted in each batch and added up in Spark.

    Null texts have none; repeated rows count each; a shingle that isn't in `docs` has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [h[listed(h)] for text in b.column("text").to_pylist() for h in tokens(words(text))]
            token, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64))], ["token", "n"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, listed: Callable[[np.ndarray], np.ndarray], size: int) -> DataFrame:
    """(name, doc_id, n_words, places) of every row: where a prefix may stand, as (token, at, start, around), `around` being the words from `start` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("around", pa.string())]))
        for b in batches:
            n, places = [], []
            for text in b.column("text").to_pylist():
                found, own = words(text), []
                for h in tokens(found):
                    for i in listed(h).tolist():
                        start = max(0, i - size + 1)
                        own.append((int(h[i]), i, start, b" ".join(found[start : i + size]).decode(errors="replace")))
                n.append(len(found))
                places.append([dict(zip(("token", "at", "start", "around"), x, strict=True)) for x in own])
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, kind)], ["name", "doc_id", "n_words", "places"])

    rows = docs.select(row_name().alias("name"), "doc_id", F.col("text").cast("binary").alias("text"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("name", "doc_id")]
    return rows.mapInArrow(run, f"name {kinds[0]}, doc_id {kinds[1]}, n_words long, places array<struct<token: long, at: long, start: long, around: string>>")


def _search(docs: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows as `_places` gives them, the hits (name, start, window), and the windows (window, item)."""
    held = written(_windows(benchmark, size), "windows")
    every = held.select("window", "tokens").distinct().select("window", F.posexplode("tokens").alias("offset", "token"))
    counts = written(rarity(docs, _bitmap(every.select("token"))), "rarity")
    # A window with a shingle that no document has can't occur, so only counted shingles are prefixes.
    size_of = every.groupBy("window").agg(F.count("*").alias("tokens"))
    prefix = every.join(counts, "token").groupBy("window").agg(F.min(F.struct("n", "token", "offset")).alias("p"), F.count("*").alias("known")).join(size_of, "window").where("known = tokens")
    prefix = written(prefix.select("window", "p.token", "p.offset"), "prefixes")
    rows = written(_places(docs, _bitmap(prefix.select("token")), size), "places")
    at = rows.select("name", F.explode("places").alias("p")).select("name", "p.*").join(prefix, "token")
    begin = F.col("at") - F.col("offset")
    same = F.slice(F.split("around", " "), F.greatest(begin - F.col("start"), F.lit(0)) + 1, F.size("window")) == F.col("window")
    hits = at.where((begin >= 0) & same).select("name", begin.alias("start"), "window").distinct()
    return rows, hits, held.select("window", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row: the spans of words hit, as [start, end), and the sorted ids of items found.

    Null texts and items have no words; an item without words has no window, one without an id hits and isn't listed; a
    repeated item id counts once. Rows that agree in doc_id and text are searched once and have a row of the result each, as
    any others. An empty benchmark hits nothing; other columns aren't read.
    """
    rows, hits, held = _search(docs, benchmark, size)
    hits = written(hits.withColumn("n", F.size("window").cast("long")), "hits")
    spans = hits.groupBy("name").agg(F.array_sort(F.collect_set(F.array("start", F.col("start") + F.col("n")))).alias("spans"))
    items = hits.select("name", "window").distinct().join(held, "window").groupBy("name").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.select("name", "doc_id", "n_words").join(spans.join(items, "name", "left"), "name", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select("doc_id", "n_words", none("spans", "array<array<long>>"), none("items", "array<string>"))


def words_hit(spans: Column) -> Column:
    """Number of words that the spans, sorted by start, cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s[1] - F.greatest(s[0], acc["end"]))).alias("n"), F.greatest(acc["end"], s[1]).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, step)["n"]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of `docs` in which no window of the benchmark occurs, with all their columns.

    Null texts have no words and stay; rows of a repeated doc_id are judged apart, by their texts. Only the names that go
    are joined with the rows.
    """
    gone = written(_search(docs, benchmark, size)[1].select("name").distinct(), "gone")
    named = docs.select(row_name().alias("name"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return named.join(gone, "name", "left_anti").select("row.*")
