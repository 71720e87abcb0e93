"""Spelling variants: words one edit apart, found through an index of variable-length grams.

The dictionary of grams is pruned by frequency: a gram is as long as it has to be to become rare. A word is decomposed into
the dictionary's longest gram from each of its places to the right, placed by its distance from the word's end, and from each
place to the left, placed by its distance from the word's start. One edit affects, of the first, only grams that begin at or
before it, and of the second only those that end after it. All others are the same in both words, places included. So two
words one edit apart have, for the place of that edit, the same unaffected grams, and so the same rarest one on either side:
their inverted lists are merged on these two, and what meets is verified. However short the words are, no link is lost.

All joins are asked to be merges. Spark takes the lists for no larger than the stored words that they are made of, a few MB
where the rows are many millions, and would gather them in the driver to broadcast them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import pieces, written

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_GAP = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
#: One of so many (document, run) loses a code point; fewest code points and occurrences of a word; a form is so many times as frequent.
MODULUS, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Lengths of grams; a gram is frequent over this many occurrences, or more of them where the dictionary would grow over its bound.
SHORTEST, LONGEST, OFTEN, DICTIONARY = 2, 8, 32, 100_000
#: Entries that a task counts before it hands them on.
HELD = 1 << 20


def word_counts(docs: DataFrame, modulus: int = MODULUS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of all documents, counted within a task first; a null doc_id counts as empty."""

    def batch(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                seed = crc32(doc_id.as_py().encode() + b":")
                for part in pieces(text.as_py().lower(), _GAP):
                    for word, n in Counter(RUN.findall(part)).items():
                        if len(word) < least_length:
                            continue
                        length = len(word) - word.count(b"\xc3")
                        if (h := crc32(word, seed)) % modulus == 0:
                            points = word.decode()
                            word, length = (points[: h % length] + points[h % length + 1 :]).encode(), length - 1
                        if length >= least_length:
                            held[word] += n
                if len(held) > HELD:
                    yield batch(held)
                    held = Counter()
        yield batch(held)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).withColumn("word", F.col("word").cast("string"))


def frequent_grams(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, often: int = OFTEN, most: int = DICTIONARY) -> dict[str, int]:
    """The grams that the dictionary extends, with their occurrences in the words (begin and end marked).

    All grams together occur less than `most` times as often as one of these does, so these are at most `most`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: Counter = Counter()
            for word in b.column("word").to_pylist():
                w = f"^{word}$"
                for k in range(shortest, longest + 1):
                    held.update(w[p : p + k] for p in range(len(w) - k + 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])

    length = F.sum(F.length("word").cast("long") + 2)
    total = words.agg(F.coalesce(length, F.lit(0)).alias("n")).first()["n"] * (longest - shortest + 1)
    grams = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in grams.where(F.col("n") > max(often, -(-total // most))).collect()}


def decompose(word: str, frequent: Mapping[str, int], shortest: int = SHORTEST, longest: int = LONGEST) -> tuple[list[str], list[str]]:
    """The dictionary's longest gram of the marked word from each place to the right, and up to each place to the left."""
    w = f"^{word}$"
    right, left = [], []
    for p in range(len(w) - shortest + 1):
        k = shortest
        while k < longest and p + k < len(w) and w[p : p + k] in frequent:
            k += 1
        right.append(w[p : p + k])
        e, k = p + shortest, shortest
        while k < longest and e - k > 0 and w[e - k : e] in frequent:
            k += 1
        left.append(w[e - k : e])
    return right, left


def unaffected(word: str, frequent: Mapping[str, int], shortest: int = SHORTEST, longest: int = LONGEST) -> set[tuple]:
    """(between, length, right gram, its place, left gram, its place) for each place of an edit: the rarest unaffected grams.

    `between` tells an inserted code point from one that is deleted or replaced; length is that of the word without it.
    """
    right, left = decompose(word, frequent, shortest, longest)
    size = len(word) + 2
    # Grams that the dictionary doesn't extend are rare; longer ones are rarer.
    rank = lambda gram, place: (frequent.get(gram, 0), -len(gram), gram, place)
    ranks = [rank(g, size - p) for p, g in enumerate(right)]
    for p in range(len(ranks) - 2, -1, -1):
        ranks[p] = min(ranks[p], ranks[p + 1])
    ends = [rank(g, p + shortest) for p, g in enumerate(left)]
    for p in range(1, len(ends)):
        ends[p] = min(ends[p], ends[p - 1])
    after = lambda p: ranks[p][2:] if p < len(ranks) else ("", 0)
    before = lambda e: ends[e - shortest][2:] if e >= shortest else ("", 0)
    there = {(False, size - 1, *after(i + 1), *before(i)) for i in range(1, size - 1)}
    return there | {(True, size, *after(i), *before(i)) for i in range(1, size)}


def near_words(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, often: int = OFTEN, most: int = DICTIONARY) -> DataFrame:
    """(word, other) in both directions for the words of a table (word, distinct) that differ by exactly one edit."""
    sent = words.sparkSession.sparkContext.broadcast(frequent_grams(words, shortest, longest, often, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(word, *key) for word in b.column("word").to_pylist() for key in unaffected(word, sent.value, shortest, longest)]
            kinds = (pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["word", "between", "length", "after", "after_at", "before", "before_at"])

    lists = words.select("word").mapInArrow(run, "word string, between boolean, length int, after string, after_at int, before string, before_at int")
    key = F.xxhash64("length", "after", "after_at", "before", "before_at")
    lists = lists.select("word", "between", key.alias("key"))
    a, b = (lists.select("key", F.col("word").alias(w), F.col("between").alias(f"between_{w}")) for w in ("word", "other"))
    meet = a.where("NOT between_word").join(b.hint("merge"), "key").where(F.col("between_other") | (F.col("word") < F.col("other")))
    near = meet.where(F.levenshtein("word", "other", 1) == 1).select("word", "other").distinct()
    return near.unionByName(near.select(F.col("other").alias("word"), F.col("word").alias("other")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a table (word, form) of words that have a form: the last of the words that the forms lead to.

    Each round doubles the steps taken; forms grow in number by RATIO a step, so there are few.
    """
    table = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while not table.where("open").isEmpty():
        on = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        table = written(table.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "roots")
    return table.select("word", "root")


def variants(docs: DataFrame, modulus: int = MODULUS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word.

    Null texts have no words, repeated rows count each, very long texts are read in parts, an empty table gives an empty result.
    A word's form is its near word of largest n (ties: smallest) if that is `ratio` times its own, and its root what the forms
    lead to, itself if none. Columns other than doc_id and text aren't read.
    """
    words = written(word_counts(docs, modulus, least_length).where(F.col("n") >= least_count), "words")
    near = near_words(words)
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    found = near.join(counts.hint("merge"), "other").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits: Column = -F.col("best.n") >= ratio * F.col("n")
    judged = words.join(found.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n"))
    judged = written(judged, "judged")
    return judged.join(roots(judged.where("form IS NOT NULL")).hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
