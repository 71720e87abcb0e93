"""SimHash near-duplicate detection.

Fingerprints are embedded into vectors of per-segment bit counts: the 63 overlapping segments of two neighbouring bits, so
coordinates of 0..2. A bit that differs changes two counts by one at most, so half the Manhattan distance of two vectors is
a lower bound of the Hamming distance of the fingerprints, and a grid range-join over the vectors finds every link: the 64
bits are cut into `d + 3` runs, and fingerprints within distance `d` agree on the segments of at least three whole runs.
Each choice of three runs is one family of grid cells. Candidates that share a cell pass the Manhattan bound and are then
verified on the fingerprints themselves.

Cells of a dense group are never expanded into all pairs. Each member is first linked to a few representatives of its cell.
Where components still differ, those outside the largest component of a cell are compared with all its members. Only where
they are more than `MEET` are links found by the points between: fingerprints within distance `d` are both within half of it
of some point, so each fingerprint is dealt to all points that near, and all that meet at a point are linked. That is a fixed
but large number of rows a fingerprint (2081 at distance 4), and a member that meets `MEET` others costs less than they do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ._common import keep_least, row_name, written
from .components import components

_SEGMENTS = (1 << 63) - 1
#: So many members outside the largest component of a cell are compared with all its members: half the points of a fingerprint.
MEET = 1024


def simhash(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit fingerprint of a UTF-8 text: majority of the bits of its word shingles' XXH64, 0 for a text without words."""
    return fingerprint(text.lower().split(), shingle, seed)


def fingerprint(words: list[bytes], shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a sequence of lower-cased words."""
    n = len(words) - shingle + 1
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if n <= 1:
        return digest(join(words), seed)
    hashes = np.fromiter((digest(join(words[i : i + shingle]), seed) for i in range(n)), "<u8", n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        counts += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """(key, fp) for every row; a null text counts as empty, and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t, shingle, seed) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(fps.view(np.int64))], [key, "fp"])

    rows = docs.select(key, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, fp long")


def segment_counts(fp: Column) -> tuple[Column, Column]:
    """The 63 counts in unary code, bit i of the two words being `count >= 1` and `count >= 2` of the segment at bit i."""
    shifted = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(shifted).bitwiseAND(F.lit(_SEGMENTS)), fp.bitwiseAND(shifted)


def _cells(nodes: DataFrame, distance: int) -> DataFrame:
    """(fp, cell): a row for each family of grid cells, that is for each choice of three of the `distance + 3` runs."""
    runs = distance + 3
    cuts = [round(k * 64 / runs) for k in range(runs + 1)]
    masks = [((1 << cuts[k + 1] - 1) - 1) ^ ((1 << cuts[k]) - 1) for k in range(runs)]
    families = [F.lit(masks[a] | masks[b] | masks[c]) for a, b, c in combinations(range(runs), 3)]
    some, both = segment_counts(F.col("fp"))
    return nodes.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(k), some.bitwiseAND(m), both.bitwiseAND(m)) for k, m in enumerate(families)])).alias("cell"))


def _near(a: Column, b: Column, distance: int) -> Column:
    bound = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(segment_counts(a), segment_counts(b), strict=True)), F.lit(0))
    return (bound <= 2 * distance) & (F.bit_count(a.bitwiseXOR(b)) <= distance)


def _between(crowd: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) of a table (fp, root) between different roots: all fingerprints within half the distance of one point."""
    near = [sum(1 << b for b in bits) for k in range(distance // 2 + 1) for bits in combinations(range(64), k)]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in near])
    odd = [1 << b for b in range(64)] if distance % 2 else []  # of an odd distance one end is a bit further
    points = crowd.select("fp", "root", F.explode(masks).alias("mask")).select("fp", "root", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    if odd:
        step = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in [0, *odd]])
        points = points.select("fp", "root", "point", F.explode(step).alias("step")).select("fp", "root", F.col("point").bitwiseXOR(F.col("step")).alias("point"))
    mixed = written(points.groupBy("point").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("point"), "points")
    meet = written(points.select("point", "fp").join(mixed, "point", "left_semi"), "meet")
    first = meet.groupBy("point").agg(F.min("fp").alias("v"))
    return meet.join(first, "point").where((F.col("fp") != F.col("v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= distance)).selectExpr("fp AS u", "v").distinct()


def starred(nodes: DataFrame, distance: int = 4) -> tuple[DataFrame, DataFrame]:
    """(cell, fp, k) of the cells that several fingerprints of `nodes` share, and the links (u, v) of each to a few of its cell."""
    cells = _cells(nodes, distance)
    held = written(cells.groupBy("cell").agg(F.count("*").alias("k")).where("k > 1"), "held")
    members = written(cells.join(held, "cell"), "members")
    # Each member of a cell against a few representatives of the cell: linear in the size of the cell.
    heads = members.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.min_by("fp", F.xxhash64("fp")).alias("c"))
    stars = members.join(heads.select("cell", F.array_distinct(F.array("a", "b", "c")).alias("heads")), "cell").select("fp", F.explode("heads").alias("head"))
    return members, stars.where((F.col("fp") != F.col("head")) & _near(F.col("fp"), F.col("head"), distance)).selectExpr("fp AS u", "head AS v")


def links_apart(marked: DataFrame, distance: int = 4) -> DataFrame:
    """Links (u, v) that join what is apart, by a table (cell, fp, root) of the members of cells and the class that each is in so far."""
    # Members of one cell that are in different components, so that one of two isn't in the cell's largest.
    sizes = marked.groupBy("cell", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("cell").agg(F.count("*").alias("kinds"), (F.sum("n") - F.max("n")).alias("apart"), F.max_by("root", F.struct("n", "root")).alias("main"))
    mixed = written(marked.join(mixed.where("kinds > 1").drop("kinds"), "cell"), "mixed")
    few, crowd = mixed.where(F.col("apart") <= MEET), written(mixed.where(F.col("apart") > MEET).select("fp", "root").distinct(), "crowd")
    side = lambda rows, n: rows.select("cell", F.col("fp").alias(f"f{n}"), F.col("root").alias(f"r{n}"))
    other = (F.col("r1") != F.col("r2")) & _near(F.col("f1"), F.col("f2"), distance)
    more = side(few.where("root <> main"), 1).join(side(few, 2), "cell").where(other).selectExpr("f1 AS u", "f2 AS v")
    return more.union(_between(crowd, distance))


def classes(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, root) of every row of `nodes`, a table of different fingerprints: the smallest fingerprint linked to it."""
    members, links = starred(nodes, distance)
    known = written(components(links), "known")
    marked = members.join(known, members.fp == known.node, "left").select("cell", "fp", F.coalesce("root", "fp").alias("root"))
    merged = components(links_apart(marked, distance).union(known.select("node", "root")))
    return nodes.join(merged, nodes.fp == merged.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): classes of documents whose fingerprints are linked at `distance` or fewer differing bits.

    component_id is the smallest doc_id reachable, nulls apart. Null and empty texts share fingerprint 0 and are linked like
    any other; repeated rows keep their own output rows; an empty table gives an empty result; other columns aren't read.
    """
    fps = written(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = written(classes(nodes.select("fp"), distance), "roots")
    ids = roots.join(nodes, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = written(roots.join(ids, "root").select("fp", "component_id"), "classes")
    return fps.join(found, "fp").select("doc_id", "fp", "component_id")


def linked_rows(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(name, least) of every row: classes of rows, named by row_name, whose fingerprints are linked; least is the smallest name of the class."""
    fps = written(fingerprints(docs.withColumn("name", row_name()), shingle, seed, key="name"), "fingerprints")
    roots = fps.join(classes(fps.select("fp").distinct(), distance), "fp").select("name", "root")
    least = roots.groupBy("root").agg(F.min("name").alias("least"))
    return roots.join(least, "root").select("name", "least")


def drop_near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """The rows of `docs` that are the smallest of their class by doc_id, a null one being the smallest, then by text; one of equal rows.

    Rows with one doc_id, or none, whose texts aren't linked all stay.
    """
    return keep_least(docs, linked_rows(docs, distance, shingle, seed))
