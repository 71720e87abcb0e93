"""Near duplicates by the Jaccard similarity of word shingles, with segment counts as the bound and every link verified.

The fingerprint of a text is its set of shingles, seen as a vector of bits over all 64-bit hashes. The hash range is cut
into equal segments, and the numbers of bits set in them are the text's embedding: the Manhattan distance of two embeddings
is a lower bound of the number of bits that differ. Sets x and y are similar if at most (|x| + |y|) (1 - s) / (1 + s) bits
differ, s being the similarity, so the bound drops a candidate without a look at its texts, and never a link.

Candidates come from cells. In one order of all shingles, what is rare first, the first |x| - s |x| + 1 of any two similar
sets have a member in common: each of these is a cell. Members of a small cell meet each other. Members of a crowded cell
meet only its pivot, and differ from it in a set of shingles each. Two members that aren't both similar to the pivot, and
yet similar, must have so much of these difference sets in common that the same rule holds for them: their first members,
by the lengths worked out in `_difference_cells`, are the finer cells of the crowd. So a crowd of copies costs as many
rows as it has differences, and no link is lost by chance, whatever the lengths of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import simhash
from ._common import keep_least, row_name, written
from .components import components

SEGMENTS = 64
#: Members of a cell that meet each other; a cell with more has a pivot.
SMALL = 16
#: Shingles found so often within one batch of rows are counted, and so many of the most frequent ones are told to the tasks.
OFTEN = 2
COMMON = 1 << 18
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def shingles(words: list[bytes], shingle: int) -> set[bytes]:
    """The different word shingles; the whole sequence where it has fewer words."""
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """The sorted 64-bit hashes of the different shingles: equal shingles have equal hashes in every text."""
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), shingle)], np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - shingle + 1
    out = np.zeros(n, np.uint64)
    for k in range(shingle):
        out = (out ^ h[k : k + n]) * (_FACTORS[k % 5] + np.uint64(2 * (k // 5)))
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def rarity_order(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hashes that are sorted, in the order that all texts have in common: by the known counts, then by hash."""
    known, n = common
    if not len(known) or not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return hashes[np.argsort(np.where(known[at] == hashes, n[at], 0), kind="stable")]


def common_shingles(docs: DataFrame, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts), sorted by hash, of about the COMMON most frequent shingles: repeated lines, passages and licenses.

    A task counts within its batches and tells what occurs in several texts of one; the order of the cells follows from the
    result, never which links are found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [shingle_hashes(words_of(t), shingle) for t in b.column("text").to_pylist()]
            found, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(found[n >= OFTEN]), pa.array(n[n >= OFTEN].astype(np.int64))], ["hash", "n"])

    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = written(counts, "common")
    # The driver gets what it tells the tasks, not the frequent shingles of all partitions to choose from.
    least, part, room = 0, 0.0, COMMON
    for r in counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(COMMON).collect():
        if r["k"] >= room:
            least, part = r["n"], room / r["k"]
            break
        room -= r["k"]
    # Of those found `least` times, the part of the range of hashes that there is room for.
    told = counts.where((F.col("n") > least) | ((F.col("n") == least) & (F.col("hash") / 2.0**64 + 0.5 < part))).toArrow()
    found, n = (told.column(c).to_numpy() for c in ("hash", "n"))
    order = np.argsort(found)
    return found[order], n[order]


def segment_counts(hashes: np.ndarray) -> np.ndarray:
    """Number of hashes in each of the equal segments of their range."""
    return np.bincount((hashes.view(np.uint64) >> np.uint64(58)).astype(np.int64), minlength=SEGMENTS)


def _embedded(docs: DataFrame, similarity: float, shingle: int, common) -> DataFrame:
    """(name, seq, fp, n, counts, prefix) of every row: seq is the MD5 of the word sequence, fp operator 5's fingerprint, n the number of different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, fps, n, counts, first = [], [], [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                h = shingle_hashes(words, shingle)
                seq.append(hashlib.md5(b" ".join(words)).digest())
                fps.append(simhash.fingerprint(words))
                n.append(len(h))
                counts.append(segment_counts(h))
                # Links hold at least similarity times the larger set in common, so all but so many shingles of either and one more.
                first.append(rarity_order(h, common.value)[: len(h) - int(np.ceil(similarity * len(h) - 1e-6)) + 1])
            arrays = [pa.array(seq, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(counts, pa.list_(pa.int32())), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("name"), *arrays], ["name", "seq", "fp", "n", "counts", "prefix"])

    rows = docs.select(row_name().alias("name"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"name {rows.schema['name'].dataType.simpleString()}, seq binary, fp long, n long, counts array<int>, prefix array<long>")


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sizes and Manhattan distance of segment counts allow the similarity."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("counts").alias(f"{x}c"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    distance = F.aggregate(F.zip_with("ac", "bc", lambda x, y: F.abs(x - y)), F.lit(0), lambda x, y: x + y)
    most = (F.col("an") + F.col("bn")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return j.where((F.least("an", "bn") >= similarity * F.greatest("an", "bn") - 1e-6) & (distance <= most)).select("a", "b")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The links (u, v) among the pairs (a, b), by the shingles of the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sound = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                p, q = shingles(words_of(x), shingle), shingles(words_of(y), shingle)
                sound.append(len(p & q) >= similarity * len(p | q) - 1e-9)
            kept = batch.select(["a", "b"]).filter(pa.array(sound, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, ["u", "v"])

    return _with_texts(pairs, texts).select("a", "b", "ta", "tb").mapInArrow(run, "u long, v long")


def _difference_cells(members: DataFrame, texts: DataFrame, similarity: float, shingle: int, common) -> DataFrame:
    """(pivot, node, linked, d, excess, short, long) of every pair (a node, b pivot).

    d(x) is the number of shingles in which node x differs from the pivot p, its excess e(x) = d(x) - r |x|, and x is linked
    to p where e(x) is at most r |p|. Nodes x and y share c shingles of their difference sets, so they differ in d(x) + d(y) - 2 c,
    and are similar where c is at least (e(x) + e(y)) / 2. Let e(x) >= e(y), x not being linked (else both are, through p):

    The differences of all nodes of a pivot stand in one order: first what the pivot lacks, then what it has. A node that only
    shares a passage with the pivot lacks nearly all the rest of it, as its other neighbours do, so these are the frequent ones
    whatever is known of their counts; what the pivot lacks is the node's own text.

    * of y's differences at least (r |p| + e(y)) / 2 are shared, and at least e(y): all but so many and one more are `short`;
    * of x's at least (e(x) - r |p|) / 2, since no excess is under -r |p|; and, since c is at most d(y), e(x) is at most
      e(y) + 2 r |y|, so that at least e(x) - r |y| are, |y| being |x| / s at most: all but so many and one more are `long`.
    """
    r = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, other in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                x, p = words_of(text), words_of(other)
                own, held = shingle_hashes(x, shingle), shingle_hashes(p, shingle)
                order = np.concatenate([rarity_order(np.setdiff1d(s, t), common.value) for s, t in ((own, held), (held, own))])
                x, p = shingles(x, shingle), shingles(p, shingle)
                d = len(x ^ p)
                excess, linked = d - r * len(x), d <= r * (len(x) + len(p)) + 1e-9
                first = lambda least: order[: max(0, len(order) - max(1, int(np.ceil(least - 1e-6))) + 1)]  # noqa: B023, E731
                short, far = first(max((r * len(p) + excess) / 2, excess)), first(max((excess - r * len(p)) / 2, excess - r * len(x) / similarity)) if not linked else order[:0]
                out.append((linked, d, excess, short, far))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.bool_(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("b"), batch.column("a"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["pivot", "node", "linked", "d", "excess", "short", "long"])

    return _with_texts(members, texts).select("a", "b", "ta", "tb").mapInArrow(run, "pivot long, node long, linked boolean, d long, excess double, short array<long>, long array<long>")


def _crowd_pairs(differences: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of one pivot that share a finer cell and aren't in one class yet."""
    named = differences.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roles = F.array(*[F.struct(F.lit(kind == "long").alias("far"), F.col(kind).alias("part")) for kind in ("short", "long")])
    cells = named.select("pivot", "node", "root", F.explode(roles).alias("r")).select("pivot", "node", "root", "r.far", F.explode("r.part").alias("cell"))
    cells = cells.withColumn("cell", F.xxhash64("pivot", "cell"))
    both = cells.groupBy("cell").agg(F.min("far").alias("f0"), F.max("far").alias("f1"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("f0 < f1 AND r0 < r1").select("cell")
    used = written(cells.select("pivot", "node", "far", "cell").join(both, "cell"), "shared")
    used = used.join(named.select("pivot", "node", "root", "d", "excess"), ["pivot", "node"])
    side = lambda far, x: used.where(F.col("far") == far).select("pivot", "cell", F.col("node").alias(x), F.col("root").alias(f"{x}r"), F.col("d").alias(f"{x}d"), F.col("excess").alias(f"{x}e"))
    shared = (F.col("xe") + F.col("ye")) / 2 - 1e-6  # as much of the difference sets must be shared
    fit = (F.col("xr") != F.col("yr")) & (F.col("xe") >= F.col("ye") - 1e-6) & (shared <= F.least("xd", "yd"))
    pairs = side(True, "x").join(side(False, "y"), ["pivot", "cell"]).where(fit)
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _between_firsts(links: DataFrame, fps: DataFrame) -> DataFrame:
    """The links (u, v) between fingerprints as links between their first nodes."""
    side = lambda x: fps.select(F.col("fp").alias(x), F.col("stands").alias(f"{x}1"))
    return links.join(side("u"), "u").join(side("v"), "v").selectExpr("u1 AS u", "v1 AS v")


def similar_rows(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, fingerprints: bool = False) -> DataFrame:
    """(name, least): classes of rows, named by row_name, linked by a Jaccard similarity of `similarity` or more of their word shingles.

    With `fingerprints`, operator 5's links between fingerprints count beside these: the classes follow both kinds, and what one
    kind has joined is not compared again for the other.
    least is the smallest name of the class, a null doc_id being the smallest. Null and empty texts are one class; texts of
    fewer than `shingle` words are one shingle; repeated rows keep their own output rows; an empty table gives an empty
    result; other columns of `docs` are not read. Rows with the same sequence of words are one node of the search.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))
    # Rows are numbered as they are written, so that a number stays the same from here on.
    rows = written(_embedded(docs, similarity, shingle, common).withColumn("node", F.monotonically_increasing_id()), "embedded")
    copies = written(rows.groupBy("seq").agg(F.min("name").alias("lead"), F.count("*").alias("k")).where("k > 1").select("seq", "lead"), "copies")
    nodes = rows.drop("seq")
    if not copies.isEmpty():
        leads = rows.join(copies, "seq").where("name = lead").dropDuplicates(["seq"]).drop("lead")
        nodes = written(rows.join(copies, "seq", "left_anti").unionByName(leads).drop("seq"), "nodes")

    # A cell at place i of x's prefix is the first that x and y share only if the n - i members from there on suffice, so y has
    # at most `most` members; the smaller of the two must allow one of its own size, for which there are the short prefixes.
    whole = (1 + similarity) / similarity
    cells = nodes.select("node", "n", F.posexplode("prefix").alias("i", "cell"))
    cells = cells.select("cell", "node", "n", F.floor((F.col("n") - F.col("i")) * whole - F.col("n") + 1e-6).cast("long").alias("most"))
    short = F.when(F.col("most") >= F.col("n"), F.col("n"))
    held = written(cells.groupBy("cell").agg(F.count("*").alias("k"), F.min(short).alias("low"), F.max(short).alias("high")).where("k > 1 AND low IS NOT NULL"), "held")
    members = written(cells.join(held, "cell").where((F.col("high") >= similarity * F.col("n") - 1e-6) & (F.col("low") <= F.col("most"))).drop("low", "high"), "members")
    side = lambda x: members.where(F.col("k") <= SMALL).select("cell", F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("most").alias(f"{x}m"))
    larger = (F.col("an") > F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") > F.col("b")))
    fit = larger & (F.col("bn") >= similarity * F.col("an") - 1e-6) & (F.col("an") <= F.col("bm")) & (F.col("bn") <= F.col("am"))
    met = written(_possible(side("a").join(side("b"), "cell").where(fit).select("a", "b").distinct(), nodes, similarity), "met")
    # The pivot of a crowded cell is the member with the largest share of its own cells in common with others.
    share = members.groupBy("node").agg((F.count("*") / F.max("n")).alias("share"))
    crowd = members.where(F.col("k") > SMALL).join(share, "node")
    pivots = crowd.groupBy("cell").agg(F.max_by("node", F.struct("share", "node")).alias("pivot"))
    around = written(crowd.join(pivots, "cell").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "around")

    wanted = met.union(around).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(nodes.select("name", "node").join(wanted, "node"), "wanted")
    texts = docs.select(row_name().alias("name"), F.col("text").cast("binary").alias("text"))
    texts = written(texts.join(wanted, "name").dropDuplicates(["name"]).select("node", "text"), "texts")

    differences = written(_difference_cells(around, texts, similarity, shingle, common), "differences")
    links = _verified(met, texts, similarity, shingle).union(differences.where("linked").select("node", "pivot"))
    if fingerprints:
        # A fingerprint stands for its first node, to which the others that have it are linked.
        fps = written(nodes.groupBy("fp").agg(F.min("node").alias("stands")), "fingerprints")
        members, stars = simhash.starred(fps.select("fp"))
        links = links.union(nodes.join(fps, "fp").where("node <> stands").select("node", "stands")).union(_between_firsts(stars, fps))
    roots = components(links)
    more, apart = written(_possible(_crowd_pairs(differences, roots), nodes, similarity), "more"), None
    if fingerprints:
        labels = fps.join(roots, F.col("stands") == F.col("node"), "left").select("fp", F.coalesce("root", "stands").alias("root"))
        apart = written(_between_firsts(simhash.links_apart(members.join(labels, "fp").select("cell", "fp", "root")), fps), "apart")
    found = [] if more.isEmpty() else [_verified(more, texts, similarity, shingle)]
    found += [] if apart is None or apart.isEmpty() else [apart]
    if found:
        roots = components(reduce(DataFrame.union, [*found, roots.select("node", "root")]))

    placed = written(nodes.select("node", "name").join(roots, "node"), "placed")
    tops = nodes.select(F.col("node").alias("root"), F.col("name").alias("top"))
    least = placed.groupBy("root").agg(F.min("name").alias("least")).join(tops, "root").select("root", F.least("least", "top").alias("least"))
    linked = placed.select("name", "root").unionByName(least.join(tops, "root").select(F.col("top").alias("name"), "root")).join(least, "root").select(F.col("name").alias("lead"), "least").distinct()
    named = rows.select("name", "seq").join(copies, "seq", "left").select("name", F.coalesce("lead", "name").alias("lead"))
    return named.join(linked, "lead", "left").select("name", F.coalesce("least", "lead").alias("least"))


def similar_documents(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, component_id): the classes of similar_rows by the smallest doc_id of each.

    Rows of a repeated doc_id share a class, the least of theirs; a null doc_id is no row of the result.
    """
    rows = similar_rows(docs.where("doc_id IS NOT NULL"), **params)
    return rows.groupBy("name.doc_id").agg(F.min("least.doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, **params) -> DataFrame:
    """The rows of `docs` that are the smallest of their class of similar documents by doc_id, a null one being the smallest, then by text; one of equal rows.

    Only the names that go are joined with the rows. Rows with one doc_id, or none, and texts that aren't similar all stay.
    """
    return keep_least(docs, similar_rows(docs, **params))


def drop_near_copies(docs: DataFrame, **params) -> DataFrame:
    """The rows of `docs` that are the smallest of their class, as in drop_similar; links are operator 5's between fingerprints, and those of similar_rows beside them.

    Classes follow links of both kinds: a row that both join is in one class with what either links to it.
    """
    return keep_least(docs, similar_rows(docs, fingerprints=True, **params))
