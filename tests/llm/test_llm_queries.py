"""Queries of the subpackage: DuckDB's rows where SQL can express them, brute force or held-out labels elsewhere."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import DATA
from oracle import both, connect

from gaugeflow.llm import queries as q
from gaugeflow.llm import simhash as sh
from gaugeflow.llm import similar as sm

SMALL = DATA / "sf0.001"
CON = connect(SMALL)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    a, b = both(spark, CON, q.queries()[name], q.oracle_sql()[name], SMALL)
    assert a == b


def plain_fingerprint(text: str, k: int = 4) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(ids: list[int], fps: list[int], distance: int) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fp = np.array(fps, np.uint64)
    for k, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(fp[k] ^ fp[k + 1 :]) <= distance):
            a, b = find(i), find(ids[k + 1 + int(m)])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_all_pairs(spark):
    folder = DATA / "sf0.01"
    rows = q.queries()["op5_simhash"](spark, str(folder)).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(texts) == sorted(r["doc_id"] for r in rows)
    assert all(int(r["fingerprint"], 16) == plain_fingerprint(texts[r["doc_id"]]) for r in rows[:200])
    expected = plain_components([r["doc_id"] for r in rows], [int(r["fingerprint"], 16) for r in rows], 4)
    assert expected == {r["doc_id"]: r["component_id"] for r in rows}


def test_links_of_a_dense_group(spark, monkeypatch):
    """Fingerprints around two centres, up to three bits away, and chains of four bits a step."""
    rng = np.random.default_rng(5)
    fps = []
    for centre in rng.integers(0, 1 << 62, 2):
        for _ in range(150):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            fps.append(int(centre) ^ sum(1 << int(b) for b in flips))
    chain = 12345
    for step in range(12):
        fps.append(chain)
        chain ^= 0xF << 4 * step
    table = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(fps)], "doc_id long, fp long")
    monkeypatch.setattr(sh, "fingerprints", lambda docs, *a: docs)
    got = {r["doc_id"]: r["component_id"] for r in sh.near_duplicates(table).collect()}
    assert got == plain_components(list(range(len(fps))), fps, 4)


@pytest.mark.parametrize("meet", [4, 1024])
def test_cells_of_many_components(spark, monkeypatch, meet):
    """Crowded cells whose members are far apart, some of them linked: only cells with more than `MEET` outside the largest component are dealt to points."""
    rng = np.random.default_rng(6)
    fps = []
    for _ in range(120):
        fps.append((0x5A5A5A5 << 36) ^ int(rng.integers(0, 1 << 36)))
        fps += [fps[-1] ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False))] * (len(fps) % 3 == 0)
    table = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(fps)], "doc_id long, fp long")
    dealt, real = [], sh._between
    monkeypatch.setattr(sh, "_between", lambda crowd, d: dealt.append(crowd.count()) or real(crowd, d))
    monkeypatch.setattr(sh, "MEET", meet, raising=False)
    monkeypatch.setattr(sh, "fingerprints", lambda docs, *a: docs)
    got = {r["doc_id"]: r["component_id"] for r in sh.near_duplicates(table).collect()}
    assert got == plain_components(list(range(len(fps))), fps, 4)
    assert dealt[0] == 0 if meet == 1024 else dealt[0] > 100


def shingle_sets(rows) -> dict[int, frozenset]:
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in rows}
    return {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in words.items()}


def plain_classes(sets: dict[int, frozenset], similarity: float = 0.8) -> dict[int, int]:
    """Smallest id reachable over links of all pairs whose shingle sets are that similar."""
    root, ids = {i: i for i in sets}, sorted(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            p, q = sets[i], sets[j]
            if 0.8 * max(len(p), len(q)) <= min(len(p), len(q)) and len(p & q) >= similarity * len(p | q):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_similar_documents_against_all_pairs(spark):
    """Classes at a shingle similarity of 0.8: recall of links, and nothing joined that all pairs keep apart."""
    docs = spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet")).select("doc_id", "text")
    base = [r for r in docs.collect() if len(r["text"].split()) > 150][:150]
    changed = []
    for n, r in enumerate(base):
        words = r["text"].split()
        for k in range(5, len(words), max(60, len(words) // 3)):
            words[k] = f"changed{n}"
        changed.append((10_000 + r["doc_id"], " ".join(words)))
    table = docs.unionByName(spark.createDataFrame(changed, "doc_id long, text string")).withColumn("node", F.lit("clash"))
    sets = shingle_sets(table.collect())
    got = {r["doc_id"]: r["component_id"] for r in sm.similar_documents(table).collect()}
    assert set(got) == set(sets)
    alike = [(i - 10_000, i) for i in sets if i >= 10_000 and len(sets[i] & sets[i - 10_000]) >= 0.8 * len(sets[i] | sets[i - 10_000])]
    assert len(alike) > 100 and sum(got[a] == got[b] for a, b in alike) >= 0.97 * len(alike)
    exact = plain_classes(sets)
    assert all(exact[i] == exact[c] for i, c in got.items())
    assert sum(got[i] != c for i, c in exact.items()) <= 0.01 * len(got)


def test_similar_documents_finds_every_short_copy(spark):
    """Texts of 6 to 30 words and the same with one word more, 20 of each length: the links of all pairs, none lost by chance."""
    rng = np.random.default_rng(8)
    texts = [[f"w{x}" for x in rng.integers(0, 50_000, n)] for n in range(6, 31) for _ in range(20)]
    rows = [(2 * k + more, " ".join(t + ["more"] * more)) for k, t in enumerate(texts) for more in (0, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in sm.similar_documents(table).collect()}
    exact = plain_classes(shingle_sets(table.collect()))
    assert sum(i != c for i, c in exact.items()) == 20 * 23 and got == exact


def test_a_passage_that_no_batch_counts_makes_no_pairs(spark, monkeypatch):
    """Documents that share 70 of 100 words and aren't similar: without any known counts the crowd has no more than linear pairs."""
    made, real = [], sm._crowd_pairs

    def crowd(*parts):
        pairs = real(*parts)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(sm, "_crowd_pairs", crowd)
    monkeypatch.setattr(sm, "COMMON", 1)
    for n in (60, 240):
        text = lambda i: " ".join([f"a{i}x{k}" for k in range(15)] + [f"p{k}" for k in range(70)] + [f"b{i}x{k}" for k in range(15)])
        docs = [(i, text(i)) for i in range(n)] + [(n + i, text(i) + " more") for i in range(5)]
        got = {r["doc_id"]: r["component_id"] for r in sm.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == {i: i if i < n else i - n for i in range(n + 5)}
        assert made.pop() <= n


def test_similar_documents_around_a_shared_passage(spark):
    """A passage in every document, a large group of near copies and short chains: the crowded cells lose and add nothing."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    passage, first, texts = word(120), word(200), []
    texts += [" ".join(passage + word(60)) for _ in range(150)]  # half of the shingles in common
    for _ in range(150):
        copy = list(first)
        copy[int(rng.integers(0, 200))] = "x"
        texts.append(" ".join(copy))
    chain = word(200)
    for step in range(10):
        chain[step * 20] = f"step{step}"
        texts.append(" ".join(chain))
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    sets = shingle_sets(table.collect())
    got = {r["doc_id"]: r["component_id"] for r in sm.similar_documents(table).collect()}
    assert got == plain_classes(sets)
    kept = {r["doc_id"] for r in sm.drop_similar(table).collect()}
    assert kept == set(got.values())


def test_pipeline_near_copies_follow_both_links(spark):
    """A repeated passage with 30 other words has a near fingerprint at a low similarity; a text with 12 words more has a far one at a high similarity."""
    import corpus_pipeline as cp

    word = lambda k, n: " ".join(f"{k}w{x}" for x in range(n))
    chant = " ".join([word("p", 11)] * 100)
    texts = {5: f"{chant} {word('a', 30)}", 1: f"{chant} {word('b', 30)}", 7: word("c", 60), 4: word("c", 60) + " " + word("d", 12), 9: word("e", 60)}
    texts[3], texts[None] = texts[5] + " more", word("f", 60)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    fps = {r["doc_id"]: r["fp"] % (1 << 64) for r in sh.fingerprints(table).collect()}
    sets = plain_classes(shingle_sets(table.where("doc_id IS NOT NULL").collect()))
    assert (fps[5] ^ fps[1]).bit_count() <= 4 < (fps[7] ^ fps[4]).bit_count() and sets[5] != sets[1] and sets[3] == sets[5]
    kept = [r["doc_id"] for r in cp.drop_near_copies(spark, table, "").collect()]
    assert set(kept) == {1, 4, 9, None} and len(kept) == 4


def test_pipeline_near_copies_need_few_jobs(spark, monkeypatch):
    """The driver's memory goes with the jobs: links of both kinds are followed at once, and frequent shingles are chosen before they reach the driver."""
    import corpus_pipeline as cp

    made, real = [], sm.components

    def counted(edges, *more):
        made.append("components")
        return real(edges, *more)

    for module in (sm, sh):
        monkeypatch.setattr(module, "components", counted)
    monkeypatch.setattr(sm, "COMMON", 100)
    word = lambda k, n: " ".join(f"{k}w{x}" for x in range(n))
    chant = " ".join([word("p", 11)] * 100)
    # 5 and 1 have near fingerprints, 3 is similar to 5; 7 and 4 are similar only.
    texts = {5: f"{chant} {word('a', 30)}", 1: f"{chant} {word('b', 30)}", 3: f"{chant} {word('a', 30)} more", 7: word("c", 60), 4: word("c", 60) + " " + word("d", 12), 9: None, 10: "", 11: word("e", 60)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in cp.drop_near_copies(spark, table, "").collect()} == {1, 4, 9, 11}
    assert len(made) <= 2
    hashes, n = sm.common_shingles(table.union(table).coalesce(1))
    assert len(hashes) == len(n) <= 150 and (np.diff(hashes) > 0).all() and n.min() >= sm.OFTEN


@pytest.mark.parametrize(("name", "label"), [("op1_quality", "quality"), ("op8_toxicity", "toxic")])
def test_held_out_labels(spark, name, label):
    folder = str(DATA / "sf0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = q.queries()[name](spark, folder).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == r["y"] for r in rows) / len(rows)
    positive = [r for r in rows if r["y"] == 1]
    recall = sum(r["predicted"] for r in positive) / len(positive)
    assert hit > 0.95 and recall > (0.99 if label == "quality" else 0.6), (hit, recall)


def test_pipeline_keeps_its_promises(spark):
    import corpus_pipeline as cp

    from gaugeflow.llm import decontaminate as dc, exact_dedup as ed

    folder = str(DATA / "sf0.01")
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    taken = cp.run(spark, folder)
    kept = docs.join(taken.select("doc_id"), "doc_id", "left_semi")
    n = taken.count()
    assert 0 < n == kept.count()
    assert ed.exact_classes(kept).where("group_size > 1").count() == 0
    assert all(i == c for i, c in plain_classes(shingle_sets(kept.collect())).items())
    assert dc.contamination(kept, bench).where(F.size("spans") > 0).count() == 0
    assert taken.where("taken > 3 * size").count() == 0
    mixed = taken.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r["t"] - r["target"]) < 1 for r in mixed)
