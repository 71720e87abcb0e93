"""Divergence, spelling variants and shards: brute force, small blocks, and the odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import divergence, exact_dedup, sharding, spelling, url_filter
from gaugeflow.llm._common import held_out, labelled_sample, pieces

LONG = "lorem ipsum dolor sit amet " * 60_000
EXTRA = "term binary, n long, d long, word string, form string, bucket string, copies long, place long, total long, key string, range int, at int"
ROWS = [
    (1, None, "a", "en"),
    (None, "", None, None),
    (3, " \t\n", "a", None),
    (4, "One two  three", "b", "en"),
    (5, "Onetwo three three", "b", "en"),
    (5, "Onetwo three three", "b", "en"),
    (None, "Onetwo three", "b", "en"),
    (None, "Onetwo three", "b", "en"),
    (6, LONG, None, "de"),
    (7, "Ünï codé onetwo ÀÉÿ× élevé", "c", "de"),
    (8, "élevés élevés élevés élevés élevés élevé", "c", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    return df.selectExpr("*", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in EXTRA.split(", ")])


def test_pieces_cut_no_run():
    text = b"ab cd " * 50 + b"x" * 40 + b" y"
    for size in (1, 7, 30, 1000):
        parts = list(pieces(text, re.compile(rb"[^a-z]"), size))
        assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def plain_divergences(rows, least: int, top: int) -> set:
    docs = [(lang or "", source or "", [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for _, text, source, lang in rows]
    out = set()
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        df = Counter(t for x in own for t in set(x[2]))
        kept = sorted(t for t, k in df.items() if k >= least)
        count = {s: Counter(t for x in own if x[1] == s for t in x[2] if t in set(kept)) for s in {x[1] for x in own}}
        prices = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q, p = prices(sum(count.values(), Counter())), {s: prices(c) for s, c in count.items()}
        for s in count:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in count if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, i.decode(), -v, k) for part, found in (("pair", pair), ("term", term)) for k, (v, i) in enumerate(found, 1)}
    return out


def got_divergences(df) -> set:
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


def test_divergences_of_odd_rows(spark, docs):
    assert got_divergences(divergence.divergences(docs, 2, 50)) == plain_divergences(ROWS, 2, 50)
    assert got_divergences(divergence.divergences(docs, 1, 2)) == plain_divergences(ROWS, 1, 2)
    assert got_divergences(divergence.divergences(docs, 30, 2)) == plain_divergences(ROWS, 30, 2)
    assert divergence.divergences(docs.where("false")).count() == 0


def test_divergences_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"t{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}" for x in rng.zipf(1.3, 60) % 400), f"s{rng.integers(0, 9)}", "xy"[k % 2]) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    expected = plain_divergences(rows, 3, 5)
    monkeypatch.setattr(divergence, "HELD", 50)
    assert got_divergences(divergence.divergences(df, 3, 5)) == expected
    small = divergence.pair_divergence.__defaults__
    monkeypatch.setattr(divergence.pair_divergence, "__defaults__", (16, 2, 7))
    assert got_divergences(divergence.divergences(df.repartition(5), 3, 5)) == expected and small == (divergence.TERMS, divergence.SOURCES, divergence.COLUMNS)


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize(("letters", "length", "limits"), [("ab", 7, (2, 8, 32, 100_000)), ("abc", 9, (2, 3, 4, 100_000)), ("abé", 6, (2, 5, 1, 100_000)), ("ab", 12, (3, 4, 1, 10))])
def test_near_words_against_all_pairs(spark, letters, length, limits):
    """Words of few letters, so that most are near each other, under several dictionaries: no link is lost or made up."""
    rng = np.random.default_rng(length)
    words = sorted({"".join(letters[x] for x in rng.integers(0, len(letters), rng.integers(length - 1, length + 2))) for _ in range(250)})
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(5)
    got = {(r["word"], r["other"]) for r in spelling.near_words(df, *limits).collect()}
    assert got == {(a, b) for a, b in permutations(words, 2) if one_edit(a, b)} and len(got) > 20


def test_dictionary_is_pruned_and_bounded(spark):
    df = spark.createDataFrame([(f"station{chr(97 + a)}{chr(97 + b)}",) for a in range(20) for b in range(20)], "word string")
    grams = spelling.frequent_grams(df, often=32)
    assert grams["^station"[:8]] == 400 and "na" not in grams and all(n > 32 for n in grams.values())
    assert len(spelling.frequent_grams(df, most=50)) <= 50
    right, left = spelling.decompose("stationab", grams)
    assert right[0] == "^station"[:8] and right[-1] == "b$" and left[0] == "^s" and all(len(g) <= spelling.LONGEST for g in right + left)


def plain_words(rows, modulus: int) -> Counter:
    out: Counter = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % modulus == 0 else run] += 1
    return out


@pytest.mark.parametrize("modulus", [199, 3])
def test_variants_of_odd_rows(spark, docs, modulus, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 2)
    words = {w: n for w, n in plain_words(ROWS, modulus).items() if len(w) >= 4 and n >= 1}
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {a: min((-words[b], b) for b in near[a])[1] if near[a] and max(words[b] for b in near[a]) >= 2 * words[a] else None for a in words}

    def root(a: str) -> str:
        return root(form[a]) if form[a] else a

    got = {tuple(r) for r in spelling.variants(docs, modulus, 4, 1, 2).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == {(a, n, len(near[a]), form[a], words.get(form[a]), root(a)) for a, n in words.items()}
    assert any(form.values()) and spelling.variants(docs.where("false")).count() == 0


def test_roots_of_a_long_chain(spark):
    df = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(13)], "word string, form string")
    assert {r["root"] for r in spelling.roots(df).collect()} == {"w13"}


def test_variants_broadcast_no_table(spark, docs, monkeypatch):
    """Lists of grams are twenty times the words that Spark takes them for: broadcast, they fill the driver."""
    plans, write = [], spelling.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(spelling, "written", written)
    out = spelling.variants(docs, 3, 4, 1, 2)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize(("digits", "ranges", "n"), [(3, 4096, 8), (0, 1, 8), (1, 3, 5), (1, 7, 100)])
def test_shards_against_a_plain_order(spark, docs, digits, ranges, n, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 2)
    more = spark.createDataFrame([(k, "same", f"s{k % 3}", "en") for k in range(100, 160)] + [(None, None, "a", "en")] * 9, "doc_id long, text string, source string, lang string")
    df = docs.unionByName(more, allowMissingColumns=True)
    got = sharding.shards(df, n, 42, digits, ranges).collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]
    digest = lambda s: hashlib.md5(s.encode()).hexdigest()
    key = lambda d, t: digest(f"42|{'' if d is None else d}|{digest(t or '')}")
    by: dict = {}
    for d, t, s in rows:
        by.setdefault(s, []).append((key(d, t), d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s))
    order = sorted(((2 * k + 1) / (2 * len(own)), s is None, s or "", x) for s, own in by.items() for k, x in enumerate(sorted(own, key=lambda x: x[0])))
    starts = [-(-s * len(rows) // n) for s in range(n + 1)]
    expected = [(x[1], x[2], x[3], x[4], place * n // len(rows), place - starts[place * n // len(rows)]) for place, (_, _, _, x) in enumerate(order)]
    shown = lambda found: sorted(found, key=str)
    assert shown((r["doc_id"], r["size"], r["text_crc32"], r["source"], r["shard"], r["slot"]) for r in got) == shown(expected)


def test_shards_have_the_mixture(spark, docs):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    counts = sharding.shards(df).groupBy("source", "shard").agg(F.count("*").alias("n")).groupBy("source").agg((F.max("n") - F.min("n")).alias("d"), F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in counts) == 1000 and all(r["d"] <= 1 for r in counts)
    assert sharding.shards(docs.where("false")).count() == 0
    a, b = ({tuple(r) for r in sharding.shards(x).collect()} for x in (df, df.repartition(9)))
    assert a == b and a != {tuple(r) for r in sharding.shards(df, seed=1).collect()}


def plain_templates(urls, least: int, z: float) -> dict:
    """Level by level, one level a step, as the method is told."""
    at = {(h, s): ("", n, g, b) for h, s, n, g, b in urls}
    for k in range(max(len(s) for _, s in at)):
        nodes: dict = {}
        for (h, s), (t, n, g, b) in at.items():
            if len(s) > k:
                kid = nodes.setdefault((h, t), {}).setdefault(s[k], [0, 0, 0])
                for i, x in enumerate((n, g, b)):
                    kid[i] += x
        for (h, s), (t, n, g, b) in list(at.items()):
            if len(s) > k:
                kids = nodes[h, t]
                every = [sum(c[i] for c in kids.values()) for i in range(3)]
                own, mean = kids[s[k]], every[2] / max(1, every[1] + every[2])
                alike = own[1] + own[2] > 0 and 0 < mean < 1 and (own[2] / (own[1] + own[2]) - mean) ** 2 * (own[1] + own[2]) <= z * z * mean * (1 - mean)
                wild = len(kids) >= least and len(kids) * 5 >= every[0] or len(kids) > 1 and alike
                at[h, s] = (t + "/" + ("*" if wild else s[k]), n, g, b)
    return {key: v[0] for key, v in at.items()}


def test_templates_of_a_compressed_tree(spark):
    """Runs without a branch are taken at once: the same templates as level by level, for chains, forks and wide nodes."""
    rng = np.random.default_rng(6)
    urls = {}
    for _ in range(400):
        h = f"h{rng.integers(0, 3)}"
        path = tuple("abcdefghijklmnop"[x] for x in rng.integers(0, (2, 16)[int(rng.integers(0, 2))], rng.integers(0, 7)))
        urls[h, path] = (int(rng.integers(1, 4)), int(rng.integers(0, 3)), int(rng.integers(0, 3)))
    for k in range(30):  # a trap: each page leads one level deeper
        urls["trap", ("x", "y") * k] = (1, k % 2, 0)
    rows = [(h, list(s), *v) for (h, s), v in urls.items()]
    df = spark.createDataFrame(rows, "host string, shape array<string>, n long, good long, bad long").repartition(4)
    got = {(r["host"], tuple(r["shape"])): r["template"] for r in url_filter.templates(df, 5, 2.0).collect()}
    assert got == plain_templates([(h, tuple(s), *v) for h, s, *v in rows], 5, 2.0) and any("*" in t for t in got.values())


def test_a_path_of_thousands_of_segments_takes_no_pass_of_its_own(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(url_filter, "written", lambda df, name, w=url_filter.written: (passes.append(name), w(df, name))[1])
    df = spark.createDataFrame([(1, "http://a.com/x/" + "s/" * 2000 + "end"), (2, "http://a.com/x/y/z"), (3, "http://b.com/q")], "page_id long, url string")
    got = {r["page_id"]: r["template"] for r in url_filter.judge(df, {"com/": "allow"}).collect()}
    assert got == {1: "/x/" + "s/" * 2000 + "end", 2: "/x/y/z", 3: "/q"} and len(passes) <= 5


def test_the_tree_changes_verdicts(spark):
    """Pages without a rule, under a template whose labelled pages are rejected, are rejected; their siblings are not."""
    urls = [f"http://site.org/ads/{k}/offer" for k in range(20)] + [f"http://site.org/news/{k}/story" for k in range(20)]
    rules = {f"site.org/ads/{k}/": "block" for k in range(0, 20, 2)} | {f"site.org/news/{k}/": "allow" for k in range(0, 20, 2)}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()}
    assert all(got[k] == (None, "block") for k in range(1, 20, 2)) and all(got[k] == (None, "allow") for k in range(21, 40, 2))


def test_one_of_repeated_rows_is_kept(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COPIES", 2)
    rows = [(7, "a b")] * 5 + [(8, "ab")] * 3 + [(None, "x")] * 4 + [(1, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for digest in (exact_dedup.content_hash, lambda c: F.substring(c, 1, 0)):
        got = exact_dedup.exact_classes(df, digest).collect()
        assert sorted((str(r["doc_id"]), r["kept"]) for r in got if r["kept"]) == [("1", True), ("7", True), ("None", True)]
        assert len(got) == len(rows) and all(r["group_size"] == {7: 8, 8: 8, None: 4, 1: 2}[r["doc_id"]] for r in got)


def test_a_labelled_id_in_very_many_rows_stays_within_the_bound(spark):
    text = F.concat(F.lit("word "), (F.col("id") % 400).cast("string"), F.lit(" " + "x" * 1000))
    docs = spark.range(4000).select(F.lit(3).cast("long").alias("doc_id"), text.alias("text"))
    labels = spark.createDataFrame([(3, 1)], "doc_id long, y int")
    part = labelled_sample(docs, labels, "y", 1000, 50_000, 1)
    size = part.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"]
    assert 20_000 < size <= 80_000 and part.count() == part.distinct().count()
    assert labelled_sample(docs, labels, "y", 1000, 10, 1).count() == 1
    assert spark.createDataFrame([(None,)], "doc_id long").select(held_out(F.col("doc_id")).alias("h")).first()["h"] is True
