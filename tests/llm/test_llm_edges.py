"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import _common, decontaminate, exact_dedup, mixing, preference, quality, secrets, simhash, similar, toxicity, url_filter, warc

LONG = "lorem ipsum dolor sit amet " * 8000
EXTRA = "fp long, hash string, norm string, size long, key string, bucket string, cell long, template string, spans string, k int"
ROWS = [
    (1, None, "a"),
    (2, "", None),
    (3, " \t\n", "a"),
    (4, "One two  three", "b"),
    (5, "One twothree", "b"),
    (5, "One twothree", "b"),
    (6, LONG, None),
    (7, LONG + " x", "c"),
    (8, 'token = "abcdefghijkl1234" AKIAABCDEFGHIJKLMN 0123456789abcdef', "c"),
    (9, "ünï codé ✓ token: Zx9Qw3Er7Ty1Ui5Op2As8Df4", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.selectExpr("*", "'en' AS lang", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in EXTRA.split(", ")])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 10)] + [(99, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_exact_dedup(docs):
    got = rows(exact_dedup.exact_classes(docs), "doc_id", "keep_id", "group_size", "kept")
    empty = [(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True)]
    assert got == sorted([*empty, (4, 4, 3, True), (5, 4, 3, False), (5, 4, 3, False), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True)], key=str)
    assert {r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()} == {3, 4, 6, 7, 8, 9}
    sha = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_classes(docs).collect()}
    assert sha[1] == hashlib.sha256(b"").hexdigest() and sha[4] == hashlib.sha256(b"Onetwothree").hexdigest()


def test_exact_dedup_tells_colliding_hashes_apart(docs):
    same = exact_dedup.exact_classes(docs, digest=lambda c: F.substring(F.md5(c.cast("binary")), 1, 0))
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(same, *names) == rows(exact_dedup.exact_classes(docs), *names)


def test_simhash(docs):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (6, 6)} <= got
    assert simhash.near_duplicates(docs).count() == len(ROWS)
    wide = {(r["doc_id"], r["component_id"]) for r in similar.similar_documents(docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (4, 4), (5, 5)} <= wide
    nameless = docs.unionByName(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    assert similar.drop_similar(nameless).where("doc_id IS NULL").count() == 1
    for drop in (simhash.drop_near_duplicates, similar.drop_similar):
        kept = [r["doc_id"] for r in drop(docs).collect()]
        assert len(kept) == len(set(kept)) and 1 in kept and 2 not in kept


def test_mixing(docs):
    m = mixing.mix(docs)
    got = m.collect()
    assert len(got) == len(ROWS)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in got) == sorted(words(t) for _, t, _ in ROWS)
    for s in ("a", "b", "c", None):
        part = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in part) == int(part[0]["target"]) and all(r["taken"] <= 3 * r["size"] for r in part)
    total = sum(r["size"] for r in got)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - total) < 1e-6
    assert rows(m, "doc_id", "taken") == rows(mixing.mix(docs.repartition(7)), "doc_id", "taken")


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1, 1000], [0, 5, 5], [0, 0], [1, 1, 1, 500, 2, 3]])
def test_targets_against_resharing(spark, sizes):
    """The level found by prefix sums is what resharing round by round ends at."""
    df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    weights, full, open_, left = [(5, 2, 1)[k % 3] for k in range(len(sizes))], {}, set(range(len(sizes))), float(sum(sizes))
    while open_:
        level = left / sum(weights[k] for k in open_)
        over = {k for k in open_ if level * weights[k] >= 3 * sizes[k]}
        if not over:
            full |= {k: level * weights[k] for k in open_}
            break
        full |= {k: 3.0 * sizes[k] for k in over}
        left -= sum(3.0 * sizes[k] for k in over)
        open_ -= over
    assert all(abs(got[f"s{k}"] - v) < 1e-9 for k, v in full.items())


def test_secrets(docs):
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    assert got[1] == got[2] == got[6] == []
    text = ROWS[8][1]
    expected = [("assign", *re.search(r'token = "[a-z0-9]+', text).span()), ("access", *re.search("AKIA[A-Z0-9]+", text).span()), ("hex", *re.search("0123456789abcdef", text).span())]
    assert got[8] == expected
    assert got[9] == [("assign", ROWS[9][1].index("token"), len(ROWS[9][1]))]


def test_entropy_spans(spark):
    secret, path = "Zx9Qw3Er7Ty1Ui5Op2As8Df4Gh6", "some/long/path/to/a/file/of/mine/1"
    df = spark.createDataFrame([(1, f"see {secret}."), (2, f"see {path}"), (3, "z" * 30 + "1"), (4, "9" * 40), (5, "0f" * 15)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(df).collect()}
    assert got[1] == [("entropy", 4, 4 + len(secret))] and got[2] == [] and got[3] == [] and [k for k, *_ in got[5]] == ["hex"]


def test_decontamination(spark, docs):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "Short item"), (3, None), (4, "... !"), (5, LONG)], "item_id long, text string")
    text = spark.createDataFrame([(1, "zero " + item.upper() + " end"), (2, item[:-14]), (3, "a short, ITEM short item"), (4, None), (5, "one two three"), (6, LONG)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["spans"], r["items"]) for r in decontaminate.contamination(text, bench).collect()}
    assert got[1] == (14, [[1, 11], [2, 12], [3, 13]], ["1"]) and got[2][1:] == ([[0, 10]], ["1"])
    assert got[3] == (5, [[1, 3], [3, 5]], ["2"]) and got[4] == (0, [], []) and got[5][1:] == ([], []) and got[6][2] == ["5"]
    hit = decontaminate.contamination(text, bench).select("doc_id", decontaminate.words_hit(F.col("spans")).alias("n"))
    assert rows(hit, "doc_id", "n") == [(1, 12), (2, 10), (3, 4), (4, 0), (5, 0), (6, 40000)]
    assert decontaminate.contamination(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0
    wide = text.withColumn("item_id", F.lit("clash")).withColumn("tags", F.array(F.lit("a")))
    kept = decontaminate.drop_contaminated(wide, bench)
    assert kept.columns == wide.columns and rows(kept, "doc_id", "text") == [(4, None), (5, "one two three")]
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(ROWS)


def test_classifiers(docs, labels):
    for model, label in ((quality, "quality"), (toxicity, "toxic")):
        w = model.train(docs, labels, label)
        got = model.score(docs, w).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
        none = model.train(docs, labels.limit(0), label)
        assert not none.any() and model.score(docs, none).count() == len(ROWS)


def test_toxicity_locates_the_sentence(spark):
    clean = ["the cat sat. a dog ran off!", "rain fell on us.\nwe went in.", "birds sing. fish swim."]
    texts = [(k, clean[k % 3] + (" you idiot." if k % 2 else ""), k % 2) for k in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    w = toxicity.train(df, df.select("doc_id", "toxic"))
    found = toxicity.locate(df, w).collect()
    assert {r["doc_id"] for r in found} == {k for k, _, t in texts if t}
    assert all(r["sentence"].strip() == "you idiot." and texts[r["doc_id"]][1][r["start"] : r["end"]] == r["sentence"] for r in found)
    more = df.unionByName(spark.createDataFrame([(500, None, 0), (0, "you idiot.", 1)], df.schema)).withColumn("score", F.lit("clash"))
    kept = toxicity.drop_toxic(more, w)
    assert kept.columns == more.columns and {r["doc_id"] for r in kept.collect()} == {k for k, _, t in texts if not t} | {500}
    assert kept.count() == 101 and toxicity.drop_toxic(df.limit(0), w).count() == 0
    untaught = toxicity.train(df, df.select("doc_id", "toxic").limit(0))
    assert toxicity.drop_toxic(df, untaught).count() == 200


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM", "https://a.example.com/en/1?x", "https://www.example.com/en/2#y", "https://com/", "ftp://net/es/", "x://y://net/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    from gaugeflow.llm.queries import URL_RULES

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, URL_RULES).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.com", "", None, "allow")
    assert got[5] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[6] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[7] == ("com", "/", "com/", "allow") and got[8] == ("net", "/es/", "net/es/", "block") and got[9] == ("y:", "//net/es/", None, "allow")


def test_url_templates_generalise_and_reject(spark):
    rules = {"bad.org/ads/7": "block", "bad.org/news/": "allow"}
    urls = [f"http://bad.org/ads/{n}" for n in range(70, 100)] + [f"http://bad.org/ads/{n}" for n in range(700, 730)] + [f"http://bad.org/news/w{chr(97 + n)}x" for n in range(20)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = url_filter.judge(df, rules).collect()
    assert {r["template"] for r in got if r["path"].startswith("/ads")} == {"/ads/{n}"} and all(r["verdict"] == "block" for r in got if r["path"].startswith("/ads"))
    assert {r["template"] for r in got if r["path"].startswith("/news")} == {"/news/*"}


def test_preference(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 1, "assistant", "bad"),
        (2, "chosen", 0, "user", None), (3, "rejected", 5, None, "x"), (4, "chosen", 0, "user", "q"), (4, "rejected", 0, "user", "q"),
    ]
    df = spark.createDataFrame(turns, "pair_id int, side string, turn int, role string, text string").withColumn("k", F.lit(9)).withColumn("prompt", F.lit("clash"))
    got = {r["pair_id"]: r for r in preference.preference_pairs(df).collect()}
    one = got[1]
    assert one["n_common"] == 1 and one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert [one["chosen"][a:b] for a, b in one["chosen_mask"]] == ["good<|im_end|>\n"] and [one["rejected"][a:b] for a, b in one["rejected_mask"]] == ["bad<|im_end|>\n"] * 2
    assert got[2]["n_common"] == 0 and got[2]["chosen"] == "<|im_start|>user\n<|im_end|>\n" and got[2]["rejected"] == "" and got[3]["chosen"] == "" and got[3]["rejected_mask"] == []
    assert got[4]["n_common"] == 1 and got[4]["chosen"] == got[4]["rejected"] == ""


def test_warc_round_trip(spark, tmp_path):
    html = '<html lang="de"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><p>Eins<br>zwei</p><script>var a = "<p>";</script>Drei &lt;</body>'
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", html), (2, None, None), (2, None, None), (3, "http://c", "plain\r\n\r\ntext")], "page_id int, url string, html string").withColumn("type", F.lit("clash"))
    source = warc.responses(pages, "2024-01-01T00:00:00Z")
    d = warc.derivatives(source)
    got = {(r["page_id"], r["type"]): r for r in d.collect()}
    assert d.count() == 8 and got[1, "conversion"]["block"] == "A & B\nEins\nzwei\nDrei <"
    meta = got[1, "metadata"]
    assert meta["refers_to"] == got[1, "conversion"]["refers_to"] and got[1, "conversion"]["record_id"] in meta["block"] and "language: de\r\n" in meta["block"] and "http-header: Content-Type" in meta["block"]
    assert got[1, "conversion"]["source_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest() and meta["target_uri"] == "http://a/X: y"
    assert got[1, "conversion"]["content_length"] == len(got[1, "conversion"]["block"].encode())
    warc.write_warc(d, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert rows(back, "header", "block") == rows(d, "header", "block")


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    turns = spark.createDataFrame([], "pair_id long, side string, turn long, role string, text string")
    tables = [exact_dedup.exact_classes(none), simhash.near_duplicates(none), similar.similar_documents(none), mixing.mix(none), secrets.scan(none), decontaminate.contamination(none, bench), url_filter.judge(pages, {"com/": "allow"}), preference.preference_pairs(turns), warc.derivatives(warc.responses(pages, "x"))]
    assert [t.count() for t in tables] == [0] * len(tables)


def test_rows_without_an_id_of_their_own_keep_their_texts(spark):
    """Null and repeated ids: one row of each text stays after exact dedup, one of each class after near dedup."""
    long = " ".join(f"w{k}" for k in range(60))
    texts = [(None, "only here"), (None, "nor is this one"), (1, "copy of"), (None, "copy  of"), (2, "copy of"), (3, "one text"), (3, "another text"), (3, "another text"), (None, long), (4, long + " more"), (5, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("name", F.lit("clash")).withColumn("row", F.lit("clash"))
    for digest in (exact_dedup.content_hash, lambda c: F.substring(F.md5(c.cast("binary")), 1, 0)):
        kept = exact_dedup.drop_copies(df, digest)
        assert kept.columns == df.columns
        assert rows(kept, "doc_id", "text") == sorted([texts[0], texts[1], texts[3], texts[5], texts[6], texts[8], texts[9], texts[10]], key=str)
    assert rows(similar.drop_similar(df), "doc_id", "text") == sorted([texts[0], texts[1], texts[3], texts[5], texts[6], texts[8], texts[10]], key=str)


def test_decontamination_keeps_rows_apart(spark, monkeypatch):
    """Repeated rows, rows without an id and items without one; bitmaps so small that every shingle passes change nothing."""
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "alpha beta"), (None, "epsilon")], "item_id long, text string")
    text = spark.createDataFrame([(None, "alpha beta here"), (None, "gamma delta here"), (None, "nothing at all"), (7, "alpha beta gamma delta"), (7, "alpha beta gamma delta"), (8, "an EPSILON")], "doc_id long, text string")
    one = rows(decontaminate.contamination(text, bench), "doc_id", "n_words", "spans", "items")
    monkeypatch.setattr(decontaminate, "BITS", 15)
    assert len(one) == 6 and one == rows(decontaminate.contamination(text, bench), "doc_id", "n_words", "spans", "items")
    assert (7, 4, [[0, 2], [2, 4]], ["1", "2", "3"]) in one and (8, 2, [[1, 2]], []) in one and (None, 3, [], []) in one
    assert rows(decontaminate.drop_contaminated(text, bench), "text") == [("nothing at all",)]


def test_character_references(spark):
    cases = {"&#233;&eacute;&mdash;&#x41;&#X1F600;": "éé—A😀", "&amp;lt; &apos;": "&lt; '", "a&nbsp;b&#160;c": "a b c", "&#0;&#55296;&nosuch;&": "&#0;&#55296;&nosuch;&", "AT&T; &copy": "AT&T; &copy", "": ""}
    df = spark.createDataFrame(list(cases.items()), "html string, plain string")
    assert all(r["got"] == r["plain"] for r in df.withColumn("got", warc.decoded(F.col("html"))).collect())


def test_record_ids_tell_contents_apart(spark):
    pages = spark.createDataFrame([(1, "http://a", "x"), (1, "http://a", "y"), (None, "http://a", "x")], "page_id int, url string, html string")
    ids = [r["record_id"] for r in warc.derivatives(warc.responses(pages, "2024-01-01T00:00:00Z")).collect()]
    assert len(set(ids)) == len(ids) == 6


def test_deep_paths_have_templates_of_their_own(spark):
    rules = {"a.org/a/b/c/d/x/": "block", "a.org/a/b/c/d/y/": "allow"}
    urls = [f"http://a.org/a/b/c/d/{s}/{k}" for s in "xy" for k in range(8)] + ["http://a.org/a/b/c/d/z/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["path"][9]: (r["template"], r["verdict"]) for r in url_filter.judge(df, rules).collect()}
    assert got == {"x": ("/a/b/c/d/x/{n}", "block"), "y": ("/a/b/c/d/y/{n}", "allow"), "z": ("/a/b/c/d/z/{n}", "allow")}


@pytest.mark.parametrize("total", [0, 1, 16_000, 10**6, 17 * 10**9, 10**11])
def test_samples_are_never_empty_however_many_labels(total):
    share = _common.sample_limit(total, 16_000) / 2**62
    assert 0 < share <= 1 and abs(share * total - min(total, 16_000)) < 1


def test_samples_are_bounded_in_bytes(spark):
    df = spark.createDataFrame([(k, "x" * 1000, k % 2) for k in range(2000)], "doc_id long, text string, y int")
    part = _common.labelled_sample(df, df.unionByName(df), "y", 10**6, 200_000, 1)
    n, other = part.count(), _common.labelled_sample(df.repartition(5), df, "y", 10**6, 200_000, 1)
    assert 150 < n <= 200 and rows(part, "text", "y") == rows(other, "text", "y")
    assert _common.labelled_sample(df, df, "y", 10**6, 1, 1).count() > 0


def test_many_secrets_in_one_text(spark):
    """Every match of a text with thousands of them, and keys of dashed groups; words joined by separators are none."""
    one = "token=abcdefghijkl12 "
    long = spark.createDataFrame([(1, one * 4000)], "doc_id long, text string")
    spans = secrets.scan(long).first()["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [(k * len(one), (k + 1) * len(one) - 1) for k in range(4000)]
    keys = ["key-Zx9Qw3Er7Ty1-Ui5Op2As8Df4-Gh6Jk8Lz0Xc1", "lin-9fK2x-Qm7Tz-4Lp8W-Rj3Yv-8Hn6B"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*keys, "static/path_to/page-2024/chapter-12/index"])], "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan(df).collect()}
    assert got == {0: ["entropy"], 1: ["entropy"], 2: []}


def test_preference_pairs_of_named_conversations(spark):
    turns = [(f"c{k}", t, r, f"{r} {k}") for k in range(6) for t, r in enumerate(("user", "assistant"))] + [(None, 0, "user", "nobody")]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string").withColumn("last", F.lit("clash"))
    got = {r["pair_id"]: r for r in preference.preference_pairs(preference.mismatched_pairs(df, buckets=1)).collect()}
    assert len(got) == 7 and got[None]["rejected"] == ""
    assert sum(r["rejected"] == "" for r in got.values()) == 2 and all(r["chosen"] != r["rejected"] for r in got.values())


def test_mixing_of_rows_without_an_id_of_their_own(spark):
    """One id with different texts and rows without an id: reruns over other partitions agree."""
    texts = [(k % 3 or None, " ".join(["w"] * (k % 17) + [f"x{k}"]), "a" if k % 2 else "b") for k in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    first = rows(mixing.mix(df), "doc_id", "source", "size", "taken")
    assert all(first == rows(mixing.mix(df.repartition(k, "text").sortWithinPartitions(F.rand(k))), "doc_id", "source", "size", "taken") for k in (2, 5))


def test_filters_of_repeated_ids_and_empty_tables(spark, docs, labels):
    df = spark.createDataFrame([(1, "good words here"), (1, "zz qq 11"), (None, "good words too"), (None, None)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    w = quality.train(df.where("doc_id = 1"), labels)
    kept = quality.keep_good(df, w, 0.0)
    assert kept.columns == df.columns and kept.count() == 4 and quality.keep_good(df, w, 1.1).count() == 0
    none = docs.limit(0)
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    tables = [quality.score(none, w), quality.keep_good(none, w), toxicity.score(none, w), toxicity.locate(none, w), toxicity.drop_toxic(none, w), exact_dedup.drop_copies(none), similar.drop_similar(none), simhash.drop_near_duplicates(none), decontaminate.drop_contaminated(none, bench)]
    assert [t.count() for t in tables] == [0] * len(tables)


def test_near_duplicates_keep_rows_without_an_id(spark):
    texts = [(None, "only here at last"), (None, "nor is this one it"), (1, "same words as these"), (None, "same words  as these"), (3, "one text of mine"), (3, "another text of yours"), (3, "another text of yours")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    kept = rows(simhash.drop_near_duplicates(df), "doc_id", "text")
    assert kept == sorted([texts[0], texts[1], texts[3], texts[4], texts[5]], key=str)


@pytest.mark.parametrize(("master", "fails"), [("local[4]", False), ("local", False), ("local-cluster[3,2,1000]", True), ("spark://host:7077", True)])
def test_a_folder_that_all_share_is_asked_for_on_clusters(master, fails):
    class Bare:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)
            set = staticmethod(lambda key, value: None)

        class sparkContext:  # noqa: N801
            pass

    Bare.sparkContext.master = master
    if fails:
        with pytest.raises(ValueError, match="checkpoint"):
            _common.shared_folder(Bare)
    else:
        assert _common.shared_folder(Bare).startswith("file://")
