"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, divergence, exact_dedup, mixing, preference, quality, secrets, sharding, simhash, spelling, toxicity, url_filter, warc
from ._common import held_out

#: The rules of op2 (host/path and verdict).
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
FETCHED = "2024-01-01T00:00:00Z"
#: The operator goes down to the longest path; its SQL is written out for so many segments, beyond those of the tables (two).
SQL_LEVELS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.preference_pairs(preference.mismatched_pairs(table(spark, sf_dir, "conversations")))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return pairs.select("pair_id", "n_common", "prompt", "chosen", "rejected", shown("chosen_mask").alias("chosen_mask"), shown("rejected_mask").alias("rejected_mask"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = found.select("doc_id", "n_words", decontaminate.words_hit(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages"), FETCHED))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    found = [op1_quality, op2_url_filter, op3_exact_dedup, op4_mix, op5_simhash, op6_preference, op7_secrets, op8_toxicity, op9_decontaminate, op10_warc, op11_divergence, op12_spelling, op13_shards]
    return {f.__name__: f for f in found}


def _text(s: str) -> str:
    """A DuckDB string literal."""
    return "'" + s.replace("'", "''") + "'"


def _escaped(s: str) -> str:
    """A DuckDB literal with escapes, for strings with control characters."""
    return "E'" + s.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"


def _op2_sql() -> str:
    rules = sorted(URL_RULES, key=lambda r: (-len(r), r))
    fits = " ".join(f"WHEN (host = {_text(r.partition('/')[0])} OR ends_with(host, {_text('.' + r.partition('/')[0])})) AND starts_with(path, {_text('/' + r.partition('/')[2])}) THEN {_text(r)}" for r in rules)
    given = " ".join(f"WHEN {_text(r)} THEN {_text(v)}" for r, v in URL_RULES.items())
    m, z2 = url_filter.MIN_CHILDREN, url_filter.Z**2
    sql = rf"""WITH p0 AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p1 AS (SELECT *, CASE {fits} END AS rule FROM p0),
p AS (SELECT *, CASE rule {given} END AS given, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
  lambda s: regexp_replace(regexp_replace(s, '^[0-9]+(\.[a-z]+)?$', '{{n}}\1'), '^[0-9a-f]{{8,}}(\.[a-z]+)?$', '{{h}}\1')) AS shape FROM p1),
t0 AS (SELECT host, shape, count(*) AS n, count(*) FILTER (given = 'allow') AS good, count(*) FILTER (given = 'block') AS bad, '' AS template FROM p GROUP BY host, shape)"""
    for k in range(SQL_LEVELS):
        sql += f""",
k{k} AS (SELECT host, template, shape[{k + 1}] AS child, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM t{k} WHERE len(shape) > {k} GROUP BY ALL),
w{k} AS (SELECT *, count(*) OVER w AS kinds, sum(n) OVER w AS all_n, (sum(bad) OVER w)::DOUBLE / nullif(sum(good + bad) OVER w, 0) AS mean, bad::DOUBLE / nullif(good + bad, 0) AS own FROM k{k} WINDOW w AS (PARTITION BY host, template)),
d{k} AS (SELECT host, template, child, template || '/' || CASE WHEN (kinds >= {m} AND kinds * 5 >= all_n) OR (kinds > 1 AND coalesce((own - mean) * (own - mean) * (good + bad) <= {z2} * mean * (1 - mean) AND mean > 0 AND mean < 1, false)) THEN '*' ELSE child END AS nxt FROM w{k}),
t{k + 1} AS (SELECT t.host, shape, n, good, bad, coalesce(nxt, t.template) AS template FROM t{k} t LEFT JOIN d{k} d ON t.host = d.host AND t.template = d.template AND len(shape) > {k} AND shape[{k + 1}] = d.child)"""
    e = SQL_LEVELS
    return sql + f""",
t AS (SELECT host, shape, good, bad, template FROM t{e}),
u AS (SELECT host, template, (sum(bad) + {url_filter.STRENGTH * url_filter.PRIOR}::DOUBLE) / (sum(good) + sum(bad) + {url_filter.STRENGTH}::DOUBLE) AS purity FROM t GROUP BY host, template)
SELECT page_id, p.host, path, rule, coalesce(given, CASE WHEN purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, t.template
FROM p JOIN t ON p.host = t.host AND p.shape = t.shape JOIN u ON t.host = u.host AND t.template = u.template"""


_OP3_SQL = r"""WITH r AS (SELECT doc_id, coalesce(length(text), 0) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, max(size) OVER w AS most, count(*) OVER (PARTITION BY norm) AS group_size FROM r WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id NULLS FIRST))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND size = most AND row_number() OVER (PARTITION BY norm, doc_id, size) = 1 AS kept, sha256(norm) AS text_sha256 FROM k"""

_OP4_SQL = r"""WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM r GROUP BY source),
f AS (SELECT *, source_size * 3.0::DOUBLE AS "full", source_size * 3.0::DOUBLE / w AS fill FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum("full") OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY fill, source NULLS LAST) AS place FROM f),
t AS (SELECT source, source_size, least("full", coalesce(arg_min(level, place) FILTER (fill >= level) OVER (), 0) * w) AS target FROM l),
x AS (SELECT r.doc_id, r.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
  coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM x)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM y"""


def _op6_sql() -> str:
    begin, middle, end = map(_escaped, preference.MARKUP)
    rest = lambda side, what: f"coalesce(string_agg({what}, '' ORDER BY k) FILTER (side = '{side}' AND k > n_common), '')"
    mask = lambda side: f"coalesce(string_agg((pos + head - {side}_start)::BIGINT || ':' || (pos + long - {side}_start)::BIGINT, ',' ORDER BY k) FILTER (side = '{side}' AND k > n_common AND role = 'assistant'), '')"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
e AS (SELECT conv_id, max(struct_pack(turn := turn, role := role, text := text)) AS t FROM c GROUP BY conv_id),
j AS (SELECT c.*, struct_pack(turn := c.turn, role := c.role, text := c.text) = e.t AS is_last, o.t.text AS other FROM c JOIN e USING (conv_id) LEFT JOIN e o ON o.conv_id = xor(c.conv_id, 1)),
s AS (SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM j UNION ALL SELECT conv_id, 'rejected', turn, role, CASE WHEN is_last THEN other ELSE text END FROM j WHERE NOT is_last OR other IS NOT NULL),
h AS (SELECT *, length({begin} || role || {middle}) AS head, length({begin} || role || {middle} || text || {end}) AS long, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS k FROM s),
a AS (SELECT *, coalesce(sum(long) OVER (PARTITION BY pair_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, {begin} || role || {middle} || text || {end} AS shown FROM h),
b AS (SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, coalesce(x.k, y.k) AS k, coalesce(x.role = y.role AND x.text = y.text, false) AS same FROM (FROM a WHERE side = 'chosen') x FULL JOIN (FROM a WHERE side = 'rejected') y ON x.pair_id = y.pair_id AND x.k = y.k),
n AS (SELECT pair_id, (coalesce(min(k) FILTER (NOT same) - 1, max(k)))::INTEGER AS n_common FROM b GROUP BY pair_id),
g AS (SELECT a.*, n_common, coalesce(sum(long) FILTER (side = 'chosen' AND k <= n_common) OVER (PARTITION BY pair_id), 0) AS chosen_start, coalesce(sum(long) FILTER (side = 'chosen' AND k <= n_common) OVER (PARTITION BY pair_id), 0) AS rejected_start FROM a JOIN n USING (pair_id))
SELECT pair_id, any_value(n_common) AS n_common, coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 'chosen' AND k <= n_common), '') AS prompt, {rest('chosen', 'shown')} AS chosen, {rest('rejected', 'shown')} AS rejected, {mask('chosen')} AS chosen_mask, {mask('rejected')} AS rejected_mask FROM g GROUP BY pair_id"""


def _op7_sql() -> str:
    w = secrets.WINDOW
    access, runs = secrets.ACCESS[:-1] + f"{{{secrets.ACCESS_LEAST - 4},}}", secrets.HEX[:-1] + f"{{{secrets.HEX_LEAST},}}"
    kinds = [("assign", secrets.ASSIGN), ("access", access), ("hex", runs), ("entropy", secrets.CANDIDATE)]
    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS kind_no, {_text(name)} AS kind, regexp_extract_all(text, {_text(p)}) AS f, string_split_regex(text, {_text(p)}) AS g FROM t" for k, (name, p) in enumerate(kinds))
    allowed = " OR ".join(f"regexp_matches(match, {_text(p)})" for p in secrets.ALLOWED)
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({found}),
i AS (SELECT doc_id, kind_no, kind, f, g, unnest(range(1, len(f) + 1)) AS i FROM m WHERE len(f) > 0),
s AS (SELECT doc_id, kind_no, kind, f[i] AS match, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM i),
b AS (SELECT doc_id, kind_no, kind, start, start + length(match) AS "end" FROM s WHERE kind_no IN (1, 2) OR kind_no = 0 AND length(regexp_extract(match, {_text(secrets.ASSIGN)}, 2)) >= {secrets.ASSIGN_LEAST}),
c AS (SELECT *, list_filter(range(0, length(match) - {w} + 1), lambda k: list_aggregate(string_split(match[k + 1:k + {w}], ''), 'entropy') >= CASE WHEN regexp_matches(match, '^[0-9A-Fa-f]*$') THEN {secrets.HEX_BITS} ELSE {secrets.MIXED_BITS} END) AS high FROM s WHERE kind_no = 3 AND NOT ({allowed})),
e AS (SELECT doc_id, kind_no, kind, start + list_min(high) AS start, start + list_max(high) + {w} AS "end" FROM c WHERE len(high) > 0),
a AS (SELECT * FROM b UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = e.doc_id AND b.start <= e.start AND e."end" <= b."end"))
SELECT t.doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, kind_no) FILTER (kind_no < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, kind_no), '') AS spans
FROM t LEFT JOIN a USING (doc_id) GROUP BY t.doc_id"""


_OP9_SQL = r"""WITH f AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, doc_id FROM documents),
i AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, item_id FROM benchmark),
p AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS a FROM i WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, n, array_to_string(w[a:a + n - 1], ' ') AS words FROM p),
d AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM f, (SELECT DISTINCT n FROM x) WHERE len(w) >= n),
y AS (SELECT doc_id, n, a, array_to_string(w[a:a + n - 1], ' ') AS words FROM d),
h AS (SELECT doc_id, y.n, a, item_id FROM y JOIN x ON y.n = x.n AND y.words = x.words),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS k FROM h) GROUP BY doc_id),
o AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT f.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM f LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)"""


def _op10_sql() -> str:
    plain = "payload"
    names = "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in warc.NAMES.items()) + "}"
    number = "CASE WHEN r ~ '#[0-9]+' THEN r[2:]::INTEGER WHEN r[1] = '#' THEN ('0x' || r[3:])::INTEGER END"
    one = f"coalesce(CASE WHEN ({number}) = 160 THEN ' ' WHEN ({number}) BETWEEN 1 AND 55295 OR ({number}) BETWEEN 57344 AND 1114111 THEN chr({number}) END, names[r], '&' || r || ';')"
    for step in warc.HTML_STEPS:
        if step:
            plain = f"regexp_replace({plain}, {_text(step[0])}, {_escaped(step[1])}, 'g')"
        else:
            before, plain = plain, "decoded"
    gaps, refs = f"string_split_regex(t, {_text(warc.REFERENCE)})", f"list_transform(regexp_extract_all(t, {_text(warc.REFERENCE)}, 1), lambda r: {one})"
    decoded = f"list_reduce(list_transform(list_zip({gaps}, {refs}), lambda z: z[1] || coalesce(z[2], '')), lambda x, y: x || y)"
    urn = lambda s: f"'urn:uuid:' || regexp_replace(md5({s}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '\\1-\\2-\\3-\\4-')"
    title = rf"regexp_replace(regexp_extract(payload, {_text(warc.TITLE)}, 1), '[ \t\n\x0B\f\r]+', ' ', 'g')"
    order = [("WARC-Type", "type"), ("WARC-Record-ID", "'<' || record_id || '>'"), ("WARC-Refers-To", "'<' || refers_to || '>'"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", f"'{FETCHED}'"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    header = " || ".join([r"E'WARC/1.1\r\n'", *(rf"'{name}: ' || {c} || E'\r\n'" for name, c in order)])
    http = r"E'http-header: HTTP/1.1 200 OK\r\nhttp-header: Content-Type: text/html; charset=utf-8\r\n'"
    return rf"""WITH s AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\r\n]+', '', 'g') AS target_uri, coalesce(html, '') AS payload FROM pages),
n AS (SELECT {names} AS names),
h AS (SELECT s.*, {before} AS t, names FROM s, n),
d AS (SELECT *, {decoded} AS decoded FROM h),
r AS (SELECT * EXCLUDE (names), {urn("'response|' || coalesce(page_id::VARCHAR, '') || '|' || target_uri || '|' || md5(payload)")} AS refers_to, 'sha256:' || sha256(payload) AS source_digest, {plain} AS plain FROM d),
k AS (SELECT *, {urn("'conversion|' || refers_to")} AS conversion_id, {urn("'metadata|' || refers_to")} AS metadata_id FROM r),
u AS (SELECT page_id, 'metadata' AS type, metadata_id AS record_id, refers_to, target_uri, source_digest, 'application/warc-fields' AS content_type,
  'title: ' || {title} || E'\r\nlanguage: ' || regexp_extract(payload, {_text(warc.LANGUAGE)}, 1) || E'\r\nconversion: <' || conversion_id || E'>\r\n' || {http} AS block FROM k
  UNION ALL SELECT page_id, 'conversion', conversion_id, refers_to, target_uri, source_digest, 'text/plain; charset=utf-8', plain FROM k),
b AS (SELECT *, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest FROM u)
SELECT page_id, type, record_id, refers_to, target_uri, content_length, block_digest, source_digest, {header} AS header, block FROM b"""


def _op11_sql() -> str:
    d = divergence
    price = lambda n, total: f"1 + ({d.UNIT}::HUGEINT * ({n} + {d.SMOOTHING})) // ({total} + {d.SMOOTHING} * v)"
    term = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    return rf"""WITH r AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}') AS found FROM documents),
o AS (SELECT id, lang, source, unnest(found) AS term FROM r),
k AS (SELECT lang, term, count(*) AS whole FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= {d.LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(whole) AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM r),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, s.source, term, coalesce(n, 0) AS n, {price("coalesce(n, 0)", "total")} AS p, {price("whole", "lang_total")} AS q FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
w AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM w WHERE part = 'pair' OR rank <= {d.TOP}"""


def _crc(text: str) -> str:
    """DuckDB has no CRC-32: the bytes of a text are folded, the table's entry of a byte being those of its bits."""
    entries = [1 << j for j in range(8)]
    for _ in range(8):
        entries = [k >> 1 ^ (3988292384 if k & 1 else 0) for k in entries]
    entry = reduce(lambda a, b: f"xor({a}, {b})", [f"(xor(c, x) >> {j} & 1) * {k}" for j, k in enumerate(entries)])
    octets = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda y: ('0x' || y)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, {entry}), 4294967295::BIGINT), 4294967295)"


def _op12_sql() -> str:
    s = spelling
    return rf"""WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
d AS (SELECT run, count(*) AS n, {_crc("id || ':' || run")} AS h FROM r WHERE length(run) >= {s.LEAST_LENGTH} GROUP BY id, run),
c AS (SELECT CASE WHEN h % {s.MODULUS} = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM d),
w AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= {s.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {s.LEAST_COUNT}),
k AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
e AS (SELECT a.word, b.word AS other, b.n AS other_n FROM k a JOIN k b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.less = w.word UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.less = w.word),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM e GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {s.RATIO} * w.n THEN other END AS form, CASE WHEN other_n >= {s.RATIO} * w.n THEN other_n END AS form_n FROM w LEFT JOIN b USING (word)),
t AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.next = f.word)
SELECT word, form, t.at AS root, n, n_near, form_n FROM f JOIN t USING (word) WHERE t.next IS NULL"""


def _op13_sql() -> str:
    s = sharding
    return f"""WITH r AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, coalesce({_crc("text")}, 0) AS text_crc32, md5('{s.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size, text_crc32) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS share FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY share, source NULLS LAST, key) - 1 AS place, count(*) OVER () AS total FROM f),
h AS (SELECT *, place * {s.SHARDS} // total AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, (place - (shard * total + {s.SHARDS} - 1) // {s.SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM h"""


def oracle_sql() -> dict[str, str]:
    """op1 and op8 learn, and op5 needs XXH64: they are tested in tests/llm against brute force or held-out labels."""
    return {"op2_url_filter": _op2_sql(), "op3_exact_dedup": _OP3_SQL, "op4_mix": _OP4_SQL, "op6_preference": _op6_sql(), "op7_secrets": _op7_sql(), "op9_decontaminate": _OP9_SQL, "op10_warc": _op10_sql(), "op11_divergence": _op11_sql(), "op12_spelling": _op12_sql(), "op13_shards": _op13_sql()}
