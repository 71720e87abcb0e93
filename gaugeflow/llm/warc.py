"""WARC derivatives: linked metadata and plain-text conversion records for responses."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WARC_VERSION = "WARC/1.1"
#: Elements whose tags end a line of text; the rest of the tags vanish.
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"


def _either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


#: (pattern, replacement), in this order, to get from HTML to text. They mean the same to Java and to RE2.
HTML_STEPS = (
    (r"(?s)<!--.*?-->", " "),
    *((rf"(?s)<{_either_case(t)}\b.*?</{_either_case(t)}[^>]*>", " ") for t in ("script", "style")),
    (rf"</?({'|'.join(_either_case(b) for b in BLOCKS.split('|'))})\b[^>]*>", "\n"),
    (r"<[A-Za-z!/][^>]*>", ""),
    None,  # character references are decoded here
    (r"[ \t\r\f\x0B]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
)
TITLE = rf"(?s)<{_either_case('title')}[^>]*>(.*?)</{_either_case('title')}"
LANGUAGE = rf"""<{_either_case('html')}\b[^>]*\b{_either_case('lang')}="([A-Za-z-]*)\""""


#: Character references: names, decimal and hexadecimal numbers.
REFERENCE = "&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,8});"
#: HTML's names of characters, as Python's library has them; a space that doesn't break is a space.
NAMES = {name: " " if name == "nbsp" else chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}


def decoded(text: Column) -> Column:
    """The text with its character references replaced, once; names and numbers that stand for no character stay as they are."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])

    def character(ref: Column) -> Column:
        digits = F.when(ref.rlike("^#[0-9]"), F.conv(F.substr(ref, F.lit(2)), 10, 16)).when(ref.rlike("^#"), F.substr(ref, F.lit(3)))
        code = F.conv(digits, 16, 10).cast("int")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        number = F.when(code == 160, F.lit(" ")).when(valid, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
        return F.coalesce(number, F.try_element_at(names, ref), F.concat(F.lit("&"), ref, F.lit(";")))

    gaps = F.split(text, REFERENCE, -1)
    put = F.concat(F.transform(found, character), F.array(F.lit("")))
    return F.when(F.size(found) > 0, F.array_join(F.zip_with(gaps, put, lambda gap, c: F.concat(gap, c)), "")).otherwise(text)


def _steps(html: Column, steps: tuple) -> Column:
    for step in steps:
        html = F.regexp_replace(html, *step) if step else decoded(html)
    return html


def with_plain_text(rows: DataFrame, html: str, name: str) -> DataFrame:
    """`rows` with one more column, the text of the HTML in another; null counts as empty."""
    cut = HTML_STEPS.index(None)
    # Tags are gone before references are decoded, in a column of its own, so that no step runs twice.
    rows = rows.withColumn(name, _steps(F.coalesce(html, F.lit("")), HTML_STEPS[:cut]))
    return rows.withColumn(name, _steps(F.col(name), HTML_STEPS[cut:]))


def _urn(kind: str, *parts: Column) -> Column:
    """A name-based record id: the same input gives the same id in every run."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records for pages (page_id, url, html) that were fetched at `date`: nulls count as empty.

    A record's id follows from page_id, url and payload, so only rows that agree in all of them have one id: they are one response.
    """
    url, html = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", ""), F.coalesce("html", F.lit(""))
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    out = pages.select("page_id", url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_head"), html.alias("payload"))
    return out.withColumn("record_id", _urn("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.md5(F.col("payload").cast("binary"))))


def derivatives(source: DataFrame) -> DataFrame:
    """(page_id, type, record_id, refers_to, target_uri, content_length, block_digest, source_digest, header, block): for each
    response a metadata and a conversion record.

    `source` has (page_id, record_id, target_uri, date, http_head, payload). Both records refer to the response's record id
    and keep its target URI, date and payload digest; the metadata record holds the response's HTTP headers, title, language
    and the conversion's id. Records of one response share nothing with others, so there is no shuffle; repeated rows
    give repeated records with the same ids; an empty payload gives an empty conversion; other columns aren't read.
    """
    rows = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "http_head", "payload", _digest(F.col("payload")).alias("source_digest"))
    rows = with_plain_text(rows, "payload", "plain")
    for kind in ("metadata", "conversion"):
        rows = rows.withColumn(f"{kind}_id", _urn(kind, F.col("refers_to")))
    title = F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"[ \t\n\x0B\f\r]+", " ")
    fields = F.concat(F.lit("title: "), title, F.lit("\r\nlanguage: "), F.regexp_extract("payload", LANGUAGE, 1), F.lit("\r\nconversion: <"), "conversion_id", F.lit(">\r\n"))
    heads = F.regexp_replace(F.regexp_replace("http_head", r"(\r\n)+$", ""), r"(?m)^", "http-header: ")
    kinds = F.array(
        F.struct(F.lit("metadata").alias("type"), F.col("metadata_id").alias("record_id"), F.lit("application/warc-fields").alias("content_type"), F.concat(fields, heads, F.lit("\r\n")).alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.col("conversion_id").alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("plain").alias("block")),
    )
    rows = rows.select("page_id", "refers_to", "target_uri", "date", "source_digest", F.explode(kinds).alias("r")).select("page_id", "refers_to", "target_uri", "date", "source_digest", "r.*")
    rows = rows.withColumn("content_length", F.octet_length("block").cast("long")).withColumn("block_digest", _digest(F.col("block")))
    named = {"WARC-Type": "type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Block-Digest": "block_digest", "WARC-Source-Payload-Digest": "source_digest", "Content-Type": "content_type", "Content-Length": "content_length"}
    lines = [F.lit(WARC_VERSION)]
    for name, c in named.items():
        value = F.col(c).cast("string")
        lines.append(F.concat(F.lit(f"{name}: "), F.concat(F.lit("<"), value, F.lit(">")) if c in ("record_id", "refers_to") else value))
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n"))
    return rows.select("page_id", "type", "record_id", "refers_to", "target_uri", "content_length", "block_digest", "source_digest", header.alias("header"), "block")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records (header, block) as WARC files: each record is followed by two line ends, which are Spark's row ends here.

    Header and block must not be null; repeated records are written each; an empty table gives a folder without records.
    """
    text = records.select(F.concat("header", F.lit("\r\n"), "block").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, block) of the records of WARC files whose blocks are UTF-8 text; blocks may hold the record end themselves.

    A block that holds a record end and the mark of a record after it is cut there. Files without records give no rows.
    """
    raw = spark.read.option("lineSep", f"\r\n\r\n{WARC_VERSION}\r\n").text(path)
    whole = F.regexp_replace(F.regexp_replace("value", rf"^{WARC_VERSION}\r\n", ""), r"\r\n\r\n\z", "")
    cut = F.instr("value", "\r\n\r\n")
    rows = raw.select(whole.alias("value")).where("value <> ''")
    header = F.concat(F.lit(f"{WARC_VERSION}\r\n"), F.substring("value", F.lit(1), cut + 1))
    return rows.select(header.alias("header"), F.substr("value", cut + 4).alias("block"))
