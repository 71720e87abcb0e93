"""Secret scans on DataFrame operations alone.

Patterns give the base spans. Beside them, candidate strings are read through a sliding window whose character counts are
kept up to date as the window moves, and spans whose Shannon entropy reaches the limit of their character class are added,
unless an allow-list knows them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: The base patterns (letters of the assign keywords in either case) with the length that counts.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 24
#: Bits a character within the window, for strings of hexadecimal digits and for others that mix letters and digits.
HEX_BITS, MIXED_BITS = 3.05, 3.85
#: Strings that are no secrets: without a digit or without a letter, a UUID, words and numbers joined by separators (a web path).
ALLOWED = (r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^[A-Za-z]+([_/=+-]+([A-Za-z]{1,12}|[0-9]{1,12}))+$")
_KINDS = ("assign", "access", "hex", "entropy")


def _spans(text: Column, found: Column, pattern: str) -> Column:
    """array of (start, end, match) for `found`, all matches of the pattern in the text, from the lengths between them.

    Matches are added up in runs of about the square root of their number, so that no long array is copied for each match.
    """
    kind = "array<struct<start:int,end:int,match:string>>"
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    run = F.ceil(F.sqrt(F.size(found))).cast("int")
    runs = F.transform(F.sequence(F.lit(1), F.size(found), run), lambda k: F.slice(pairs, k, run))
    long = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["match"]))
    starts = F.aggregate(runs, F.array(F.lit(0)), lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + long(part))))

    def placed(part: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + x["gap"]
            z = a + F.length(x["match"])
            return F.struct(z.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), z.alias("end"), x["match"].alias("match")))).alias("out"))

        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast(kind).alias("out")), step)["out"]

    parts = F.zip_with(runs, F.slice(starts, 1, F.size(runs)), placed)
    return F.when(F.size(found) > 0, F.flatten(parts)).otherwise(F.array().cast(kind))


def window_entropy(match: Column, limit: Column, window: int = WINDOW) -> Column:
    """(first, last): start of the first and end of the last window of `match` that has `limit` bits a character; nulls if none.

    The counts of the alphabet's characters lose the character that leaves and gain the one that enters; the sum of
    count * log2(count), of which the entropy follows, moves with them. An empty candidate, and one shorter than the window,
    has nulls.
    """
    import math

    codes = F.transform(F.split(match, ""), lambda c: F.locate(c, ALPHABET) if isinstance(c, str) else F.call_function("locate", c, F.lit(ALPHABET)))
    table = F.array(*[F.lit(0.0)] + [F.lit(k * math.log2(k)) for k in range(1, window + 2)])
    zero = F.struct(
        F.lit(0).alias("k"),
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"),
        F.lit(0.0).alias("s"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def at(a: Column, i: Column) -> Column:
        return F.get(a, i)

    def step(acc: Column, x: Column) -> Column:
        gone = F.coalesce(x["out"], F.lit(-1))
        less = F.coalesce(at(acc["n"], gone), F.lit(0))
        s = acc["s"] - F.when(less > 0, at(table, less) - at(table, less - 1)).otherwise(F.lit(0.0))
        more = at(acc["n"], x["in"]) - F.when(x["in"] == gone, 1).otherwise(0)
        s = s - at(table, more) + at(table, more + 1)
        n = F.transform(acc["n"], lambda c, i: c + F.when(i == x["in"], 1).otherwise(0) - F.when(i == gone, 1).otherwise(0))
        high = (acc["k"] >= window - 1) & (F.lit(math.log2(window)) - s / window >= limit)
        first = F.when(high, F.coalesce(acc["first"], acc["k"] - (window - 1))).otherwise(acc["first"])
        last = F.when(high, acc["k"] + 1).otherwise(acc["last"])
        return F.struct((acc["k"] + 1).alias("k"), n.alias("n"), s.alias("s"), first.cast("int").alias("first"), last.cast("int").alias("last"))

    shifted = F.concat(F.array_repeat(F.lit(None).cast("int"), window), codes)
    pairs = F.zip_with(codes, F.slice(shifted, 1, F.size(codes)), lambda a, b: F.struct(a.alias("in"), b.alias("out")))
    return F.aggregate(pairs, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def scan(docs: DataFrame, window: int = WINDOW, hex_bits: float = HEX_BITS, mixed_bits: float = MIXED_BITS, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(doc_id, spans) of every row: spans is an array of (start, kind_no, kind, end) in order, in code points, end exclusive.

    Kinds are assign, access, hex and entropy; matches of a kind are leftmost and don't overlap. An entropy span runs from
    the first to the last window at the limit within a candidate, and is left out where the allow-list matches the
    candidate or a base span contains it. Null texts count as empty; texts are read whole; repeated rows count each; an
    empty table gives an empty result; other columns aren't read. No shuffle.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Runs that are too short can't pass, so the longer runs are looked for at once; an assign match must be found first.
    access, runs = ACCESS[:-1] + f"{{{ACCESS_LEAST - 4},}}", HEX[:-1] + f"{{{HEX_LEAST},}}"
    patterns = {"assign": ASSIGN, "access": access, "hex": runs, "entropy": CANDIDATE}
    rows = rows.withColumns({f"m_{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    rows = rows.withColumns({k: _spans(F.col("text"), F.col(f"m_{k}"), p) for k, p in patterns.items()})
    long_enough = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_LEAST
    rows = rows.withColumn("assign", F.filter("assign", long_enough))

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(_KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    rows = rows.withColumn("base", F.array_sort(F.concat(tagged("assign"), tagged("access"), tagged("hex"))))
    unknown = lambda s: ~reduce(lambda a, b: a | b, [s["match"].rlike(p) for p in allowed])

    def measured(s: Column) -> Column:
        limit = F.when(s["match"].rlike("^[0-9A-Fa-f]*$"), F.lit(hex_bits)).otherwise(F.lit(mixed_bits))
        e = window_entropy(s["match"], limit, window)
        return F.struct((s["start"] + e["first"]).alias("start"), F.lit(3).alias("kind_no"), F.lit("entropy").alias("kind"), (s["start"] + e["last"]).alias("end"))

    rows = rows.withColumn("entropy", F.transform(F.filter("entropy", unknown), measured))
    free = lambda s: s["start"].isNotNull() & ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    return rows.select("doc_id", F.array_sort(F.concat("base", F.filter("entropy", free))).alias("spans"))
