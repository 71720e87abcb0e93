"""Column expressions: all built from Spark's own functions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """True for a double that is neither null, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def or_null(c: Column | str) -> Column:
    """The value where it is finite, else null."""
    return F.when(finite(c), col(c))


def ratio(a: Column | str, b: Column | str, empty: float = 0.0) -> Column:
    """a / b, and `empty` where b is 0."""
    return F.when(col(b) != 0, col(a) / col(b)).otherwise(F.lit(empty))


def clamp(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def saturate(c: Column | str, scale: float = 1.0) -> Column:
    """min(1, |v| / scale); null stays null."""
    return F.when(col(c).isNotNull(), F.least(F.lit(1.0), F.abs(col(c)) / F.lit(scale)))


def normalized_entropy(p: Column | str) -> Column:
    """-sum(p ln p) / ln k of an array of k probabilities; 0 ln 0 is 0, and one class has no entropy."""
    p = col(p)
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0)))
    return F.when(F.size(p) > 1, total / F.ln(F.size(p).cast("double"))).otherwise(F.lit(0.0))


def argmax_name(p: Column | str, names: Sequence[str]) -> Column:
    """The name at the largest element, the first of equals."""
    p = col(p)
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(p, F.array_max(p)).cast("int"))


def fixed(c: Column | str, places: int = 6) -> Column:
    """A double as decimal text, for hashes: the text of a double differs between engines."""
    return F.round(col(c), places).cast(f"decimal(38,{places})").cast("string")


def content_hash(*parts: Column | str) -> Column:
    """SHA-256 of the parts' texts joined by `|`; bars and backslashes in a text are escaped and a null isn't an empty text, so other parts have another text."""
    plain = lambda p: F.replace(F.replace(col(p).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.sha2(F.concat_ws("|", *[F.coalesce(plain(p), F.lit("\\0")) for p in parts]), 256)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


# Spellings of missing and of infinite values.
MISSING = ("", "na", "nan", "null", "none")
INFINITE = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")


def is_missing(text: Column | str) -> Column:
    """Missing spellings of a text value, case and outer blanks aside; null is missing."""
    return F.coalesce(F.lower(F.btrim(col(text))).isin(*MISSING), F.lit(True))


def is_infinity(text: Column | str) -> Column:
    return F.coalesce(F.lower(F.btrim(col(text))).isin(*INFINITE), F.lit(False))


def first_reason(*checks: tuple[Column, str], ok: str | None = None) -> Column:
    """The code of the first check that holds, in the order given, else `ok`."""
    out = F.lit(ok).cast("string")
    for failed, code in reversed(checks):
        out = F.when(F.coalesce(failed, F.lit(False)), F.lit(code)).otherwise(out)
    return out
