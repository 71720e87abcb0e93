"""Canonical JSON of a column: sorted keys, no blanks, characters beyond ASCII as escapes. One value has one text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def _sorted(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs and the keys of its maps in code point order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_sorted(value.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: _sorted(F.element_at(value, k), kind.valueType)))
    return value


def _ascii(text: Column) -> Column:
    """JSON text with escapes, in small letters, for all beyond ASCII. Outside of strings there is nothing of that kind."""

    def unit(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        high, low = F.lit(0xD800) + F.shiftright(n - 0x10000, 10), F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(n < 127, c).when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low)))

    # Spark writes control characters with capital digits; a backslash before them may be an escaped one.
    lower = text
    for digits in ("0B", "0E", "0F", *(f"1{x}" for x in "ABCDEF")):
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*\\u00){digits}", f"$1{digits.lower()}")
    plain = F.when(text.rlike(r"\\u00[01][A-F]"), lower).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7E]"), F.array_join(F.transform(F.split(plain, ""), escaped), "")).otherwise(plain)


def canonical_json(value: Column, kind: T.StructType | T.ArrayType | T.MapType) -> Column:
    """The JSON text of a struct, array or map of any types: nulls as `null`, numbers as Spark writes them, NaN and infinities as texts."""
    return _ascii(F.to_json(_sorted(value, kind), {"ignoreNullFields": "false"}))


def canonical_parts(fields: dict[str, T.DataType], hole: str) -> tuple[Column, Column]:
    """The JSON object of columns of these names and types, as the texts before and after the value of the field `hole`."""
    part = lambda names: canonical_json(F.struct(*names), T.StructType([T.StructField(n, fields[n]) for n in names])) if names else F.lit("{}")
    first, last = [n for n in fields if n < hole], [n for n in fields if n > hole]
    before = F.concat(F.regexp_replace(part(first), r"\}$", ""), F.lit(f'{"," if first else ""}"{hole}":'))
    after = F.concat(F.lit("," if last else ""), F.substr(part(last), F.lit(2)))
    return before, after
