"""Strict JSON reading: one value, nothing after it, no relaxed syntax.

Two things that Spark's parser refuses are read all the same, as most JSON readers do: of a key that an
object repeats the last value counts, and NaN, Infinity and -Infinity are numbers. Objects that
repeat a key inside the value of a wanted key are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# try_parse_json stops after the first complete value. Wrapping the text as the first
# of two array elements makes any trailing text push the marker out of its place.
_MARKER = "␟end-of-value␟"
_NO_NUMBER = r"\b(?:NaN|Infinity)\b"
_DOUBLE_QUOTES = {"allowSingleQuotes": "false"}


def parse(text: Column, keys: Sequence[str]) -> Column:
    """VARIANT array with the value in front, or NULL when the text is not JSON. `keys` are the keys of
    an object that the caller reads; others may be missing from the result."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARKER}"]')))
    plain = F.when(F.try_variant_get(wrapped, "$[1]", "string") == _MARKER, wrapped)
    return F.coalesce(plain, _refused(text, keys))


def _refused(text: Column, keys: Sequence[str]) -> Column:
    """Values with a repeated key or NaN. Their syntax is tested with such numbers replaced: the text
    has to be one element of a list whose second element is known."""
    zeroed = F.regexp_replace(text, _NO_NUMBER, "0")
    single = F.json_array_length(F.concat(F.lit("["), zeroed, F.lit(",0]"))) == 2
    objects = F.from_json(F.concat(F.lit("["), text, F.lit(",{}]")), "array<map<string,variant>>", _DOUBLE_QUOTES)
    entries = F.map_entries(F.get(objects, F.lit(0)))
    last = F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.try_element_at(
        F.filter(entries, lambda e: e["key"] == k), F.lit(-1)))
    value = F.map_from_entries(F.filter(last, lambda e: e.isNotNull()))
    elements = F.from_json(F.concat(F.lit("["), text, F.lit(',""]')), "array<string>", _DOUBLE_QUOTES)
    start = F.regexp_extract(text, r"^[ \t\n\r]*([\[{NI-])", 1)
    return F.when(single, F.when(
        (start == "{") & objects.isNotNull(), F.to_variant_object(F.array(value)))
        .when((start == "[") & elements.isNotNull(), F.parse_json(F.lit("[[]]")))
        .when(start.isin("N", "I", "-") & elements.isNotNull(), F.parse_json(F.lit("[0e0]"))))


def kind(parsed: Column, path: str = "") -> Column:
    """Type name of the value: OBJECT, ARRAY, STRING, VOID, ... NULL when absent."""
    schema = F.schema_of_variant(F.try_variant_get(parsed, "$[0]" + path, "variant"))
    return F.regexp_extract(schema, "^[A-Z]+", 0)


def has_keys(parsed: Column, keys: tuple[str, ...]) -> Column:
    present = [F.try_variant_get(parsed, f"$[0].{k}", "variant").isNotNull() for k in keys]
    out = present[0]
    for p in present[1:]:
        out = out & p
    return out


def get(parsed: Column, path: str, type_name: str) -> Column:
    return F.try_variant_get(parsed, "$[0]." + path, type_name)
