"""List fields that went through text: a;b, JSON, Python's own form, or commas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tidy(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: F.trim(x.cast("string"))), lambda x: x.isNotNull() & (x != ""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_list(text: Column, commas: bool = True) -> Column:
    """array<string>; null and blank give an empty array."""
    value = F.trim(F.coalesce(text, F.lit("")))
    json = F.from_json(F.when(value.startswith("["), value), "array<string>")
    quoted = F.regexp_replace(F.regexp_replace(value, r"^\[|\]$", ""), r"""^\s*['"]|['"]\s*$|['"]?\s*,\s*['"]""", ";")
    fallback = F.split(value, ",") if commas else F.array(value)
    return _tidy(
        F.when(value == "", F.array().cast("array<string>"))
        .when(value.startswith("[") & json.isNotNull() & ~value.contains("'"), json)
        .when(value.startswith("["), F.split(quoted, ";"))
        .when(value.contains(";"), F.split(value, ";"))
        .otherwise(fallback)
    )


def or_unknown(items: Column) -> Column:
    return F.when(F.size(items) > 0, items).otherwise(F.array(F.lit("unknown")))


def primary(items: Column) -> Column:
    return F.coalesce(F.get(items, F.lit(0)), F.lit("unknown"))


def as_text(items: Column) -> Column:
    return F.array_join(items, "; ")
