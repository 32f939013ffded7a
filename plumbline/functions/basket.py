"""Columns of lists of items."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiters that are tried.
DEFAULT_DELIMITERS = (",", "|", ";", "\t", "%")


def lengths(column: Column) -> Column:
    return F.when(column.isNotNull(), F.size(column))


def contains(column: Column, item) -> Column:
    """Whether the list holds the item; missing only where the list is."""
    item = F.lit(item)
    return F.when(column.isNotNull(), F.exists(column, lambda x: x.eqNullSafe(item)))


def equals(column: Column, other) -> Column:
    return column.eqNullSafe(other if isinstance(other, Column) else F.array(*[F.lit(x) for x in other]))


def from_set(column: Column) -> Column:
    """The list of a set: its items once, in order."""
    return F.array_sort(F.array_distinct(column))


def explode(df: DataFrame, name: str, item: str = "item", place: str | None = None) -> DataFrame:
    """One row for each item, the other columns repeated; a missing or empty list gives one missing item."""
    others = [F.col(c) for c in df.columns if c != name]
    if place:
        return df.select(*others, F.posexplode_outer(name).alias(place, item))
    return df.select(*others, F.explode_outer(name).alias(item))


def items(df: DataFrame, name: str) -> list:
    """The distinct items in order; as many as there will be columns."""
    return [r[0] for r in df.select(F.explode(name).alias("x")).where("x IS NOT NULL").distinct().orderBy("x").collect()]


def indicators(df: DataFrame, name: str, found: list | None = None) -> DataFrame:
    """One boolean column for each distinct item instead of the list; False where the list is missing.
    One pass for the items, none of the rows is shuffled for the flags."""
    found = items(df, name) if found is None else found
    flags = [F.coalesce(contains(F.col(name), i), F.lit(False)).alias(str(i)) for i in found]
    return df.select(*[c for c in df.columns if c != name], *flags)


def parse_delimited(column: Column, delimiter: str, strip_items: bool = True) -> Column:
    """A list from delimited text; missing if any item is empty.  One-character delimiters respect double quotes
    and read the first line only."""
    if not delimiter:
        raise ValueError("a delimiter can't be empty")
    d = re.escape(delimiter)
    if len(delimiter) > 1:
        parts = F.split(column, d)
    else:
        line = F.regexp_extract(column, r'^((?:[^"\n]|"[^"]*"?)*)', 1)
        fields = F.regexp_extract_all(line, F.lit(rf'(?:^|{d}) *("(?:[^"]|"")*"|[^{d}]*)'), F.lit(1))
        quoted = F.transform(fields, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
        parts = F.when(F.contains(column, F.lit('"')), quoted).otherwise(F.split(F.regexp_extract(column, r"^([^\n]*)", 1), d))
    if strip_items:
        parts = F.transform(parts, lambda x: F.trim(x))
    return F.when(~F.exists(parts, lambda x: x == ""), parts)


def parse_json(column: Column) -> Column:
    """A list of strings from a JSON array; missing for anything else."""
    return F.when(column.rlike(r"^\s*\["), F.from_json(column, "array<string>"))


def is_json_list(column: Column) -> Column:
    value = F.try_parse_json(column)
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def prose_like(column: Column, delimiter: str | None = None) -> Column:
    """Ten words or more, a sentence end, or six words with comma and space as the delimiter."""
    words = F.size(F.regexp_extract_all(column, F.lit(r"\b[\w'-]+\b"), F.lit(0)))
    found = (words >= 10) | column.rlike(r"[.!?](\s|$)")
    if delimiter == ",":
        found = found | (F.contains(column, F.lit(", ")) & (words >= 6))
    return found
