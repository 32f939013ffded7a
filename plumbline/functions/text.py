"""Columns of prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.types import typed


def lengths(column: Column) -> Column:
    """Code points."""
    return F.char_length(column).cast("long")


def word_counts(column: Column) -> Column:
    """Runs without white space."""
    return F.regexp_count(column, F.lit(r"(?U)\S+")).cast("long")


def equals(column: Column, other) -> Column:
    """Missing equals missing; a literal that isn't a string equals nothing."""
    if not isinstance(other, Column):
        if other is not None and not isinstance(other, str):
            return F.lit(False)
        other = F.lit(other)
    return column.eqNullSafe(other)


def as_text(field: T.StructField, errors: str = "raise") -> Column:
    """A column as text; other storage is an error unless ``errors`` is coerce."""
    if errors not in ("raise", "coerce"):
        raise ValueError("errors must be raise or coerce")
    column = F.col(f"`{field.name}`")
    if not isinstance(field.dataType, T.StringType):
        if errors == "raise":
            raise TypeError(f"{field.name} holds {field.dataType.simpleString()}, not text")
        if isinstance(field.dataType, T.BooleanType):
            column = F.when(column, "True").when(~column, "False")
        else:
            column = column.cast("string")
    return typed(column, field.name, "text")


def qgrams(column: Column, q: int = 2) -> Column:
    """The q-grams of lower-cased text, repeats included; shorter text is its own; empty text has none."""
    if q < 1:
        raise ValueError("q must be 1 or more")
    low = F.lower(column)
    n = F.char_length(low)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - (q - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(q)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= q, F.array(low)).otherwise(grams)
