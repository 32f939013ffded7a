"""Semantic column types, carried as schema metadata.

Spark drops a column's metadata in every expression, so each operator that
changes a column puts its metadata on again with ``typed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

KEY = "semantic"
SEMANTICS = ("cyclic", "text", "nominal", "ordered", "geometry", "basket")
#: Friendly names offered as conversion targets.
TYPE_CHOICES = ("decimal", "integer", "boolean", "date", "datetime", "time", "text", "nominal", "ordered", "cyclic", "basket", "code", "object")
LABELS = {"integer": "int", "decimal": "dec", "boolean": "log", "datetime": "dte", "date": "dte", "code": "cde", "text": "txt", "nominal": "nom", "ordered": "ord", "cyclic": "cyc", "basket": "bkt", "geometry": "geo", "object": "obj"}

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DECIMALS = (T.FloatType, T.DoubleType, T.DecimalType)


def meta(field: T.StructField) -> dict:
    return dict(field.metadata or {})


def friendly(field: T.StructField) -> str:
    """The friendly type name of a column: its semantic type, else by storage."""
    semantic = meta(field).get(KEY)
    if semantic in SEMANTICS:
        return semantic
    kind = field.dataType
    if isinstance(kind, T.ArrayType):
        return "basket"
    if isinstance(kind, T.StringType):
        return "code"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, _INTEGERS):
        return "integer"
    if isinstance(kind, _DECIMALS):
        return "decimal"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "interval"
    return "object"


def label(field: T.StructField) -> str:
    """The three-letter label; types without one show their storage type."""
    return LABELS.get(friendly(field), field.dataType.simpleString())


def family(field: T.StructField) -> set[str]:
    """All names by which select_dtypes finds a column."""
    name = friendly(field)
    names = {name, field.dataType.simpleString(), label(field)}
    if isinstance(field.dataType, _INTEGERS + _DECIMALS):
        names |= {"number", "numeric"}
    if isinstance(field.dataType, T.StringType):
        names |= {"string", "str", "object"}
    if name in ("nominal", "ordered"):
        names |= {"category"}
    if name == "date":
        names |= {"datetime"}
    return names


def typed(column: Column, name: str, semantic: str | None = None, **more) -> Column:
    """``column`` under ``name`` with semantic metadata."""
    return column.alias(name, metadata={KEY: semantic, **more} if semantic else {})


def retype(df: DataFrame, name: str, semantic: str | None, **more) -> DataFrame:
    """Only the metadata of a column changes."""
    return df.withMetadata(name, {KEY: semantic, **more} if semantic else {})


def is_cyclic(field: T.StructField) -> bool:
    return friendly(field) == "cyclic"


def is_text(field: T.StructField) -> bool:
    return friendly(field) == "text"


def is_list(field: T.StructField) -> bool:
    return friendly(field) == "basket"


def is_geometry(field: T.StructField) -> bool:
    return friendly(field) == "geometry"
