"""Conversions of columns between semantic types, in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.dataset import Dataset
from plumbline.functions import basket as B
from plumbline.functions import geometry as G
from plumbline.functions import text as X
from plumbline.functions.cyclic import Cycle
from plumbline.functions.numbers import DATE_FORMATS, finite, to_number, to_timestamp
from plumbline.operators import evidence as E
from plumbline.types import friendly, meta, typed


def levels_of(df: DataFrame, name: str) -> list[str]:
    """The sorted distinct values of a column, as text; levels when none are given."""
    return [r[0] for r in df.select(F.col(f"`{name}`").cast("string").alias("x")).where("x IS NOT NULL").distinct().orderBy("x").collect()]


def as_cyclic(field: T.StructField, period: float | None = None, categories=None) -> Column:
    """Ordered columns go round in their order; numbers need a period."""
    column = F.col(f"`{field.name}`")
    kind, levels = friendly(field), meta(field).get("levels")
    if isinstance(field.dataType, T.NumericType):
        if period is None:
            raise TypeError("a numeric column needs a period")
        cycle = Cycle(period=period)
    elif categories is not None or kind == "ordered":
        if period is not None:
            raise TypeError("ordered categories have no other period")
        cycle = Cycle(categories=tuple(categories if categories is not None else levels))
    elif kind == "nominal":
        raise TypeError("categories without an order can't be cyclic")
    else:
        raise TypeError(f"{field.dataType.simpleString()} can't be cyclic without categories")
    return cycle.typed(cycle.values(column), field.name)


def as_list(df: DataFrame, name: str, *, delimiter: str | None = None, delimiters=B.DEFAULT_DELIMITERS, allow_json: bool = True, strip_items: bool = True, infer: bool = True) -> Column:
    """A column as lists; blank text is missing, text that can't be split is an error."""
    field = df.schema[name]
    column = F.col(f"`{name}`")
    if isinstance(field.dataType, T.ArrayType):
        return typed(column, name, "basket")
    if not isinstance(field.dataType, T.StringType):
        raise TypeError(f"cannot convert {field.dataType.simpleString()} to a list value")
    json = False
    if delimiter is None:
        if not infer:
            raise TypeError("non-collection input requires a delimiter or infer=True")
        found = E.list_evidence(df, name, delimiters=delimiters, allow_json=allow_json, strip_items=strip_items)
        if not found.matches:
            raise ValueError(f"data are not plausibly list-like: {found.reason}")
        json, delimiter = found.representation == "json-array", found.delimiter
    parsed = B.parse_json(column) if json else B.parse_delimited(column, delimiter, strip_items)
    blank = column.isNull() | column.rlike(r"^\s*$")
    what = "is not a JSON array" if json else f"cannot be parsed with {delimiter!r}"
    return typed(F.when(blank, None).when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(column, F.lit(f" {what}")))), name, "basket")


def to_date(df: DataFrame, name: str, formats=DATE_FORMATS, threshold: float = 0.95) -> Column:
    """Timestamps by the first format that fits nearly all values, else the first that fits any, else Spark's own reading."""
    column = F.col(f"`{name}`")
    if not isinstance(df.schema[name].dataType, T.StringType):
        return column.cast("timestamp_ntz").alias(name)
    filled = F.when(~column.rlike(r"^\s*$"), column)
    row = df.agg(F.count(filled), *[F.count(to_timestamp(column, f)) for f in formats]).first()
    n, fits = row[0], list(row[1:])
    chosen = next((f for f, k in zip(formats, fits, strict=True) if n and k / n >= threshold), None) or next((f for f, k in zip(formats, fits, strict=True) if k), None)
    parsed = to_timestamp(column, chosen) if chosen else F.trim(column).try_cast("timestamp")
    return parsed.cast("timestamp_ntz").alias(name)


def convert(df: DataFrame, name: str, target: str, *, order: str | list[str] | None = None, formats=DATE_FORMATS, period: float | None = None) -> Column:
    """The column as another type, under its own name."""
    field = df.schema[name]
    column, kind = F.col(f"`{name}`"), field.dataType
    as_string = F.when(column, "True").when(~column, "False") if isinstance(kind, T.BooleanType) else column.cast("string")
    levels = order.split(",") if isinstance(order, str) else order
    if target == "decimal":
        return to_number(column, kind).alias(name, metadata={})
    if target == "integer":
        number = finite(F.rint(to_number(column, kind)))
        return (column.cast("long") if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else number.try_cast("long")).alias(name, metadata={})
    if target == "boolean":
        if isinstance(kind, T.NumericType):
            return (column != 0).alias(name, metadata={})
        return column.try_cast("boolean").alias(name, metadata={})
    if target in ("date", "datetime"):
        found = to_date(df, name, formats)
        return found.cast("date").alias(name, metadata={}) if target == "date" and not _has_time(formats) else found
    if target == "time":
        return F.date_format(to_date(df, name, (*formats, "%H:%M:%S", "%H:%M")), "HH:mm:ss").alias(name, metadata={})
    if target == "text":
        return X.as_text(field, errors="coerce")
    if target == "nominal":
        return typed(as_string, name, "nominal", levels=levels or levels_of(df, name))
    if target == "ordered":
        levels = levels or meta(field).get("levels") or levels_of(df, name)
        return typed(F.when(as_string.isin(levels), as_string), name, "ordered", levels=levels)
    if target == "cyclic":
        if isinstance(kind, T.NumericType):
            if period is None:
                period = E.cyclic_evidence(df, name).period
            return as_cyclic(field, period)
        cats = levels or meta(field).get("levels") or levels_of(df, name)
        cycle = Cycle(categories=tuple(cats))
        return cycle.typed(cycle.values(as_string), name)
    if target in ("list", "basket"):
        return as_list(df, name)
    if target == "geometry":
        found = E.geometry_evidence(df, name)
        if not found.matches:
            raise ValueError(f"data are not plausibly geometry-like: {found.reason}")
        if found.representation == "geometry-dtype":
            return column
        hexed = found.representation == "wkb" and isinstance(kind, T.StringType)
        return G.as_geometry(column, name, "wkb-hex" if hexed else found.representation)
    if target == "code":
        return as_string.alias(name, metadata={})
    if target == "object":
        return column.alias(name, metadata={})
    raise ValueError(f"Unsupported conversion type: {target}")


def _has_time(formats) -> bool:
    return any("%H" in f or "%I" in f for f in formats)


@dataclass(frozen=True)
class Change:
    """What becomes of one column."""

    name: str
    new_name: str | None = None
    new_type: str | None = None
    order: str | None = None
    period: float | None = None


def modify(data: Dataset, changes: list[Change], formats=DATE_FORMATS) -> Dataset:
    """All conversions in one projection, then all renames; roles follow their columns."""
    by_name = {c.name: c for c in changes}
    if missing := set(by_name) - set(data.columns):
        raise KeyError(sorted(missing)[0])
    df = data.df
    columns = []
    for f in df.schema:
        change = by_name.get(f.name)
        columns.append(convert(df, f.name, change.new_type, order=change.order, formats=formats, period=change.period) if change and change.new_type else F.col(f"`{f.name}`"))
    changed = data.with_df(df.select(*columns))
    return changed.rename({c.name: c.new_name for c in changes if c.new_name})


def schema_table(data: Dataset) -> DataFrame:
    """A row for each column: name, new name, type, new type, order, new order, first role."""
    from plumbline.roles import Role

    rank = list(Role)
    rows = []
    for f in data.df.schema:
        order = ",".join(meta(f).get("levels") or meta(f).get("categories") or [])
        roles = sorted(data.roles.get(f.name), key=rank.index)
        rows.append((f.name, f.name, friendly(f), friendly(f), order, order, roles[0].value if roles else None))
    return data.df.sparkSession.createDataFrame(rows, "orig_name string, new_name string, orig_type string, new_type string, orig_order string, new_order string, role string")


def concat(parts: list[DataFrame], name: str | None = None) -> DataFrame:
    """Rows of several frames; cyclic columns must be of one cycle, list items are widened."""
    if not parts:
        raise ValueError("nothing to concatenate")
    first = parts[0]
    for other in parts[1:]:
        for f in first.schema:
            if name in (None, f.name) and f.name in other.columns:
                g = other.schema[f.name]
                if "cyclic" in (friendly(f), friendly(g)) and meta(f) != meta(g):
                    raise TypeError(f"{f.name} has different cycles")
    out = first
    for other in parts[1:]:
        out = out.unionByName(other)
    return out
