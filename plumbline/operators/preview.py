"""Previews: a sample with labelled headers, readable geometry and rounded decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.dataset import Dataset
from plumbline.functions import geometry as G
from plumbline.operators.sampling import sample
from plumbline.types import is_geometry, label, meta

FULL_ROWS = 10**4


def header(field: T.StructField) -> str:
    """A column's name over its type."""
    if not is_geometry(field):
        return f"{field.name}\n{label(field)}"
    more = [w for w in ("active" if meta(field).get("active") else None, meta(field).get("crs")) if w]
    return f"{field.name}\ngeometry" + "".join(f" [{w}]" for w in more)


def rounded(df: DataFrame, digits: int | None) -> DataFrame:
    """Floating columns rounded half to even; from -2 to 10 digits, None leaves them."""
    if digits is None:
        return df
    if not -2 <= digits <= 10:
        raise ValueError("digits must be from -2 to 10")
    return df.select(*[F.bround(F.col(f"`{f.name}`"), digits).alias(f.name, metadata=f.metadata) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`") for f in df.schema])


def preview(data: Dataset, order_by, *, full: bool = False, rows: int | None = None, digits: int | None = None, headers: bool = True) -> DataFrame:
    """First and last ten rows, or a large random sample, ready to be shown."""
    n = rows or (FULL_ROWS if full else 10)
    df = sample(data.df, order_by, n, "random" if full else "headtail")
    fields = list(df.schema)
    df = df.select(*[G.display(F.col(f"`{f.name}`"), full).alias(f.name) if is_geometry(f) else F.col(f"`{f.name}`") for f in fields])
    df = rounded(df, digits)
    return df.toDF(*[header(f) for f in fields]) if headers else df


def filtered(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Column filters of a grid: (low, high) for numbers and dates, part of the text, ignoring case, for strings."""
    for name, wanted in filters.items():
        c = F.col(f"`{name}`")
        if isinstance(wanted, (tuple, list)):
            low, high = wanted
            if low is not None:
                df = df.where(c >= low)
            if high is not None:
                df = df.where(c <= high)
        else:
            df = df.where(F.contains(F.lower(c.cast("string")), F.lit(str(wanted).lower())))
    return df
