"""Numbers and dates in text, read as strictly as the type inference needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Decimal notation only: Spark's own cast would also take "1f", "2.5d" and the like.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
#: The date formats that conversion tries, in order.
DATE_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d %b %Y", "%d %B %Y", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S")
_JAVA = {"Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "j": "D", "z": "xx", "%": "%"}


def to_number(column: Column, kind: T.DataType) -> Column:
    """A double, or missing where the value isn't a number; not-a-number is missing."""
    if isinstance(kind, T.StringType):
        sign = F.when(column.rlike(r"^\s*-"), float("-inf")).otherwise(float("inf"))
        return F.when(column.rlike(NUMBER), F.trim(column).try_cast("double")).when(column.rlike(INFINITE), sign)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column.cast("double"))
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    return F.lit(None).cast("double")


def finite(column: Column) -> Column:
    """The value where it is neither infinite nor not-a-number."""
    return F.when(F.abs(column) < float("inf"), column)


def java_format(strptime: str) -> str:
    """The Java pattern of a strptime format; single letters take one digit or two, as strptime does."""
    out, i = "", 0
    while i < len(strptime):
        c = strptime[i]
        if c == "%":
            i += 1
            if i == len(strptime) or strptime[i] not in _JAVA:
                raise ValueError(f"unsupported date format: {strptime!r}")
            out += _JAVA[strptime[i]]
        else:
            out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
        i += 1
    return out


def to_timestamp(column: Column, strptime: str) -> Column:
    return F.try_to_timestamp(F.trim(column), F.lit(java_format(strptime)))


def decimal_places(column: Column) -> Column:
    """Apparent decimals of a number's text, trailing zeros dropped."""
    text = column.cast("string")
    plain = F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), text).otherwise(F.when(text.rlike(NUMBER), F.format_string("%.17f", text.try_cast("double"))))
    return F.when(plain.isNotNull(), F.length(F.regexp_replace(F.regexp_extract(plain, r"\.(\d*)\s*$", 1), "0+$", "")))


def half_even(column: Column, digits: int) -> Column:
    return F.bround(column, digits)
