"""Placeholders for missing values: found, counted and replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.types import is_geometry

#: The placeholders looked for by default.
SENTINELS = {
    "str": ["NA", "-", "--", "N/A", "Missing", "Not Applicable", "Not Available"],
    "int": [-9999, -999, -99, -1],
    "float": [-9999.99, -999.99, -99.99, -99.0, -1.0],
    "datetime": ["0000-00-00", "0001-01-01", "1900-01-01", "0"],
}
_KINDS = {
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "str": (T.StringType,),
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
}


def bucket(df: DataFrame, kind: str) -> list[str]:
    """Columns of a kind: int, float, str, datetime or all."""
    if kind == "all":
        return df.columns
    return [f.name for f in df.schema if isinstance(f.dataType, _KINDS[kind])]


def _parsed(kind: str, value):
    """The sentinel as a value of its kind, or None if it isn't one."""
    try:
        if kind == "int":
            return int(value)
        if kind == "float":
            return float(value)
    except (TypeError, ValueError):
        return None
    return str(value)


class Matcher:
    """Decides which cells hold which sentinel; extrema of numeric columns are found in one pass."""

    def __init__(self, df: DataFrame, extrema: bool = True, case_sensitive: bool = False, float_eps: float = 1e-9):
        self.df, self.case_sensitive, self.eps = df, case_sensitive, float_eps
        numeric = bucket(df, "int") + bucket(df, "float")
        self.extremes: dict[str, tuple] | None = None
        if extrema:
            row = df.agg(F.lit(0), *[f(F.col(f"`{c}`")) for c in numeric for f in (F.min, F.max)]).first()
            self.extremes = {c: (row[1 + 2 * i], row[2 + 2 * i]) for i, c in enumerate(numeric)}

    def _extreme(self, name: str, value: float, eps: float) -> bool:
        if self.extremes is None:
            return True
        return any(x is not None and abs(float(x) - value) <= eps + 1e-5 * abs(value) * (eps > 0) for x in self.extremes[name])

    def match(self, name: str, kind: str, value) -> Column | None:
        """A condition on the column, or None where the sentinel can't be in it."""
        c, parsed = F.col(f"`{name}`"), _parsed(kind, value)
        if parsed is None:
            return None
        if kind == "int":
            return (c == F.lit(parsed)) if self._extreme(name, parsed, 0) else None
        if kind == "float":
            return (F.abs(c - F.lit(parsed)) < self.eps) if self._extreme(name, parsed, self.eps) else None
        if kind == "str":
            text = F.coalesce(c, F.lit(""))
            return (text == parsed) if self.case_sensitive else (F.lower(text) == parsed.lower())
        moment = F.lit(parsed).try_cast("timestamp_ntz" if not isinstance(self.df.schema[name].dataType, T.DateType) else "date")
        return F.when(F.lit(parsed).rlike(r"^\d{4}-"), c == moment)


def _usable(df: DataFrame, drop_geometry: bool) -> DataFrame:
    return df.drop(*[f.name for f in df.schema if is_geometry(f)]) if drop_geometry else df


def codes(df: DataFrame, sentinels: dict | None = None, *, keep: list[str] = (), float_eps: float = 1e-9, extrema: bool = True, case_sensitive: bool = False, drop_geometry: bool = True) -> tuple[DataFrame, dict[int, str]]:
    """Each cell as a code, and what codes stand for: 0 missing, 1 not missing, from 2 on a sentinel each,
    in order, for kinds that have columns.  Of sentinels in one cell the last counts.  ``keep`` columns stay as they are."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"not a DataFrame: {type(df).__name__}")
    df = _usable(df, drop_geometry)
    matcher = Matcher(df, extrema, case_sensitive, float_eps)
    legend, found = {0: "Missing", 1: "Not Missing"}, {c: [] for c in df.columns}
    for kind, values in (SENTINELS if sentinels is None else sentinels).items():
        names = bucket(df, kind) if kind in _KINDS else []
        for value in values if names else ():
            code = len(legend)
            legend[code] = f"{kind}: {value}"
            for name in names:
                if (hit := matcher.match(name, kind, value)) is not None:
                    found[name].append((code, hit))
    columns = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        code = F.when(c.isNull(), 0).otherwise(1)
        for k, hit in found[name]:
            code = F.when(F.coalesce(hit, F.lit(False)), k).otherwise(code)
        columns.append(c if name in keep else code.cast("byte").alias(name))
    return df.select(*columns), legend


def long_codes(coded: DataFrame, legend: dict[int, str], keep: list[str] = ()) -> DataFrame:
    """keep..., variable, code, label: the heat map as rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("int").alias("code")) for c in coded.columns if c not in keep]))
    labels = F.create_map(*[x for k, v in legend.items() for x in (F.lit(k), F.lit(v))])
    return coded.select(*keep, pairs.alias("p")).select(*keep, "p.variable", "p.code", labels[F.col("p.code")].alias("label"))


def summary(coded: DataFrame, legend: dict[int, str], keep: list[str] = ()) -> DataFrame:
    """variable, code, label, n of all codes but 'not missing'."""
    return long_codes(coded.drop(*keep), legend).where("code <> 1").groupBy("variable", "code", "label").agg(F.count(F.lit(1)).alias("n"))


def used(coded: DataFrame, legend: dict[int, str], keep: list[str] = ()) -> list[str]:
    """The sentinels that occur, in order; what can be replaced."""
    found = long_codes(coded.drop(*keep), legend).where("code > 1").select("code").distinct().collect()
    return [legend[k] for k in sorted(r[0] for r in found)]


def resolve(df: DataFrame, sentinels: list[str], *, float_eps: float = 1e-9, extrema: bool = True, case_sensitive: bool = False) -> DataFrame:
    """The data with the chosen sentinels ("kind: value") missing; all rows, one projection."""
    if not sentinels:
        return df
    matcher = Matcher(df, extrema, case_sensitive, float_eps)
    hits: dict[str, list[Column]] = {}
    for entry in sentinels:
        kind, _, value = entry.partition(": ")
        for name in bucket(df, kind):
            if (hit := matcher.match(name, kind, value)) is not None:
                hits.setdefault(name, []).append(F.coalesce(hit, F.lit(False)))
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name in hits:
            any_hit = hits[f.name][0]
            for h in hits[f.name][1:]:
                any_hit = any_hit | h
            c = F.when(~any_hit, c).alias(f.name, metadata=f.metadata)
        columns.append(c)
    return df.select(*columns)
