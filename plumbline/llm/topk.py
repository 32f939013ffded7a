"""The k rows of largest key, exactly, without sorting rows in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 4096


def _cut(df: DataFrame, col: Column, k: int) -> tuple[int, int]:
    """(v, r): rows above v are fewer than k, and r of those with v make it k.  Passes over ``df`` count at most DIGITS bins."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    lo, hi = int(lo), int(hi)
    while True:
        width = max(1, -(-(hi - lo + 1) // DIGITS))
        inside = df.where((col >= lo) & (col <= hi))
        digit = F.floor((col - F.lit(lo)).cast("decimal(38,0)") / F.lit(width).cast("decimal(38,0)")).cast("int")
        for d, n in sorted(inside.groupBy(digit.alias("d")).count().collect(), reverse=True):
            if n >= k:
                lo, hi = lo + d * width, min(hi, lo + (d + 1) * width - 1)
                break
            k -= n
        if lo == hi:
            return lo, k


def top(df: DataFrame, k: int, key: str = "key", row_id: str = "doc_id") -> tuple[int, int | None]:
    """The least (key, id) of the k rows first by key descending, then id ascending: a row is in if
    key > v, or key = v and id <= t.  Keys are longs.  k must be from 1 to the number of rows with an id;
    rows equal in both stay together."""
    v, r = _cut(df, F.col(key), k)
    last, _ = _cut(df.where((F.col(key) == v) & F.col(row_id).isNotNull()), -F.col(row_id), r)
    return v, -last
