"""Samples of exact size, repeatable, in the order of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES = ("all", "headtail", "random", "spaced")


def sample(df: DataFrame, order_by, n: int = 4, mode: str = "headtail", seed: int = 2025) -> DataFrame:
    """n rows: the first and last, random ones, or evenly spaced ones; everything if there are no more than n."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    n = max(int(n), 1)
    if mode == "all":
        return df
    if mode == "random":
        return random_rows(df, order, n, seed)
    if mode == "spaced":
        return spaced_rows(df, order, n)
    return head_tail(df, order, n)


def head_tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """n // 2 rows of smallest and n - n // 2 of largest key: two top-k plans, no global sort."""
    if df.limit(n + 1).count() <= n:
        return df.orderBy(*order)
    head = df.orderBy(*[F.asc(c) for c in order]).limit(n // 2)
    tail = df.orderBy(*[F.desc(c) for c in order]).limit(n - n // 2)
    return head.unionByName(tail).orderBy(*order)


def random_rows(df: DataFrame, order: list[str], n: int, seed: int = 2025) -> DataFrame:
    """n distinct rows by smallest seeded hash of the key: one top-k plan."""
    return df.orderBy(F.xxhash64(F.lit(seed), *order), *order).limit(n).orderBy(*order)


def with_range_part(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """``df`` with __part, the number of each row's part when rows are dealt in key order into parts of about equal size.

    The bounds come from a sample chosen by a hash of the key, so they are the same wherever the rows are evaluated (the
    sample of a range shuffle is not).  Rows equal in all of ``order`` share a part."""
    key = F.struct(*[F.col(f"`{c}`") for c in order])
    chosen = df.select(key.alias("key")).orderBy(F.xxhash64("key")).limit(20 * parts)  # a top-k plan
    bounds = chosen.agg(F.sort_array(F.collect_list("key")).alias("__keys")).select(F.expr(f"transform(sequence(1, {parts}), i -> get(__keys, int(i * size(__keys) div {parts})))").alias("__bounds"))
    steps = F.array(*[F.lit(1 << k) for k in range(parts.bit_length() - 1, -1, -1)])
    # binary search for how many of the bounds are at most the key
    part = F.aggregate(steps, F.lit(0), lambda a, w: F.when((a + w < parts) & (F.get("__bounds", a + w - 1) <= key), a + w).otherwise(a))
    return df.crossJoin(F.broadcast(bounds)).withColumn("__part", part).drop("__bounds")  # one row of bounds


def positions(df: DataFrame, order: list[str], name: str = "__row") -> DataFrame:
    """Rows numbered from 0 in key order, without bringing them together: each part of the key's range starts after the rows
    of the parts before it.  Rows equal in the key go by a hash of all their columns, so that a key which holds many rows is
    dealt as well; maps have no hash and are left out of it."""
    plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    keyed = df.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    full = [*order, "__tie"]
    dealt = with_range_part(keyed, full, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sizes = dealt.groupBy(F.col("__part").alias("__p")).count()  # a row for each part
    before = F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__p", before.alias("__before")))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*[F.col(f"`{c}`") for c in full]))
    found = dealt.withColumn("__in", inside).join(starts, F.col("__part") == F.col("__p"))
    return found.withColumn(name, (F.col("__before") + F.col("__in") - 1).cast("long")).drop("__tie", "__part", "__in", "__p", "__before")


def spaced_rows(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Rows at places floor(i (m - 1) / (limit - 1)) of the m rows in order."""
    m = df.count()
    if m <= limit:
        return df.orderBy(*order)
    numbered = positions(df, order)
    if limit == 1:
        return numbered.where("__row = 0").drop("__row")
    # row r is wanted if some i has floor(i (m-1) / (limit-1)) = r: the least i with i (m-1) >= r (limit-1)
    least = F.expr(f"(`__row` * {limit - 1} + {m - 2}) div {m - 1}")
    wanted = least * (m - 1) <= (F.col("__row") + 1) * (limit - 1) - 1
    return numbered.where(wanted).drop("__row").orderBy(*order)


def take(df: DataFrame, order: list[str], indices: list[int], allow_fill: bool = False) -> DataFrame:
    """Rows at the given places, in that order and as often as given; a place of -1 counts from the end, or is a
    row of missing values if ``allow_fill``."""
    spark = df.sparkSession
    m = df.count()
    bad = [i for i in indices if i >= m or i < (-1 if allow_fill else -m)]
    if bad:
        raise IndexError(bad[0])
    wanted = spark.createDataFrame([(n, i if i >= 0 or allow_fill else i + m) for n, i in enumerate(indices)], "__n long, __want long")
    found = F.broadcast(wanted).join(positions(df, order), F.col("__want") == F.col("__row"), "left")
    return found.orderBy("__n").drop("__n", "__want", "__row")
