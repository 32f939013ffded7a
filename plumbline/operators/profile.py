"""Column profiles: one aggregation over all columns, then a row for each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.types import friendly, is_geometry, label

#: Columns aggregated in one job; wider tables take several, which keeps generated code small.
BATCH = 40


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def long_table(df: DataFrame, measures: dict[str, object], columns: list[str] | None = None) -> DataFrame:
    """A row for each column with the given measures: name -> function of (column, field) to an aggregate."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    out = None
    for at in range(0, len(fields), BATCH):
        part = fields[at : at + BATCH]
        rows = [F.struct(F.lit(f.name).alias("variable"), *[m(_c(f.name), f).alias(k) for k, m in measures.items()]) for f in part]
        found = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
        out = found if out is None else out.unionByName(found)
    return out


def counts(df: DataFrame) -> DataFrame:
    """variable, label, non_null, nulls, distinct_values."""
    hashable = lambda f: not isinstance(f.dataType, (T.MapType, T.VariantType))
    return long_table(df, {
        "label": lambda c, f: F.lit(label(f)),
        "non_null": lambda c, f: F.count(c),
        "nulls": lambda c, f: F.count(F.lit(1)) - F.count(c),
        "distinct_values": lambda c, f: F.count_distinct(c) if hashable(f) else F.lit(None).cast("long"),
    })


def describe_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """variable, count, unique, top, freq of string columns; of equal frequencies the smallest value is on top."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    # one pass: (column, value) pairs, counted before they are shuffled
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), _c(c).alias("value")) for c in columns])).alias("p")).select("p.*").where("value IS NOT NULL")
    freq = pairs.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "value"))
    return freq.groupBy("variable").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("best")).select("variable", "count", "unique", F.col("best.value").alias("top"), (-F.col("best.n")).alias("freq"))


def extrema(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, low, high of numeric columns as doubles."""
    return long_table(df.select(*[_c(c).cast("double").alias(c) for c in columns]), {"low": lambda c, f: F.min(c), "high": lambda c, f: F.max(c)})


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, spread = 1 - share of the most frequent value."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), _c(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*").where("value IS NOT NULL")
    return pairs.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("variable").agg((1 - F.max("n") / F.sum("n")).alias("spread"))


def is_key(df: DataFrame, columns: list[str], separator: str = "|") -> DataFrame:
    """rows, keys, is_unique of a composite key; a missing part counts as empty text."""
    key = F.concat_ws(separator, *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in columns])
    grouped = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.max("n") <= 1, F.lit(True)).alias("is_unique"))


def info(df: DataFrame) -> DataFrame:
    """Class, columns, distinct types and estimated bytes of a dataset."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    kinds = len({f.dataType.simpleString() for f in df.schema})
    return df.sparkSession.createDataFrame([(type(df).__name__, len(df.columns), kinds, size)], "class string, n_columns long, n_types long, estimated_bytes decimal(38,0)" if size >= 1 << 63 else "class string, n_columns long, n_types long, estimated_bytes long")


def size_text(df: DataFrame, kind: str = "DataFrame", limit: int | None = None) -> str:
    n = df.count()
    limited = f", limited to first {limit}" if limit is not None and n > limit else ""
    return f"({kind}: Obs = {n}, Vars = {len(df.columns)}{limited})"


def geometry_summary(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(kind, n) and (crs, active, minx, miny, maxx, maxy) of a geometry column."""
    from plumbline.functions import geometry as G

    meta = df.schema[name].metadata or {}
    b = df.select(G.bounds(_c(name)).alias("b"))
    box = b.agg(F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))
    kinds = df.where(_c(name).isNotNull()).groupBy(G.kind_of(_c(name)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds, box.select(F.lit(meta.get("crs")).alias("crs"), F.lit(bool(meta.get("active", True))).alias("active"), "*")


def structure(df: DataFrame) -> list[str]:
    """Lines that describe rows, columns and each column's type, missing and distinct values."""
    countable = lambda f: not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) and not is_geometry(f)
    fields = list(df.schema)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(_c(f.name).isNull()).alias(f"m{i}"))
        if countable(f):
            aggs.append(F.count_distinct(_c(f.name)).alias(f"u{i}"))
    row = df.agg(*aggs).first()
    lines = [f"rows: {row['rows']}", f"columns: {len(fields)}"]
    lines += [f"{f.name}: dtype={friendly(f)}, missing={row[f'm{i}']}, unique={row[f'u{i}'] if countable(f) else 'NA'}" for i, f in enumerate(fields)]
    return lines


def structure_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """ord, line of a unified diff of two structures."""
    import difflib

    a, b = structure(before), structure(after)
    lines = list(difflib.unified_diff(a, b, "original", "modified", lineterm="")) or ["No committed modifications."]
    return before.sparkSession.createDataFrame(list(enumerate(lines)), "ord int, line string")


def variable_statistics(df: DataFrame, robust: bool = False) -> DataFrame:
    """variable, cardinality, centrality, spread, skew, comparable between variables.

    Numbers: mean and standard deviation, or median and scaled median deviation;
    population skewness.  Others: one minus the modal share.  Centrality and
    skew are divided by their largest size over all variables, a number's spread
    by the size of its own centre, one at least.
    """
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    others = [f.name for f in df.schema if f.name not in numeric and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    lists = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    none = F.lit(None).cast("double")
    parts = []
    if numeric:
        finite = df.select(*[F.when(F.abs(_c(c).cast("double")) < float("inf"), _c(c).cast("double")).alias(c) for c in numeric])
        centre = F.median if robust else F.avg
        # population skewness from power sums of shifted values; a constant has none
        first = long_table(finite, {
            "cardinality": lambda c, f: F.try_divide(F.count_distinct(c), F.count(F.lit(1))),
            "centre": lambda c, f: centre(c),
            "sd": lambda c, f: F.stddev_samp(c) if not robust else none,
            "skew": lambda c, f: F.when((F.count(c) > 2) & (F.max(c) > F.min(c)), F.skewness(c)),
        })
        if robust:
            medians = finite.agg(*[F.median(c).alias(c) for c in numeric])
            medians = F.broadcast(medians.select(*[F.col(f"`{c}`").alias(f"__m_{i}") for i, c in enumerate(numeric)]))
            apart = finite.crossJoin(medians).select(*[F.abs(_c(c) - F.col(f"__m_{i}")).alias(c) for i, c in enumerate(numeric)])  # one row on that side
            mad = long_table(apart, {"mad": lambda c, f: F.median(c) * 1.4826}).withColumnRenamed("variable", "v")
            first = first.join(F.broadcast(mad), F.col("variable") == F.col("v")).withColumn("sd", F.col("mad")).drop("v", "mad")
        parts.append(first.select("variable", "cardinality", "centre", F.col("sd").alias("spread"), "skew", F.lit(True).alias("numeric")))
    if others:
        card = long_table(df.select(*[_c(c) for c in others]), {"cardinality": lambda c, f: F.try_divide(F.count_distinct(c), F.count(F.lit(1)))})
        modal = spread(df, others).withColumnRenamed("variable", "v")
        parts.append(card.join(F.broadcast(modal), F.col("variable") == F.col("v"), "left").select("variable", "cardinality", none.alias("centre"), "spread", none.alias("skew"), F.lit(False).alias("numeric")))
    if lists:
        parts.append(df.sparkSession.createDataFrame([(c, None, None, None, None, False) for c in lists], "variable string, cardinality double, centre double, spread double, skew double, numeric boolean"))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    every = Window.partitionBy(F.lit(1))  # a row for each variable
    scaled = lambda c: F.when(F.max(F.abs(c)).over(every) == 0, F.when(c.isNotNull(), 0.0)).otherwise(c / F.max(F.abs(c)).over(every))
    return table.select(
        "variable", "cardinality", scaled(F.col("centre")).alias("centrality"),
        F.when(F.col("numeric") & F.col("centre").isNotNull(), F.col("spread") / F.greatest(F.abs("centre"), F.lit(1.0))).otherwise(F.col("spread")).alias("spread"), scaled(F.col("skew")).alias("skew"),
    )
