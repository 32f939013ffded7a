"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of the mix by weight, at most ``most_epochs``
times its size; what is above is shared again by weight.  A source first gets
its complete epochs, every document once for each; what then remains of the
target is filled with the documents of smallest exponential key
``-ln(u) / quality weight`` (Efraimidis and Spirakis, A-ES), in key order, by a
prefix sum against the token budget.  The document in which the budget ends
gives the words that fit, so that a source's sum is its target to the word.

The prefix sum is made in levels.  Keys are cut into ``BINS`` bins by
rank-preserving rounding; sums by source and coarse bin, then by the fine bins
of one coarse bin, find the bin in which the budget ends, and only that bin's
documents are put in order.  So a source that
holds a third of all rows is never sorted in one task.

Defined cases: a null or empty text has size 0 and target 0 words; sources go
by code point with null last, and null is a source of its own; rows that
repeat a ``doc_id`` are documents of their own, with ties in key broken by
size; no rows, no mix; columns that the mix adds replace those of their name; a document's quality weight comes from
``labels`` where it has one (``WEIGHT_OF_QUALITY``), else ``WEIGHT_UNKNOWN``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import keep, read, small, space_word_count, uniform

SOURCE_WEIGHTS = (3, 1, 2)
MIX_SHARE = 1.5
MOST_EPOCHS = 2
WEIGHT_OF_QUALITY = {1: 1.0, 0: 0.25}
WEIGHT_UNKNOWN = 0.5
BINS = 1 << 16
SEED = "mix"


def source_targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share: float = MIX_SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """From (source, source_size), one row a source: adds target.

    Sharing the excess again and again ends where every source has
    ``min(most_epochs * size, level * weight)`` with one common level; sources
    are capped in the order of cap / weight, so the level is found by running
    sums in that order instead of by rounds.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    t = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most_epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    # level if exactly the sources before this one are capped
    rest = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(order), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    t = t.withColumn("level", rest / weight_left).withColumn("nth", F.row_number().over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the first source, in that order, whose own cap is not below its level, sets the level for the rest
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("nth", "level"))).over(everything)["level"]
    return t.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, quality_weight: Column, *, weights=SOURCE_WEIGHTS, share: float = MIX_SHARE, most_epochs: int = MOST_EPOCHS, seed: str = SEED, bins: int = BINS, name: str = "mix", more: tuple[str, ...] = (), spread_of: tuple[float, ...] = (1.0, 0.5, 0.25)) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the columns ``more`` of every row of ``docs`` (doc_id, source, size, and what
    ``quality_weight`` needs).  spread_of: the weights there are; others change the size of bins and no result."""
    key = -F.log(uniform(seed, F.col("doc_id"))) / quality_weight
    # the mean of the keys' distribution functions, of all weights, keeps their order and spreads each weight's documents
    # over (0, 1): no bin has more of a source's documents than the number of weights times its share
    spread = sum((1 - F.exp(-F.col("key") * w) for w in spread_of), F.lit(0.0)) / len(spread_of)
    rows = keep(docs.select("doc_id", "source", "size", *more, key.alias("key")).withColumn("bin", F.least(F.floor(spread * bins), F.lit(bins - 1)).cast("int")), name)
    by_bin = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    targets = source_targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, most_epochs)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("budget", budget - F.col("epochs") * F.col("source_size"))
    # where the budget ends: first among the coarse bins, then among the fine ones of that bin
    step = max(2, round(bins**0.5))
    coarse = by_bin.groupBy("source", F.floor(F.col("bin") / step).cast("int").alias("coarse")).agg(F.sum("bin_size").alias("n"))
    budgets = targets.withColumnRenamed("source", "s")
    coarse = coarse.join(budgets, F.col("source").eqNullSafe(F.col("s"))).withColumn("before", _before("n", "coarse"))
    coarse = coarse.where("before <= budget AND before + n > budget").select("s", "source_size", "target", "epochs", "budget", "coarse", F.col("before").alias("base"))
    fine = by_bin.join(_few(coarse), F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("bin") / step) == F.col("coarse")))
    cut = fine.withColumn("before", F.col("base") + _before("bin_size", "bin")).where("before <= budget AND before + bin_size > budget")
    cut = keep(cut.select("s", F.col("bin").alias("cut_bin"), "before", "source_size", "target", "epochs", "budget"), f"{name}-cuts")
    targets = targets.withColumnRenamed("source", "s").select("s", "source_size", "target", "epochs")
    plain = rows.join(_few(targets), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plain = plain.join(_few(cut.select(F.col("s").alias("s"), "cut_bin", "before", "budget")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    whole = F.when(F.coalesce(F.col("bin") < F.col("cut_bin"), F.lit(False)), F.col("size")).otherwise(F.lit(0))
    outside = plain.where(~inside).select("doc_id", "source", "size", *more, "source_size", "target", (F.col("epochs") * F.col("size") + whole).alias("taken"))
    running = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = F.least("size", F.greatest(F.lit(0), F.col("budget") - F.col("before") - running))
    ends = plain.where(inside).withColumn("fits", fits).select("doc_id", "source", "size", *more, "source_size", "target", (F.col("epochs") * F.col("size") + F.col("fits")).alias("taken"))
    return outside.unionByName(ends).withColumn("target", F.round("target", 6))


def _before(amount: str, order: str) -> Column:
    """The source's sum of what stands before; over at most some hundred rows a source."""
    return F.coalesce(F.sum(amount).over(Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _few(table: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Tables of one row a source are broadcast up to a counted bound."""
    table = keep(table, "sources")
    return small(table, table.count(), most_rows)


def quality_of(labels: DataFrame) -> DataFrame:
    """label_id, quality: the best label of each document."""
    return labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))


def weighted(sized: DataFrame, labels: DataFrame) -> tuple[DataFrame, Column]:
    """``sized`` (doc_id, source, size) with each document's label, and its quality weight."""
    joined = sized.join(quality_of(labels), F.col("doc_id") == F.col("label_id"), "left")
    weight = F.lit(WEIGHT_UNKNOWN)
    for q, w in WEIGHT_OF_QUALITY.items():
        weight = F.when(F.col("quality") == q, F.lit(w)).otherwise(weight)
    return joined, weight


def mixed_documents(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents of which the mix takes words: all columns of ``docs`` and size, source_size, target, taken (in place of
    columns of these names).  A document is read taken / size times; a rest is its first words.  Rows equal in id, source
    and text share their words evenly; rows that only share the id are documents of their own."""
    plain = docs.drop("size", "source_size", "target", "taken")
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("__text"), space_word_count(F.col("text")).alias("size"))
    found = mix(*weighted(sized, labels.select("doc_id", "quality")), more=("__text",), **parameters)
    by_row = found.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), "__text")
    found = by_row.agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.expr("sum(taken) div count(1)").alias("taken"))
    found = keep(found.where("taken > 0"), "mixed")
    same = plain["doc_id"].eqNullSafe(found["__id"]) & plain["source"].eqNullSafe(found["__source"]) & (F.xxhash64(plain["text"]) == found["__text"])
    return plain.join(small(found, found.count(), 400_000), same).drop("__id", "__source", "__text")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    sized = read(spark, sf_dir, "documents").select("doc_id", "source", space_word_count(F.col("text")).alias("size"))
    found = mix(*weighted(sized, read(spark, sf_dir, "labels").select("doc_id", "quality")))
    return found.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mix_sources": op9_mix_sources}
_ROUNDS = 8
_SIZE = r"CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT)"
SQL = {
    "op9_mix_sources": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_SIZE} AS size FROM documents),
q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
k AS (SELECT d.*, -ln((CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE)
          / CASE quality WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS key FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT 0 AS n, source, source_size, weight, 0::DOUBLE AS target, false AS full_ FROM s
      UNION ALL
      SELECT n + 1, source, source_size, weight,
             CASE WHEN full_ THEN target ELSE least(2.0::DOUBLE * source_size, level * weight) END,
             full_ OR level * weight >= 2.0::DOUBLE * source_size
      FROM (SELECT *, (1.5::DOUBLE * sum(source_size) OVER (PARTITION BY n) - coalesce(sum(CASE WHEN full_ THEN target END) OVER (PARTITION BY n), 0))
                      / nullif(sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY n), 0) AS level FROM r) WHERE n < 64),
t AS (SELECT source, source_size, target, CAST(round(target) AS BIGINT) AS budget FROM r WHERE n = 64),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target, t.budget, CASE WHEN t.source_size > 0 THEN t.budget // t.source_size ELSE 0 END AS epochs,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM p"""
}
