"""Exact duplicates by distributed MSD radix partitioning.

A text is read as its byte length followed by its bytes, and groups of rows
are split by successive stretches of those bytes.  A group stops when it is a
singleton or when its bytes are used up; equal bytes, not a digest, put two
texts into one group.  The stretches grow fourfold, so the number of rounds
follows the logarithm of the longest repeated text.

* Each split is an aggregation with map-side partial sums: a group that holds
  a third of all rows becomes one row for each task before the shuffle.
* Only rows of groups of two or more go on, with the bytes not yet read.
* The split groups are joined back to their rows; beyond a counted bound they
  are not broadcast but merged, and adaptive execution splits a hot key.

Defined cases: a null text is the empty text; a null ``doc_id`` is smaller
than all others; rows that repeat both id and text are one document seen
twice and share one answer; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep, small

FIRST_BYTES = 64
GROWTH = 4
WIDEST_BYTES = 1 << 20
#: Broadcast split groups only up to so many bytes of keys.
BROADCAST_BYTES = 16 << 20


def _groups(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, int]:
    """The groups of two or more rows, numbered, and how many."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1")
    found = keep(found.withColumn("new_group", F.monotonically_increasing_id()), name)
    return found, found.count()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = FIRST_BYTES, also: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size and the columns of ``also`` (expressions over ``docs``)."""
    also = also or {}
    carried = list(also)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("rest"), *[c.alias(k) for k, c in also.items()])
    rows = rows.withColumn("left", F.octet_length("rest"))
    keys, width, done, level = ["left", "stretch"], first_bytes, [], 0
    while True:
        rows = rows.withColumn("stretch", F.expr(f"substring(rest, 1, {width})"))
        groups, n = _groups(rows, keys, f"radix-groups-{level}")
        groups = small(groups, n * (width + 64), BROADCAST_BYTES)
        on = [rows[k].eqNullSafe(groups[k]) for k in keys]
        done.append(rows.join(groups, on, "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *carried))
        if not n:
            break
        again = rows.join(groups, on, "inner").select(
            rows["doc_id"], F.expr(f"substring(rest, {width + 1})").alias("rest"), *[rows[c] for c in carried], (rows["left"] - width).alias("left"), "new_group", "group_size", "keep_id"
        )
        again = keep(again, f"radix-rows-{level}")
        done.append(again.where("left <= 0").select("doc_id", "keep_id", "group_size", *carried))
        rows = again.where("left > 0").select("doc_id", "rest", *carried, "left", F.col("new_group").alias("group"))
        keys, width, level = ["group", "stretch"], min(width * GROWTH, WIDEST_BYTES), level + 1
        if rows.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids whose rows stay: of equal texts the largest."""
    return exact_groups(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id").distinct()


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    found = exact_groups(docs, also={"text_sha256": sha})
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
SQL = {
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
