"""Connected components of an edge table, without bringing edges to one place.

Large-star and small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond") point every node at the least node that it reaches in
a number of rounds that follows the logarithm of the longest path.  Each round
is two aggregations and two joins, written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs: node, root for each node that has an edge and isn't itself the least of its component."""
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if not now[0] or now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        e = keep(large, "large-star")
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = keep(small, "small-star")
