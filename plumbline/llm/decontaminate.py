"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The windows of the benchmark (``k`` consecutive words, or the whole of a
shorter item) are hashed; every window of every document is hashed and looked
up in that set without a shuffle, in the scan's own stage.  A hash that is
found is then verified word by word against the benchmark window, so a
collision never counts.  Only hits are shuffled, by document.

The set (8-byte hashes) is broadcast in blocks of about ``BLOCK`` windows, a bound
that holds whatever the benchmark's size; more blocks mean more passes over the
text.

Defined cases: a null or wordless text has no words and no hits; a null or
wordless item has no windows; items that share a window are all counted; an answer
belongs to the id and the text, so rows that repeat an id with other texts have
answers of their own; empty tables give no hits; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import alnum_word_count, alnum_words, keep, read, small

WINDOW = 10
#: Hashes broadcast at once; at about 40 bytes each, 16 MB.
BLOCK = 400_000
#: Windows (about 200 bytes each) that are broadcast at most to verify hits.
BROADCAST_ROWS = 100_000


def windows(items: DataFrame, k: int = WINDOW) -> DataFrame:
    """Distinct windows: win (words), k, hash, item_ids."""
    items = items.select("item_id", alnum_words(F.col("text")).alias("ws")).withColumn("k", F.least(F.lit(k), F.size("ws"))).where("k > 0")
    at = items.select("item_id", "k", "ws", F.explode(F.sequence(F.lit(1), F.col("k") * 0 + F.size("ws") - F.col("k") + 1)).alias("at"))
    return at.select("item_id", "k", F.slice("ws", F.col("at"), F.col("k")).alias("win")).groupBy("win", "k").agg(F.collect_set("item_id").alias("item_ids")).withColumn("hash", F.xxhash64("win"))


def hits(docs: DataFrame, items: DataFrame, k: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Verified occurrences: doc_id, t (hash of the text), start (from 0), k, item_ids."""
    spark = docs.sparkSession
    table = keep(windows(items, k), "bench-windows")
    sizes = sorted(r[0] for r in table.select("k").distinct().collect())  # at most k values
    total = table.count()
    text = docs.select("doc_id", F.xxhash64("text").alias("t"), alnum_words(F.col("text")).alias("ws"))
    if not sizes:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t bigint, start int, k int, item_ids array<bigint>")
    hashed = [F.expr(f"CASE WHEN size(ws) >= {n} THEN transform(sequence(1, size(ws) - {n - 1}), i -> xxhash64(slice(ws, i, {n}))) ELSE array() END") for n in sizes]
    # the hashes of one length stand after those of another: (k, start) follow from the place
    length, start, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for n in sizes:
        here = F.greatest(F.size("ws") - (n - 1), F.lit(0))
        length = F.coalesce(length, F.when(F.col("place") < before + here, F.lit(n)))
        start = F.coalesce(start, F.when(F.col("place") < before + here, F.col("place") - before))
        before = before + here
    # exploding a plain column is compiled and doesn't copy the words for each row; the outer form keeps the optimizer
    # from deriving a filter that would split the text again for each word
    grams = text.select("doc_id", "t", "ws", F.concat(*hashed).alias("hs")).select("doc_id", "t", "ws", F.posexplode_outer("hs").alias("place", "h"))
    found = None
    blocks = -(-total // block)  # dealt by hash, so of even size
    hashes = table.select("hash", F.col("k").alias("wk")).distinct()
    for b in range(blocks):
        part = hashes.where(F.pmod("hash", F.lit(blocks)) == b)
        some = grams.join(F.broadcast(part), (grams["h"] == part["hash"]) & (length == part["wk"]))
        some = some.select("doc_id", "t", start.alias("start"), "hash", F.slice("ws", start + 1, F.col("wk")).alias("words"))
        found = some if found is None else found.unionByName(some)
    verify = small(table, total, BROADCAST_ROWS)
    return found.join(verify, (found["hash"] == verify["hash"]) & (F.col("words") == F.col("win"))).select("doc_id", "t", "start", "k", "item_ids")


def per_document(found: DataFrame) -> DataFrame:
    """doc_id, t, n_hit, n_items, items (ids as sorted strings) of documents with hits."""
    united = found.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("k")).alias("end")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col("item_ids").cast("array<string>"))))).alias("items"))
    n_hit = F.expr("aggregate(spans, named_struct('reach', 0, 'n', 0L), (a, s) -> named_struct('reach', greatest(a.reach, s.end), 'n', a.n + greatest(0, s.end - greatest(a.reach, s.start))), a -> a.n)")
    return united.select("doc_id", "t", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def remove_contaminated(docs: DataFrame, items: DataFrame, k: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns stay."""
    ids = keep(hits(docs, items, k).select(F.col("doc_id").alias("__hit_id"), F.col("t").alias("__hit")).distinct(), "contaminated")
    ids = small(ids, ids.count(), 500_000)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__hit_id"]) & (F.xxhash64(docs["text"]) == ids["__hit"]), "left_anti")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    items = read(spark, sf_dir, "benchmark").select("item_id", "text")
    found = per_document(hits(docs, items)).drop("spans")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), alnum_word_count(F.col("text")).alias("n_words"))
    joined = base.join(found.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("t")), "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), (n > 0).alias("contaminated"),
    )


QUERIES = {"op10_decontaminate": op10_decontaminate}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op10_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, win)),
w AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
