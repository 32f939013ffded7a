r"""License scans by diagonal voting.

Every run of ``k`` words of every document is hashed and joined with the
places of the same run in the license templates (a broadcast table whose size
is fixed by this file).  The words are compared as well, so a match is one of
words.  A match at document place p and template place q votes for diagonal
p - q.  Votes are summed by diagonal; diagonals that differ by at most
``DRIFT`` words and follow each other in the document are merged, which
bridges inserted, dropped or changed words; a merged span counts if it holds
at least ``COVER`` of the template's runs and is not much longer than the
template.  A merged span that is longer is cut where the template begins anew,
so copies of a short notice side by side count each by itself (the SQL drops
them all).  Of such spans that overlap in a document only the best covered
counts.  A base phrase counts only on one diagonal, complete.

Only matches are shuffled, by document and template.

Defined cases: a null or wordless text has no words, no labels and score 0;
an answer belongs to the id and the text, so rows that repeat an id with other
texts have answers of their own; labels found twice are listed once; of spans
with equal coverage that overlap all count; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import alnum_word_count, alnum_words, keep, read

K = 3
DRIFT = 4
COVER = 0.6
#: A merged span may be this many times as long as its template.
STRETCH = 1.5

#: Fixed values of the query: phrases that must stand word for word.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: License notices as they are published; label and text.
TEMPLATES = (
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("all-rights-reserved", "all rights reserved"),
)


def template_runs(spark: SparkSession, base=BASE, more=TEMPLATES, k: int = K) -> DataFrame:
    """tid, label, is_base, q, gram, n_runs: the places of all runs of ``k`` words."""
    rows = []
    for tid, (label, text, is_base) in enumerate([(a, b, True) for a, b in base] + [(a, b, False) for a, b in more]):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a template needs {k} words at least: {text!r}")
        rows += [(tid, label, is_base, q, words[q : q + k], len(words) - k + 1) for q in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "tid int, label string, is_base boolean, q int, gram array<string>, n_runs int").withColumn("th", F.xxhash64("gram"))


def matches(docs: DataFrame, runs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, t (hash of the text), tid, label, is_base, n_runs, p, q of all equal runs."""
    text = docs.select("doc_id", F.xxhash64("text").alias("t"), alnum_words(F.col("text")).alias("ws"))
    hashes = F.expr(f"CASE WHEN size(ws) >= {k} THEN transform(sequence(1, size(ws) - {k - 1}), i -> xxhash64(slice(ws, i, {k}))) ELSE array() END")
    # exploding a plain column is compiled and doesn't copy the words for each row; the outer form keeps the optimizer
    # from deriving a filter that would split the text again for each word
    grams = text.select("doc_id", "t", "ws", hashes.alias("hs")).select("doc_id", "t", "ws", F.posexplode_outer("hs").alias("p", "h"))
    # the words are compared only where the hashes agree: with a length of the other side that isn't a join key
    same = (grams["h"] == runs["th"]) & (F.slice("ws", F.col("p") + 1, F.size("gram")) == F.col("gram"))
    return grams.join(F.broadcast(runs), same).select("doc_id", "t", "tid", "label", "is_base", "n_runs", "p", "q")


def spans(found: DataFrame, k: int = K, drift: int = DRIFT, cover: float = COVER, stretch: float = STRETCH) -> DataFrame:
    """doc_id, t, label, is_base, start, end (word places), coverage of verified spans, and of base phrases."""
    votes = found.groupBy("doc_id", "t", "tid", "label", "is_base", "n_runs", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("qs"), F.min("p").alias("start"), (F.max("p") + k).alias("end"))
    votes = keep(votes, "license-votes")  # read twice below; the texts once
    base = votes.where(F.col("is_base") & (F.size("qs") == F.col("n_runs"))).select("doc_id", "t", "tid", "label", "is_base", "start", "end", F.lit(1.0).alias("coverage"))
    order = Window.partitionBy("doc_id", "t", "tid").orderBy("start", "diagonal")
    near = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= drift) & (F.col("start") - F.lag("start").over(order) <= F.col("n_runs") + k + drift)
    clustered = votes.where(~F.col("is_base")).withColumn("new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("cluster", F.sum("new").over(order))
    clustered = clustered.withColumn("first_q", F.array_min("qs")).withColumn("last_q", F.array_max("qs"))
    # a cluster that is too long may be copies side by side: where the template's places go back, another copy begins
    whole, within = Window.partitionBy("doc_id", "t", "tid", "cluster"), Window.partitionBy("doc_id", "t", "tid", "cluster").orderBy("start", "diagonal")
    long = F.max("end").over(whole) - F.min("start").over(whole) > stretch * (F.col("n_runs") + k - 1)
    again = long & F.coalesce(F.col("first_q") <= F.lag("last_q").over(within), F.lit(False))
    clustered = clustered.withColumn("again", F.when(again, 1).otherwise(0)).withColumn("copy", F.sum("again").over(within))
    merged = clustered.groupBy("doc_id", "t", "tid", "label", "is_base", "n_runs", "cluster", "copy").agg(F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    merged = merged.withColumn("coverage", F.col("n") / F.col("n_runs")).where((F.col("coverage") >= cover) & (F.col("end") - F.col("start") <= stretch * (F.col("n_runs") + k - 1)))
    # of licenses that share their wording, the one that a place holds best counts
    by_doc = merged.groupBy("doc_id", "t").agg(F.collect_list(F.struct("tid", "label", "is_base", "start", "end", "coverage")).alias("found"))
    best = F.expr("filter(found, s -> NOT exists(found, o -> o.start < s.end AND o.end > s.start AND o.coverage > s.coverage))")
    return base.unionByName(by_doc.select("doc_id", "t", F.explode_outer(best).alias("s")).select("doc_id", "t", "s.*"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = spans(matches(docs, template_runs(spark)).distinct())
    base = F.col("is_base")
    by_doc = found.groupBy(F.col("doc_id").alias("hit_id"), "t").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.round(F.max("coverage"), 6).alias("score"),
    )
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), alnum_word_count(F.col("text")).alias("n_words"))
    out = words.join(by_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("t")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


QUERIES = {"op7_license_scan": op7_license_scan}


def _sql() -> str:
    templates = ", ".join(f"({n}, '{label}', '{text}', {str(is_base).lower()})" for n, (label, text, is_base) in enumerate([(a, b, True) for a, b in BASE] + [(a, b, False) for a, b in TEMPLATES]))
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS ws FROM documents),
t AS (SELECT tid, label, is_base, string_split(phrase, ' ') AS tw FROM (VALUES {templates}) v(tid, label, phrase, is_base)),
tr AS (SELECT tid, label, is_base, len(tw) - {K - 1} AS n_runs, q, array_to_string(tw[q + 1:q + {K}], ' ') AS gram FROM (SELECT *, unnest(range(0, len(tw) - {K - 1})) AS q FROM t)),
dg AS (SELECT doc_id, p, array_to_string(ws[p + 1:p + {K}], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {K - 1})) AS p FROM d WHERE len(ws) >= {K})),
m AS (SELECT DISTINCT doc_id, tid, label, is_base, n_runs, p, q FROM dg JOIN tr USING (gram)),
v AS (SELECT doc_id, tid, label, is_base, n_runs, p - q AS diagonal, list(DISTINCT q) AS qs, min(p) AS start_, max(p) + {K} AS end_ FROM m GROUP BY ALL),
b AS (SELECT doc_id, label, true AS is_base, start_, 1.0::DOUBLE AS coverage FROM v WHERE is_base AND len(qs) = n_runs),
c AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER o) <= {DRIFT} AND start_ - lag(start_) OVER o <= n_runs + {K + DRIFT} THEN 0 ELSE 1 END AS fresh
      FROM v WHERE NOT is_base WINDOW o AS (PARTITION BY doc_id, tid ORDER BY start_, diagonal)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, tid ORDER BY start_, diagonal) AS cluster FROM c),
x AS (SELECT doc_id, tid, label, n_runs, cluster, len(list_distinct(flatten(list(qs)))) / n_runs::DOUBLE AS coverage, min(start_) AS start_, max(end_) AS end_ FROM g GROUP BY doc_id, tid, label, n_runs, cluster),
y AS (SELECT * FROM x WHERE coverage >= {COVER}::DOUBLE AND end_ - start_ <= {STRETCH}::DOUBLE * (n_runs + {K - 1})),
f AS (SELECT * FROM b UNION ALL SELECT doc_id, label, false, start_, coverage FROM y WHERE NOT EXISTS (SELECT 1 FROM y o WHERE o.doc_id = y.doc_id AND o.start_ < y.end_ AND o.end_ > y.start_ AND o.coverage > y.coverage)),
a AS (SELECT doc_id, count_if(is_base) AS n_base, min(start_) FILTER (is_base) AS first_word, max(start_) FILTER (is_base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(max(coverage), 6) AS score FROM f GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN a USING (doc_id)"""


SQL = {"op7_license_scan": _sql()}
