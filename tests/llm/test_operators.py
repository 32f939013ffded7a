"""The training-data operators against brute force on small tables with nulls, empty and repeated texts."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, exact_dedup, language_id, license_scan, line_dedup, lm_scoring, mixing, quality, simhash, topk
from plumbline.llm.common import keep
from plumbline.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, pos string"


def documents(spark, rows):
    """Rows (id, text, ...) with extra columns whose names the operators use inside."""
    full = [(i, t, (*more, None, None)[0], (*more, None, None)[1], len(t or ""), "k", "p") for i, t, *more in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def write(df, path, name):
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


# --- 4


def test_exact_dedup(spark, tmp_path):
    long = "x" * 5000
    texts = ["a", "b", "a", None, "", long, long + "y", long, "é", "é", "a"]
    docs = documents(spark, list(enumerate(texts)))
    write(docs, tmp_path, "documents")
    got = by_id(exact_dedup.op4_exact_dedup(spark, str(tmp_path)))
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), i == max(same))
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_edges(spark):
    empty = documents(spark, [])
    assert exact_dedup.exact_groups(empty).count() == 0
    again = documents(spark, [(1, "a"), (1, "a"), (None, "a"), (2, "b")])
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(again, first_bytes=1).collect()) == [(0, 1, 3), (1, 1, 3), (1, 1, 3), (2, 2, 1)]


# --- 5


def brute_fingerprint(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_components(fps, radius):
    comp = {i: {i} for i in fps}
    for a, b in itertools.combinations(fps, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= radius and comp[a] is not comp[b]:
            comp[a] |= comp[b]
            for x in comp[b]:
                comp[x] = comp[a]
    return {i: min(c) for i, c in comp.items()}


def near_texts(seed=5, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
    out = []
    for i in range(n):
        if i and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = rng.choices(words, k=rng.choice([3, 30, 300]))
        out.append(" ".join(w))
    return out


def test_simhash(spark, tmp_path):
    texts = [*near_texts(), None, "", "  \t", "One TWO", "one\ntwo", "ÉÀ", "éà"]
    write(documents(spark, list(enumerate(texts))), tmp_path, "documents")
    got = by_id(simhash.op5_simhash(spark, str(tmp_path)))
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    expected = brute_components(fps, 4)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == expected
    assert len(set(expected.values())) < len(set(fps.values()))


def test_simhash_cells_and_edges(spark):
    docs = documents(spark, list(enumerate(near_texts(7, 30))))
    whole, cut = (by_id(simhash.near_duplicates(docs, shingle=4, radius=12, cell=c)) for c in (1 << 14, 2))
    assert {i: r.component_id for i, r in whole.items()} == {i: r.component_id for i, r in cut.items()} == brute_components({i: r.f0 & (1 << 64) - 1 for i, r in whole.items()}, 12)
    assert simhash.near_duplicates(documents(spark, []), shingle=4, radius=4).count() == 0


@pytest.mark.parametrize(("n", "words", "radius"), [(1, 1, 4), (64, 1, 4), (130, 1, 4), (90, 4, 52)])
def test_bit_sliced_distances(n, words, radius):
    rng = np.random.default_rng(n)
    f = rng.integers(0, 2**64, (max(1, n // 4), words), np.uint64)[rng.integers(0, max(1, n // 4), n)].copy()
    for i, b in zip(rng.integers(0, n, 6 * n), rng.integers(0, 64 * words, 6 * n), strict=True):
        f[i, b >> 6] ^= np.uint64(1) << np.uint64(b & 63)
    d = sum(np.bitwise_count(f[:, w][:, None] ^ f[:, w][None, :]).astype(int) for w in range(words))
    assert {(i, int(j)) for i, js in simhash.near(f, radius) for j in js} == {(i, j) for i, j in zip(*np.nonzero(d <= radius), strict=True) if i < j}


@pytest.mark.parametrize("n", [10**3, 10**5, 10**6, 10**7, 10**8])
def test_sampled_tables_hold_their_bound_at_the_radius(n):
    stage = simhash.STAGE
    tables = simhash.sampled_tables(stage["bits"], *[v for k, v in stage.items() if k == "radius"], n)
    k = len(tables[0])
    met = math.comb(stage["bits"] - stage["radius"], k) / math.comb(stage["bits"], k)
    assert (1 - met) ** len(tables) <= simhash.MISS and len({len(t) for t in tables}) == 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (4, 3), (10, 11), (12, 11), (7, 7), (2, 1)]
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {2: 1, 3: 1, 4: 1, 11: 10, 12: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        how = rng.random()
        if how < 0.34:
            s.insert(i, rng.choice("abcé😀"))
        elif how < 0.67:
            s.pop(min(i, len(s) - 1))
        else:
            s[min(i, len(s) - 1)] = rng.choice("abcé😀")
    return "".join(s)


def near_lines(seed, n_texts=16):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefgh é😀", k=rng.randint(18, 40))).strip() for _ in range(12)]
    base += ["0" * rng.randint(20, 40), "ab" * 15, "word " * 9 + "%d end of the line" % seed]
    texts = ["\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(6)) for _ in range(n_texts)]
    return texts + [None, "", "\n\n", "short\n \nshort", "short", base[0] + "\n" + base[0]]


def brute_lines(rows):
    """{(doc_id, n): None, "equal" or "near"} and the lines linked to an earlier one; rows: doc_id, text."""
    first, lines = {}, {}
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip():
                lines[i, k] = line
                first.setdefault(line, (i, k))
    long = sorted((x for x in first if len(x) >= line_dedup.MIN_CHARS), key=first.get)
    late = {b for a, b in itertools.combinations(long, 2) if abs(len(a) - len(b)) <= line_dedup.TAU and distance(a, b) <= line_dedup.TAU}
    return {p: "near" if x in late else "equal" if first[x] != p else None for p, x in lines.items()}, late, first


@pytest.mark.parametrize(("crowd", "cells"), [(32, 7), (1, 5)])
def test_links_of_lines(spark, crowd, cells):
    texts = near_lines(crowd, 24)
    docs = documents(spark, list(enumerate(texts))).select("doc_id", "text")
    lines = line_dedup.partners(docs, line_dedup.line_table(docs))
    text = {r.id: r.line for r in lines.select("id", F.expr("decode(u, 'UTF-32')").alias("line")).collect()}
    links = [(r.early, r.late) for r in line_dedup.linked(lines, crowd=crowd, cells=cells).collect()]
    _, late, first = brute_lines(list(enumerate(texts)))
    assert all(a < b and first[text[a]] < first[text[b]] and distance(text[a], text[b]) <= line_dedup.TAU for a, b in links)
    assert {text[b] for _, b in links} == late and late


def brute_links(texts):
    """All pairs of different lines within two edits, as they stand first in the corpus, and the first line of each one's component."""
    _, _, first = brute_lines(list(enumerate(texts)))
    long = sorted((x for x in first if len(x) >= line_dedup.MIN_CHARS), key=first.get)
    links = {(a, b) for a, b in itertools.combinations(long, 2) if abs(len(a) - len(b)) <= line_dedup.TAU and distance(a, b) <= line_dedup.TAU}
    root = {x: x for x in long}
    for _ in long:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b], key=first.get)
    return links, root, first


@pytest.mark.parametrize(("crowd", "cells"), [(32, 7), (4, 7), (1, 5)])
def test_every_link_of_lines(spark, crowd, cells):
    alike = [f"a line that stands everywhere but for {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    texts = [*near_lines(crowd, 24), *alike]
    docs = documents(spark, list(enumerate(texts))).select("doc_id", "text")
    lines = line_dedup.partners(docs, line_dedup.line_table(docs))
    text = {r.id: r.line for r in lines.select("id", F.expr("decode(u, 'UTF-32')").alias("line")).collect()}
    found = [(text[r.early], text[r.late]) for r in line_dedup.linked(lines, crowd=crowd, cells=cells, every=True).collect()]
    links, _, _ = brute_links(texts)
    assert len(found) == len(set(found)) and set(found) == links and len(links) > 40 * 39 // 2


def test_line_links_of_documents(spark, tmp_path):
    # 2 is linked to 0 and 1, which are no link of each other and stay; 40 lines are all linked to each other
    base = "a line of some forty characters in all"
    texts = ["abcd" + base, "EFGH" + base, "EbcH" + base + "\nEbcH" + base, "EbcH" + base, "nothing like it in the corpus", *near_lines(8)]
    texts += [f"a line that stands everywhere but for {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    write(documents(spark, [*enumerate(texts)]), tmp_path, "documents")
    got = by_id(line_dedup.op2_line_dedup(spark, str(tmp_path)))
    links, root, first = brute_links(texts)
    for i, t in enumerate(texts):
        held = {x for x in (t or "").split("\n") if any(x in pair for pair in links)}
        assert got[i].n_links == sum(x in pair for x in held for pair in links)
        assert got[i].link_class_ids == sorted({first[root[x]][0] for x in held})
    assert [got[i].n_links for i in range(5)] == [1, 1, 2, 2, 0] and got[1].n_near == 0 and got[1].link_class_ids == [0]


def test_lines_alike_stay_linear(spark):
    same = "the quick brown fox jumps over the lazy dog and then "
    n = 300
    docs = documents(spark, [(i, f"{same}{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(n)]).select("doc_id", "text")
    lines = line_dedup.partners(docs, line_dedup.line_table(docs))
    assert lines.count() == n and n - 1 <= line_dedup.linked(lines).count() <= 2 * n
    assert [r.doc_id for r in line_dedup.drop_lines(documents(spark, [(r.doc_id, r.text) for r in docs.collect()])).collect()] == [0]


@pytest.mark.parametrize("broadcast_rows", [line_dedup.BROADCAST_ROWS, 0])
def test_line_dedup(spark, tmp_path, monkeypatch, broadcast_rows):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast_rows)
    rows = [*enumerate(near_lines(3))]
    docs = documents(spark, [*rows, (None, rows[0][1]), (3, rows[3][1])])
    write(docs, tmp_path, "documents")
    what, late, first = brute_lines(rows)
    got = line_dedup.op2_line_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 2
    kept = {}
    for r in got:
        i, t = (0, rows[0][1]) if r.doc_id is None else rows[r.doc_id]
        lines = (t or "").split("\n")
        of = [None] * len(lines) if r.doc_id is None else [what.get((i, k)) for k in range(len(lines))]
        text = "\n".join(x for x, w in zip(lines, of, strict=True) if not w)
        assert (r.n_lines, r.n_equal, r.n_near) == (len(lines), of.count("equal"), of.count("near"))
        assert r.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
        # classes are documents that keep a line
        assert (r.class_ids == []) == (not any(of)) and all(None in [w for p, w in what.items() if p[0] == c] for c in r.class_ids)
        if r.doc_id is not None:
            kept[i] = None if any(of) and not text.strip() else t if not any(of) else text
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns
    found = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert found == {(i, t, len(t or "")) for i, t in kept.items() if t is not None or rows[i][1] is None} | {(None, rows[0][1], len(rows[0][1]))}
    assert line_dedup.drop_lines(documents(spark, [])).count() == 0


def test_line_dedup_long_and_repeated_ids(spark):
    rng = random.Random(12)
    long = "".join(rng.choices("abcd ", k=300_000))
    docs = documents(spark, [(1, long), (2, long[:1000] + "x" + long[1001:]), (3, "a line that is first seen here\nx"), (3, "another text of the same id\na line that is first seen here")])
    got = sorted((r.doc_id, r.text) for r in line_dedup.drop_lines(docs).collect())
    assert got[0] == (1, long) and all(i == 3 for i, _ in got[1:])
    assert sorted(x for _, t in got[1:] for x in t.split("\n")) == ["a line that is first seen here", "another text of the same id", "x"]


def test_banded_distance(spark):
    rng = random.Random(1)
    pairs = [(a, edited(rng, a, rng.randint(0, 4))) for a in ("".join(rng.choices("abcé", k=rng.randint(3, 30))) for _ in range(150))]
    pairs = [(a, b) for a, b in pairs if abs(len(a) - len(b)) <= 2 and b]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.split("a", "").alias("x"), F.split("b", "").alias("y"))
    assert all(r.w == (distance(r.a, r.b) <= 2) for r in df.select("a", "b", F.expr(line_dedup.within("x", "y", 2)).alias("w")).collect())


# --- 10


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination(spark, tmp_path):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(30)]
    items = [(0, " ".join(rng.choices(vocab, k=14))), (1, "Short Item, here"), (2, None), (3, "..."), (10, " ".join(rng.choices(vocab, k=10)))]
    texts = [" ".join(rng.choices(vocab, k=40)) for _ in range(6)] + [items[0][1].upper() + " tail", "x short-item HERE y " * 3, None, "", "É " + items[4][1], " ".join(items[0][1].split()[2:13])]
    docs = documents(spark, list(enumerate(texts)))
    write(docs, tmp_path, "documents")
    write(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark")
    got = by_id(decontaminate.op10_decontaminate(spark, str(tmp_path)))
    for i, t in enumerate(texts):
        ws, hit, found = words(t), set(), set()
        for item, text in items:
            w = words(text)
            k = min(10, len(w))
            for win in {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else ():
                for p in range(len(ws) - k + 1):
                    if tuple(ws[p : p + k]) == win:
                        hit |= set(range(p, p + k))
                        found.add(str(item))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(ws), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.contaminated}
    blocks = decontaminate.hits(docs, bench, block=2)
    assert {(r.doc_id, r.start, r.k) for r in blocks.collect()} == {(r.doc_id, r.start, r.k) for r in decontaminate.hits(docs, bench).collect()}
    assert decontaminate.hits(docs, bench.limit(0)).count() == 0


# --- 7


def test_license_scan(spark, tmp_path):
    gpl = dict(license_scan.TEMPLATES)["gpl"]
    changed = gpl.replace("free software you", "free and open software you")
    texts = ["Released under the MIT License. Under the mit license!", "Apache License, Version 2.0 and CC BY-NC 4.0", None, "", "nothing of the kind", "start " + changed + " end", "under the mit", "All rights reserved."]
    write(documents(spark, list(enumerate(texts))), tmp_path, "documents")
    got = by_id(license_scan.op7_license_scan(spark, str(tmp_path)))
    pick = lambda i: tuple(got[i])[1:7]
    assert pick(0) == (9, 2, 1, 5, "mit", "mit")
    assert pick(1) == (11, 2, 0, 6, "apache-2,cc-by-nc", "apache-2,cc-by-nc")
    assert pick(2) == pick(3) == (0, 0, None, None, "", "")
    assert pick(4) == (4, 0, None, None, "", "")
    assert got[5].labels == "gpl" and got[5].n_base == 0 and 0.6 <= got[5].score < 1
    assert got[6].labels == "" and got[7].labels == "all-rights-reserved" and got[7].score == 1


def test_license_copies_side_by_side(spark, tmp_path):
    texts = ["All rights reserved. All rights reserved.", "all rights reserved. x all rights reserved", "All rights reserved.\n" * 300, "all rights all rights", "all rights reserved"]
    write(documents(spark, list(enumerate(texts))), tmp_path, "documents")
    got = by_id(license_scan.op7_license_scan(spark, str(tmp_path)))
    assert [(got[i].labels, got[i].score) for i in range(5)] == [("all-rights-reserved", 1.0)] * 3 + [("", 0.0), ("all-rights-reserved", 1.0)]


def test_scans_of_repeated_ids_and_empty_tables(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    gpl, bsd = dict(license_scan.TEMPLATES)["gpl"], dict(license_scan.TEMPLATES)["bsd"]
    rows = [(1, "no license here at all"), (1, "under the mit license " + item), (1, "under the mit license " + item), (2, "x " * 200_000 + item), (None, item), (None, "cc by nc"), (3, f"{gpl} {bsd}")]
    write(documents(spark, rows), tmp_path, "documents")
    bench = spark.createDataFrame([(1, item), (1, item), (2, item + " eleven")], "item_id long, text string")
    write(bench, tmp_path, "benchmark")
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels, r.first_word if r.n_base else -1) for r in license_scan.op7_license_scan(spark, str(tmp_path)).collect())
    assert got == [(0, 3, 1, "cc-by-nc", 0), (0, 10, 0, "", -1), (1, 5, 0, "", -1), (1, 14, 1, "mit", 0), (1, 14, 1, "mit", 0), (2, 200_010, 0, "", -1), (3, len(words(gpl + " " + bsd)), 0, "bsd,gpl", -1)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.op10_decontaminate(spark, str(tmp_path)).collect())
    assert got == [(0, 3, 0, 0), (0, 10, 10, 2), (1, 5, 0, 0), (1, 14, 10, 2), (1, 14, 10, 2), (2, 200_010, 10, 2), (3, len(words(gpl + " " + bsd)), 0, 0)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id or 0, len(r.text)) for r in decontaminate.remove_contaminated(docs, bench).collect()) == [(0, 8), (1, 22), (3, len(gpl + bsd) + 1)]
    empty = tmp_path / "empty"
    write(documents(spark, []), empty, "documents")
    write(bench, empty, "benchmark")
    assert license_scan.op7_license_scan(spark, str(empty)).count() == decontaminate.op10_decontaminate(spark, str(empty)).count() == 0


# --- 9


def test_mixed_documents_with_repeated_ids(spark):
    rows = [(i // 3, "w " * (1 + i % 5), None, "ab"[i % 2]) for i in range(40)] + [(99, "same text", None, "a")] * 2 + [(None, "no id", None, None)]
    docs = documents(spark, rows).withColumn("size", F.lit("own"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = mixing.mixed_documents(docs, labels, most_epochs=1, share=1.0)
    assert got.columns == [*(c for c in docs.columns if c != "size"), "size", "source_size", "target", "taken"]
    rows_out = got.collect()
    assert len(rows_out) == len(rows) and all(r["taken"] == r["size"] == len(r["text"].split()) for r in rows_out)


def test_bins_are_even_for_every_weight(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 0.25).otherwise(1.0).alias("w"))
    held = []
    real, mixing.keep = mixing.keep, lambda df, name: held.append(real(df, name)) or held[-1]
    try:
        mixing.mix(df, F.col("w"), bins=64, share=0.5).count()
    finally:
        mixing.keep = real
    assert held[0].groupBy("bin").count().agg(F.max("count")).first()[0] <= 4 * 40_000 / 64


def test_mixing(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 30), None, rng.choice(["b", "a", "c", None, "big", "big", "big"])) for i in range(300)] + [(300, None, None, "a"), (301, "", None, "none")]
    write(documents(spark, rows), tmp_path, "documents")
    write(spark.createDataFrame([(1, 1), (2, 0), (3, None), (1, 0)], "doc_id long, quality int"), tmp_path, "labels")
    got = mixing.op9_mix_sources(spark, str(tmp_path)).collect()
    assert got and sorted(map(str, got)) == sorted(map(str, mixing.op9_mix_sources(spark, str(tmp_path)).collect()))
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    total, names = {}, sorted({s for s in source.values() if s}) + [None]
    for i, s in source.items():
        total[s] = total.get(s, 0) + size[i]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(total.values())
    while True:
        free = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 2 * total[s]]
        if not over:
            break
        for s in over:
            full.add(s)
            target[s] = 2.0 * total[s]
            left -= target[s]
    target |= {s: weight[s] * level for s in names if s not in full}
    taken = {s: 0 for s in names}
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[s])
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long"), F.lit(1.0)).count() == 0


# --- 6, 1, 8


def prose(rng, n, letters="abcdefg"):
    return " ".join("".join(rng.choices(letters, k=3)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(i, (prose(rng, 60) if i % 5 else " ".join("%%%" + prose(rng, 1, "xyz") for _ in range(60))), ("en", "de")[i % 2], "s") for i in range(200)]
    rows += [(200, None, "en", "s"), (201, "", "en", "s")]
    path = tmp_path_factory.mktemp("judged")
    write(documents(spark, rows), path, "documents")
    write(spark.createDataFrame([(i, int(bool(i % 5)), 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int"), path, "labels")
    return str(path), rows


def test_quality(spark, judged):
    path, rows = judged
    got = by_id(quality.op6_quality(spark, path))
    assert len(got) == len(rows)
    assert sum(got[i].kept == bool(i % 5) for i in range(200)) >= 198
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    chosen = quality.Selection(docs, labels)
    kept = chosen.filter(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)
    nothing = quality.Selection(docs.limit(0), labels)
    assert nothing.filter(docs.limit(0)).count() == 0
    assert quality.Selection(docs, labels.limit(0)).decisions().count() == len(rows)


def test_top(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(-(10**12), 10**12) if i % 3 else 7) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, key long")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (1, 2, 100, 250, 333, 499, 500):
        v, last = topk.top(df, k)
        assert {i for i, key in rows if key > v or (key == v and i <= last)} == {i for i, _ in order[:k]}


def test_lm_scoring(spark, judged):
    path, rows = judged
    got = by_id(lm_scoring.op1_lm_scoring(spark, path))
    good, bad = ([got[i].score for i in range(200) if bool(i % 5) == g] for g in (True, False))
    assert max(good) < min(bad)
    assert got[200].n_tokens == 0 and got[200].target_loss is None and got[201].score == 0
    counts = lm_scoring.model_counts(spark.createDataFrame([("a b a b", True), ("a c", False)], "text string, good boolean"))
    assert counts[0, : 1 << lm_scoring.WORD_BITS].sum() == 6 + 2 and counts[1, 1 << lm_scoring.WORD_BITS :].sum() == 4


def brute_losses(rows, good):
    """Exact bigram losses {id: (target, background)} of rows (id, text); good: ids of target text."""
    texts = {i: ["<s>", *re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^0-9a-z\x80-\U0010ffff\s]+", (t or "").lower())] for i, t in rows}
    texts = {i: t for i, t in texts.items() if len(t) > 1}
    out = {i: [] for i in texts}
    vocabulary = {w for t in texts.values() for w in t}
    for ids in (good & set(texts), set(texts)):
        words, pairs = ({}, {})
        for i in ids:
            for w in texts[i]:
                words[w] = words.get(w, 0) + 1
            for p in itertools.pairwise(texts[i]):
                pairs[p] = pairs.get(p, 0) + 1
        total = sum(words.values()) + len(vocabulary)
        for i, t in texts.items():
            loss = [-math.log((pairs.get((v, w), 0) + 50 * (words.get(w, 0) + 1) / total) / (words.get(v, 0) + 50)) for v, w in itertools.pairwise(t)]
            out[i].append(sum(loss) / len(loss))
    return out


@pytest.mark.parametrize(("frequent", "filter_bits"), [(lm_scoring.FREQUENT, lm_scoring.FILTER_BITS), (40, lm_scoring.FILTER_BITS), (40, 6), (0, lm_scoring.FILTER_BITS)])
def test_lm_counts_are_exact(spark, frequent, filter_bits):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(0, 40), "abc")) for i in range(60)] + [(60, None), (61, "once only"), (62, "once only"), (63, "single words here")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(64)], "doc_id long, quality int")
    got = by_id(lm_scoring.score(documents(spark, rows), labels, frequent=frequent, filter_bits=filter_bits))
    expected = brute_losses(rows, {i for i in range(64) if i % 3 == 0})
    assert len(got) == 64 and got[60].target_loss is None
    for i, (target, background) in expected.items():
        assert got[i].target_loss == pytest.approx(target, abs=2e-6) and got[i].background_loss == pytest.approx(background, abs=2e-6)


@pytest.mark.parametrize("broadcast_rows", [lm_scoring.BROADCAST_ROWS, 0])
def test_lm_target_is_every_good_document(spark, broadcast_rows):
    n = quality.LABELLED + 1000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id") % 7).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = lm_scoring.score(docs, labels.unionByName(labels), broadcast_rows=broadcast_rows)
    assert got.count() == n and got.where("target_loss <> background_loss OR score <> 0").count() == 0


def test_lm_counts_grow(spark):
    n = (1 << 18) + 5000
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)), True)], "text string, good boolean")
    table = lm_scoring.ngram_counts(docs)
    assert table.where("key & 1 = 0").count() == n + 1 and table.where("key & 1 = 1").count() == n


def test_lm_counts_of_tasks_that_send_parts(spark):
    """More distinct n-grams in a task than it holds: some are sent, the frequent ones stay, and the sums are exact."""
    n, words = 2048, 600
    text = F.concat_ws(" ", F.lit("often"), F.expr(f"transform(sequence(1, {words}), i -> concat('w', id * {words} + i))"))
    table = lm_scoring.ngram_counts(spark.range(0, n, 1, 1).select(text.alias("text"), (F.col("id") % 2 == 0).alias("good")))
    assert n * words * 2 > 2 * lm_scoring._HELD
    got = table.groupBy("n", "target").count().collect()
    assert {(r["n"], r["target"]): r["count"] for r in got} == {(n, n // 2): 3, (1, 0): n * words, (1, 1): n * words}


def shuffled_bytes(spark):
    """What all stages of the session so far have written for shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_lm_shuffles_little(spark):
    """However few n-grams are frequent, text and counts cross the shuffles within the budget of the check, 4 times the text."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(3000)], k=100))) for i in range(3000)]
    docs = keep(documents(spark, rows).select("doc_id", "text"), "lm-documents")
    labels = spark.range(0, 3000, 3).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    before = shuffled_bytes(spark)
    assert lm_scoring.score(docs, labels, frequent=0).where("score IS NOT NULL").count() == 3000
    assert 0 < shuffled_bytes(spark) - before < 4 * sum(len(t) for _, t in rows)


def test_lm_counts_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 150)
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randint(0, 40), "abc")) for i in range(50)] + [(50, None), (51, ""), (52, "x" * 1000)]
    docs = documents(spark, rows)
    assert lm_scoring._n_blocks(docs) > 20
    got = by_id(lm_scoring.score(docs, spark.createDataFrame([(i, 1) for i in range(0, 53, 2)], "doc_id long, quality int")))
    assert len(got) == 53 and got[50].target_loss is None and got[51].score == 0
    for i, (target, background) in brute_losses(rows, set(range(0, 53, 2))).items():
        assert got[i].target_loss == pytest.approx(target, abs=2e-6) and got[i].background_loss == pytest.approx(background, abs=2e-6)


def test_lm_packing():
    import zstandard

    pack, unpack = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    top = (1 << 64) - 1
    for keys in ([0], [top], [0, 1, 255, 256, 1 << 40, top - 1, top], [5, 6]):
        sent = np.array(keys, np.uint64)
        assert lm_scoring._keys(unpack, lm_scoring._packed_keys(pack, sent), len(keys)).tolist() == keys
    for counts in ([0], [1, 255], [256, 0], [1 << 16, 7], [1 << 40, 3, 0]):
        assert lm_scoring._counts(unpack, lm_scoring._packed_counts(pack, np.array(counts, np.int64)), len(counts)).tolist() == counts
    for keys in ([], [3], [top, top - 1, top, top - 3, 0, 2, 1, 2], list(range(40, 0, -1))):  # the last bits decide
        found, order = lm_scoring._ordered(np.array(keys, np.uint64))
        assert found.tolist() == sorted(keys) and order.tolist() == sorted(range(len(keys)), key=keys.__getitem__)


def test_language_id(spark, tmp_path):
    rng = random.Random(6)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "äöüßé"}
    rows = [(i, prose(rng, 20, letters[lang]), lang) for i, lang in enumerate(rng.choices(list(letters), k=200))] + [(500, None, "aa"), (501, "123 !", "aa"), (502, "abc cab", None)]
    write(documents(spark, rows), tmp_path, "documents")
    got = by_id(language_id.op8_language_id(spark, str(tmp_path)))
    import zlib

    for i, t, lang in rows[:200]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "aa"
    none = language_id.identify(documents(spark, [(1, "abc")]).select("doc_id", "text", "lang"))
    assert none.first().lang_pred == "und"


@pytest.mark.parametrize("n", [2, 4, 7, 12, 40])
def test_codewords(n):
    code = language_id.codewords(n)
    apart = [int((a != b).sum()) for a, b in itertools.combinations(code, 2)]
    assert min(apart) >= (1 if n == 2 else code.shape[1] // 4) and all(abs(c.sum()) < n for c in code.T)
    assert math.isfinite(sum(apart))
