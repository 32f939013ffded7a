"""Near duplicates by SimHash, compared bit-sliced.

Fingerprint: each bit is the majority of that bit in the hashes of a text's
word shingles.  Fingerprints that differ in at most ``radius`` bits are
linked; a document's component is all that links reach.

Comparison: distinct fingerprints are dealt to buckets and the members of a
bucket are stored vertically, one plane for each bit with one lane for each
member.  A block of members is compared with a whole bucket by exclusive-or of
planes; carry-save adders sum eight planes at a time into bitwise counters, so
one machine word updates 64 distances, and lanes whose counter is above the
radius are dropped; a block ends when none is left.

Buckets, two ways:

* ``exact``: the bits are cut into m parts, and a bucket is the value of
  m - radius of them.  Fingerprints within the radius agree in some such
  choice, so no link is missed.  m follows from the number of fingerprints.
* sampled, for radii that need too many choices: each of T tables takes
  k of the bits; T is such that a pair at the radius is missed by all with
  probability ``MISS`` at most, and a nearer one with less.  k and T follow from the number of
  fingerprints, which changes the cost and not the bound.

Buckets of more than ``CELL`` members are cut into parts and compared pair of
parts by pair of parts, so a task holds at most two parts.  A bucket gives a
spanning forest of its links, never all of its pairs.

Defined cases: null is the empty text; texts without words have fingerprint
zero and are linked like any other; equal fingerprints are one node, so
copies are never paired; repeated rows give repeated rows; an empty table
gives an empty result; a null id is ignored in the choice of the smallest.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep, partitions, read, small
from plumbline.llm.components import components

SEED = 42
#: Members of one compared part at most.
CELL = 1 << 14
MISS = 0.001
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """n independent words from each hash; the first is the hash."""
    out = np.empty((len(h), n), np.uint64)
    out[:, 0] = h
    for w in range(1, n):
        x = (h ^ np.uint64(_ODD[(w - 1) % 4])) * np.uint64(_ODD[w % 4])
        x ^= x >> np.uint64(29)
        x *= np.uint64(_ODD[(w + 1) % 4])
        out[:, w] = x ^ (x >> np.uint64(32))
    return out


def fingerprint(text: str | None, shingle: int, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words of the SimHash of one text."""
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return np.zeros(words, np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    k = min(shingle, len(parts))
    digest, n = xxhash.xxh64_intdigest, len(parts) - k + 1
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)), np.uint64, n)
    ones = np.zeros(words * 64, np.int64)
    for at in range(0, n, 1 << 14):
        part = _mixed(h[at : at + (1 << 14)], words)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), words * 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, shingle: int, words: int = 1) -> DataFrame:
    """doc_id, f0, f1, ...: the fingerprint as signed longs."""
    names = [f"f{w}" for w in range(words)]

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            found = np.empty((len(column), words), np.uint64)
            for i in range(len(column)):
                found[i] = fingerprint(column[i].as_py(), shingle, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, w].view(np.int64)) for w in range(words)]], ["doc_id", *names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{n} bigint" for n in names))


# --- which fingerprints meet


@lru_cache
def exact_tables(bits: int, radius: int, n: int) -> list[list[int]]:
    """For each table the bits that must be equal; chosen for the least work over n fingerprints."""
    best = None
    for m in range(radius + 1, radius + 5):
        width = bits // m
        cost = math.comb(m, radius) * (n + n * n / 2 ** (width * (m - radius)) / 800)
        if best is None or cost < best[0]:
            best = cost, m
    m = best[1]
    edges = [bits * i // m for i in range(m + 1)]
    return [[b for p in choice for b in range(edges[p], edges[p + 1])] for choice in itertools.combinations(range(m), m - radius)]


@lru_cache
def sampled_tables(bits: int, radius: int, n: int) -> list[list[int]]:
    """For each table k bits; a pair that differs in ``radius`` bits is missed with probability MISS at most."""
    count = lambda k: math.ceil(math.log(MISS) / math.log1p(-math.comb(bits - radius, k) / math.comb(bits, k)))
    k = min(range(8, 41), key=lambda k: count(k) * (n + n * n / 2**k / 800))
    choose = np.random.default_rng(bits)
    return [sorted(choose.choice(bits, k, replace=False).tolist()) for _ in range(count(k))]


def _keys(found: np.ndarray, chosen: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint as one number."""
    out = np.zeros(len(found), np.uint64)
    for n, b in enumerate(chosen):
        out |= ((found[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)) << np.uint64(n)
    return out


def _buckets(nodes: DataFrame, tables: list[list[int]], words: int) -> DataFrame:
    """bucket, node, f0, ...: each node once in every table."""
    names = [f"f{w}" for w in range(words)]

    def run(batches):
        for batch in batches:
            found = np.stack([batch.column(1 + w).to_numpy(zero_copy_only=False).view(np.uint64) for w in range(words)], axis=1)
            for t, chosen in enumerate(tables):
                key = _keys(found, chosen) * np.uint64(len(tables)) + np.uint64(t)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], ["bucket", "node", *names])

    return nodes.select("node", *names).mapInArrow(run, "bucket bigint, node bigint, " + ", ".join(f"{n} bigint" for n in names))


# --- bit-sliced comparison


def _add(a, b, c):
    """A full adder: sum and carry of three planes."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _above(counter: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose count is above the limit."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ~np.uint64(0))
    for level in range(len(counter) - 1, -1, -1):
        if limit >> level & 1:
            equal &= counter[level]
        else:
            above |= equal & counter[level]
            equal &= ~counter[level]
    return above


def near(found: np.ndarray, radius: int):
    """(row, later rows within the radius) of an array of fingerprints (n, words)."""
    n, words = found.shape
    lanes = -(-n // 64)
    bits = np.unpackbits(found.view(np.uint8).reshape(n, words * 8), axis=1, bitorder="little")
    padded = np.zeros((words * 64, lanes * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    levels = max(4, int(radius + 8).bit_length())
    full = ~np.uint64(0)
    rows_at_once = max(1, min(n, (1 << 15) // lanes))
    for at in range(0, n, rows_at_once):
        rows = np.arange(at, min(n, at + rows_at_once))
        first = at // 64
        width = lanes - first
        # lanes that don't count: the row itself, earlier ones and those beyond the end
        lane = np.arange(width)[None, :] + first
        past = np.clip(rows[:, None] + 1 - lane * 64, 0, 64)
        dead = np.where(past == 64, full, (np.uint64(1) << (past % 64).astype(np.uint64)) - np.uint64(1))
        if n % 64:
            dead[:, -1] |= full << np.uint64(n % 64)
        own = bits[rows].astype(bool)
        counter = [np.zeros((len(rows), width), np.uint64) for _ in range(levels)]
        for plane in range(0, words * 64, 8):
            d = [planes[plane + i, first:][None, :] ^ np.where(own[:, plane + i], full, np.uint64(0))[:, None] for i in range(8)]
            ones, a = _add(counter[0], d[0], d[1])
            ones, b = _add(ones, d[2], d[3])
            twos, e = _add(counter[1], a, b)
            ones, a = _add(ones, d[4], d[5])
            counter[0], b = _add(ones, d[6], d[7])
            counter[1], f = _add(twos, a, b)
            counter[2], carry = _add(counter[2], e, f)
            for level in range(3, levels):
                counter[level], carry = counter[level] ^ carry, counter[level] & carry
            dead |= _above(counter, radius) | carry
            alive = (dead != full).any(axis=1)
            if not alive.all():
                if not alive.any():
                    rows = rows[:0]
                    break
                if alive.sum() <= 0.7 * len(rows):
                    rows, own, dead = rows[alive], own[alive], dead[alive]
                    counter = [c[alive] for c in counter]
        for i in range(len(rows)):
            later = np.flatnonzero(np.unpackbits((~dead[i]).view(np.uint8), bitorder="little"))
            if len(later):
                yield int(rows[i]), later + first * 64


def forest(found: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the first of those that links join with it."""
    label = np.arange(len(found))
    for i, later in near(found, radius):
        roots = np.unique(label[np.append(later, i)])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    return label


def _compare(radius: int, words: int):
    """Over rows sorted by (bucket, p, q): a link for each member and its first."""

    def links(node, found):
        label = forest(found, radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return node[linked], node[label[linked]]

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            node = batch.column(3).to_numpy(zero_copy_only=False)
            found = np.stack([batch.column(4 + w).to_numpy(zero_copy_only=False).view(np.uint64) for w in range(words)], axis=1)
            if held:
                key, node, found = (np.concatenate(x) for x in zip(held.pop(), (key, node, found), strict=True))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            held.append((key[cuts[-2] :], node[cuts[-2] :], found[cuts[-2] :]))
            yield from _batch(cuts[:-1], node, found)
        if held:
            yield from _batch([0, len(held[0][1])], *held[0][1:])

    def _batch(cuts, node, found):
        out = [links(node[a:b], found[a:b]) for a, b in itertools.pairwise(cuts) if b - a > 1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)], ["a", "b"])

    return run


def links(nodes: DataFrame, radius: int, words: int, tables: list[list[int]], cell: int = CELL) -> DataFrame:
    """Edges (a, b) between nodes (node, f0, ...), as forests of the buckets."""
    spark = nodes.sparkSession
    names = [f"f{w}" for w in range(words)]
    dealt = _buckets(nodes, tables, words)
    large = keep(dealt.groupBy("bucket").count().where(F.col("count") > cell).select(F.col("bucket").alias("large"), F.ceil(F.col("count") / (cell // 2)).cast("int").alias("cuts")), "large-buckets")
    dealt = dealt.join(small(large, large.count(), 100_000), F.col("bucket") == F.col("large"), "left")
    part = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    # a member of part p meets every part q: the cells (p, q) and (q, p) are one
    cells = F.when(F.col("cuts").isNull(), F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda q: F.struct(F.least(part, q).alias("p"), F.greatest(part, q).alias("q")))
    )
    dealt = dealt.select("bucket", "node", *names, F.explode(cells).alias("cell")).select("bucket", "cell.p", "cell.q", "node", *names)
    dealt = dealt.repartition(partitions(spark), "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    return dealt.mapInArrow(_compare(radius, words), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, shingle: int, radius: int, bits: int = 64, sampled: bool = False, cell: int = CELL) -> DataFrame:
    """doc_id, f0, ..., component_id of every row.  sampled: by sampled tables, else by exact ones."""
    words = bits // 64
    names = [f"f{w}" for w in range(words)]
    found = keep(fingerprints(docs, shingle, words), "fingerprints")
    nodes = keep(found.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = max(1, nodes.count())
    tables = sampled_tables(bits, radius, n) if sampled else exact_tables(bits, radius, n)
    roots = keep(components(links(nodes, radius, words, tables, cell)), "roots")
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("component_id", *[F.col(c).alias(f"n_{c}") for c in names])
    same = [F.col(c) == F.col(f"n_{c}") for c in names]
    return found.join(named, same, "left").select("doc_id", *names, "component_id")


#: The corpus stage: five-word shingles and 256 bits.  Texts whose shingle sets have similarity (Jaccard) 0.8 have
#: cosine 8/9 and differ in a share of acos(8/9)/pi = 0.151 of the bits, 38.7 of 256 with deviation 5.7; the radius lies
#: 2.3 deviations above.  Unrelated texts differ in 128 with deviation 8.
STAGE = {"shingle": 5, "bits": 256, "radius": 52, "sampled": True}


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without all but the smallest id of each component; all columns.  Rows without an id stay."""
    found = near_duplicates(docs.select("doc_id", "text"), **(STAGE | parameters))
    gone = keep(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-duplicates")
    return docs.join(small(gone, gone.count(), 500_000), docs["doc_id"] == gone["__gone"], "left_anti")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
SQL: dict[str, str] = {}
