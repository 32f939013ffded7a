"""Language-model scoring by cross-entropy difference.

Two bigram models, of target text (labelled good) and of all text, are matched:
the same order, smoothing and vocabulary.  Every word and every bigram of every
document is counted by itself, under a 63-bit hash; the counts are a table in
the shared folder that grows with the corpus.  A token's loss under a model is
-log of (c(v w) + M p(w)) / (c(v) + M), p(w) = (c(w) + 1) / (N + distinct words);
a document's score is the mean over its tokens of target loss - background loss
(lower is nearer to the target).

The documents are dealt to blocks by a hash of their rows, so a block holds the
same documents whenever it is asked for.  Each block sends its distinct n-grams,
sorted, with its own counts of them, to the parts of the key range; a part sums
them and answers each block with the counts over all text, in the order in which
the block sent them, so an answer needs no keys.  Scoring takes the same blocks
again, sorts their n-grams as before and reads the answers off beside them.  An
n-gram crosses the shuffle once for each block that holds it, whatever it is and
however large the corpus; nothing is broadcast but ids of target documents, and
the driver gets three numbers.

The target is every document of quality 1.

Defined cases: null counts as empty; a text without tokens has no losses
(null) and score 0; repeated rows give repeated rows; without target text the
two models differ by smoothing alone; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import ngrams
from plumbline.llm.common import keep, partitions, read, small

#: Bins of ``model_counts``; the scores don't depend on them.
WORD_BITS = 18
PAIR_BITS = 21
SMOOTHING = 50.0
#: Arguments of ``score`` from when it broadcast n-grams and filtered others; both have no effect, as the result never depended on them.
FREQUENT = 1 << 21
FILTER_BITS = 28
#: Ids of target documents that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of text in a block, about (a longer text is whole); there are as many parts as blocks.
BLOCK = 1 << 23
#: N-grams that a block sums at once; more are summed by such runs first.
_HELD = 1 << 20
#: Low bytes of the distances between keys that are sent as they are; noise can't be compressed.
_NOISE = 5
_WORD = "key & 1 = 0"


def _batch_keys(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the start (0) and the words of each text with any, one text after another; of the pairs; and tokens of each text."""
    found = [ngrams.word_keys(t.as_py()) for t in texts]
    lengths = np.array([len(h) for h in found], np.int64)
    words = np.zeros(int((lengths + (lengths > 0)).sum()), np.uint64)
    token = np.ones(len(words), bool)
    token[_starts(lengths)] = False
    words[token] = np.concatenate(found) if found else words[token]
    return words, ngrams.pair_keys(words[:-1], words[1:])[token[1:]], lengths


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Where the start of each text with tokens stands among starts and words."""
    used = lengths[lengths > 0] + 1
    return np.cumsum(used) - used


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys sorted, and the order that sorts them (of equal keys, the earlier first)."""
    bits = np.uint64(max(1, len(keys) - 1).bit_length())
    # numbers are sorted much faster than indices: the place takes the key's last bits
    order = keys >> bits
    order <<= bits
    order |= np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order &= (np.uint64(1) << bits) - np.uint64(1)
    order = order.view(np.int64)
    found = keys[order]
    wrong = found[1:] < found[:-1]
    if wrong.any():  # different keys that agree but for their last bits
        high = found >> bits
        for same in np.unique(high[1:][wrong]):
            at = slice(*np.searchsorted(high, [same, same + np.uint64(1)]))
            order[at] = order[at][np.argsort(found[at], kind="stable")]
            found[at] = keys[order[at]]
    return found, order


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each distinct key begins among sorted ones."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)


def _summed(keys: np.ndarray, n: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted, with the sums of both counts."""
    keys, order = _ordered(keys)
    first = _firsts(keys)
    return keys[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in (n, target))


def _block_sums(texts, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of texts, sorted, with their counts and those in good texts."""
    words, pairs, lengths = _batch_keys(texts)
    keys = np.concatenate([words, pairs])
    target = np.concatenate([np.repeat(good, lengths + (lengths > 0)), np.repeat(good, lengths)]).astype(np.int64)
    runs = [_summed(keys[at : at + _HELD], np.ones(len(keys[at : at + _HELD]), np.int64), target[at : at + _HELD]) for at in range(0, max(1, len(keys)), _HELD)]
    return runs[0] if len(runs) == 1 else _summed(*map(np.concatenate, zip(*runs, strict=True)))


def _planes(x: np.ndarray) -> np.ndarray:
    """The lowest byte of every number, then the next ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)


def _numbers(planes: np.ndarray, size: int) -> np.ndarray:
    """The numbers of ``_planes``, by their count."""
    width = len(planes) // size
    return np.ascontiguousarray(planes.reshape(width, size).T).view(f"<u{width}")[:, 0]


def _packed_counts(pack, counts: np.ndarray) -> bytes:
    return pack.compress(_planes(counts.astype(np.min_scalar_type(counts.max()))).tobytes())


def _counts(unpack, data: bytes, size: int) -> np.ndarray:
    return _numbers(np.frombuffer(unpack.decompress(data), np.uint8), size).astype(np.int64)


def _packed_keys(pack, keys: np.ndarray) -> bytes:
    """Sorted keys by their distances."""
    planes = _planes(np.diff(keys, prepend=np.uint64(0)))
    return planes[:_NOISE].tobytes() + pack.compress(planes[_NOISE:].tobytes())


def _keys(unpack, data: bytes, size: int) -> np.ndarray:
    planes = np.concatenate([np.frombuffer(data[: _NOISE * size], np.uint8), np.frombuffer(unpack.decompress(data[_NOISE * size :]), np.uint8)])
    return np.cumsum(_numbers(planes, size), dtype=np.uint64)


def _n_blocks(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // BLOCK))


def _block(n: int, *columns: str):
    """The block of a row, by what it holds."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int").alias("block")


def _sent(docs: DataFrame, n_parts: int) -> DataFrame:
    """part, block, size, keys, n, target: the sorted n-grams of each block in each part's range of keys; docs: block, text, good."""

    def run(table: pa.Table) -> pa.Table:
        pack = zstandard.ZstdCompressor(level=1)
        keys, n, target = _block_sums(table.column("text"), np.array([bool(g) for g in table.column("good").to_pylist()]))
        ranges = (np.arange(n_parts, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(n_parts - 1)) // np.uint64(n_parts)
        ends = np.append(np.searchsorted(keys >> np.uint64(32), ranges), len(keys))
        used = np.flatnonzero(ends[1:] > ends[:-1])
        at = [slice(ends[i], ends[i + 1]) for i in used]
        columns = {
            "part": pa.array(used, pa.int32()),
            "block": pa.array([table.column("block")[0].as_py()] * len(used), pa.int32()),
            "size": pa.array([x.stop - x.start for x in at], pa.int32()),
            "keys": pa.array([_packed_keys(pack, keys[x]) for x in at], pa.binary()),
        }
        return pa.table(columns | {name: pa.array([_packed_counts(pack, c[x]) for x in at], pa.binary()) for name, c in (("n", n), ("target", target))})

    return docs.groupBy("block").applyInArrow(run, "part int, block int, size int, keys binary, n binary, target binary")


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys and counts that the blocks sent, one block after another."""
    unpack = zstandard.ZstdDecompressor()
    sizes = table.column("size").to_pylist()
    unpacked = ((f, table.column(name)) for f, name in ((_keys, "keys"), (_counts, "n"), (_counts, "target")))
    return tuple(np.concatenate([f(unpack, x.as_py(), size) for x, size in zip(column, sizes, strict=True)]) for f, column in unpacked)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """key (even: a word or the start; odd: a pair), n, target: counts over all text and over target text; docs: text, good."""

    def run(table: pa.Table) -> pa.Table:
        keys, n, target = _summed(*_received(table))
        return pa.table({"key": keys.view(np.int64), "n": n, "target": target})

    blocks = _n_blocks(docs)
    return _sent(docs.select(_block(blocks, "text"), "text", "good"), blocks).groupBy("part").applyInArrow(run, "key bigint, n bigint, target bigint")


def _answers(sent: DataFrame) -> DataFrame:
    """block, part, size, n, target: the counts over all text of the n-grams that each block sent, in its order.

    A row of block null for each part has, as words, n_words and n_target, its distinct words and their counts."""

    def run(table: pa.Table) -> pa.Table:
        pack = zstandard.ZstdCompressor(level=1)
        keys, n, target = _received(table)
        keys, order = _ordered(keys)
        first = _firsts(keys)
        back = np.empty(len(keys), np.int64)
        back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        word = keys[first] & np.uint64(1) == 0
        sizes = table.column("size").to_pylist()
        ends = np.cumsum([0, *sizes])
        rows, sums = {}, [int(word.sum())]
        for name, counts in (("n", n), ("target", target)):
            total = np.add.reduceat(counts[order], first)
            sums.append(int(total[word].sum()))
            rows[name] = pa.array([*(_packed_counts(pack, total[back[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)), None], pa.binary())
        block, part = ([*table.column(name).to_pylist()] for name in ("block", "part"))
        rows = {"block": pa.array([*block, None], pa.int32()), "part": pa.array([*part, part[0]], pa.int32()), "size": pa.array([*sizes, None], pa.int32())} | rows
        return pa.table(rows | {name: pa.array([None] * len(sizes) + [x], pa.int64()) for name, x in zip(("words", "n_words", "n_target"), sums, strict=True)})

    return sent.groupBy("part").applyInArrow(run, "block int, part int, size int, n binary, target binary, words bigint, n_words bigint, n_target bigint")


def model_counts(docs: DataFrame) -> np.ndarray:
    """(2, bins): the counts summed to fixed bins, words first, for a look at them; scores don't use it."""
    place = F.expr(f"CASE WHEN {_WORD} THEN pmod(shiftright(key, 1), {1 << WORD_BITS}) ELSE {1 << WORD_BITS} + pmod(shiftright(key, 1), {1 << PAIR_BITS}) END")
    table = ngram_counts(docs).groupBy(place.alias("bin")).agg(F.sum("n").alias("n"), F.sum("target").alias("target")).toArrow()
    out = np.zeros((2, (1 << WORD_BITS) + (1 << PAIR_BITS)), np.int64)
    out[:, table.column("bin").to_numpy()] = np.stack([table.column("n").to_numpy(), table.column("target").to_numpy()])
    return out


def score(docs: DataFrame, labels: DataFrame, frequent: int = FREQUENT, broadcast_rows: int = BROADCAST_ROWS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row."""
    known = keep(labels.where("quality = 1").select(F.col("doc_id").alias("label_id"), F.lit(True).alias("good")).where("label_id IS NOT NULL").distinct(), "target-ids")
    blocks = _n_blocks(docs)
    dealt = docs.select(_block(blocks, "doc_id", "text"), "doc_id", "text")
    marked = dealt.join(small(known, known.count(), broadcast_rows), F.col("doc_id") == F.col("label_id"), "left").select("block", "text", "good")
    answers = keep(_answers(_sent(marked, blocks)), "ngram-answers")
    size = answers.agg(F.sum("words"), F.sum("n_words"), F.sum("n_target")).first()
    distinct, totals = size[0] or 0, (size[1] or 0, size[2] or 0)

    def losses(words, pairs, token, n):
        p = (words[n][token] + 1.0) / (totals[n] + distinct)
        before = words[n][:-1][token[1:]]
        return -np.log((pairs[n] + SMOOTHING * p) / (before + SMOOTHING))

    def run(table: pa.Table, answer: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        answer = answer.sort_by("part")  # the parts are ranges of keys
        sizes = answer.column("size").to_pylist()
        words, pairs, lengths = _batch_keys(table.column("text"))
        keys, order = _ordered(np.concatenate([words, pairs]))
        first = _firsts(keys)
        if sum(sizes) != len(first):
            raise ValueError(f"{sum(sizes)} counts for {len(first)} n-grams: the input changed between two reads")
        counts = []
        for name in ("n", "target"):
            held = np.empty(len(keys), np.int64)
            if sizes:
                each = np.concatenate([_counts(unpack, x.as_py(), k) for x, k in zip(answer.column(name), sizes, strict=True)])
                held[order] = np.repeat(each, np.diff(np.append(first, len(keys))))
            counts.append(held)
        token = np.ones(len(words), bool)
        token[_starts(lengths)] = False
        words, pairs = [x[: len(token)] for x in counts], [x[len(token) :] for x in counts]
        none = lengths == 0
        first = (np.cumsum(lengths) - lengths)[~none]
        means = [np.zeros(len(lengths)), np.zeros(len(lengths))]
        for mean, m in zip(means, (1, 0), strict=True):
            if len(first):  # each document is summed by itself, whatever stands beside it
                mean[~none] = np.add.reduceat(losses(words, pairs, token, m), first) / lengths[~none]
        mean = [pa.array(np.round(x, 6), pa.float64(), mask=none) for x in means]
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(lengths), *mean, pa.array(np.round(means[0] - means[1], 6))], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    answered = answers.where("block IS NOT NULL").select("block", "part", "size", "n", "target")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, target_loss double, background_loss double, score double"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality"))


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
SQL: dict[str, str] = {}
