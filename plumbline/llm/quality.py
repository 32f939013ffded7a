"""Quality selection by importance resampling over hashed n-grams.

Two generative models over the same ``2**BITS`` bins of word unigrams and
bigrams: one of the raw documents, one of target text (labelled good).  A
document's log importance weight is the sum over its n-grams of
log p_target - log p_raw.  The k documents of largest weight plus Gumbel noise
are taken, which is sampling without replacement in proportion to the weights.

The raw counts cover all documents.  The target counts, and the choice of k,
use at most ``LABELLED`` labelled documents of each class, those of smallest
id hash: k is how many documents weigh at least as much as the cut that best
parts the labelled classes (without both classes: as much as 1).

Weights are integers of 2**-SCALE, so a weight does not depend on how rows
are batched, and a second pass over the text finds the same keys.

Defined cases: null counts as empty; a text without tokens has log weight 0
and is judged by its noise alone; a null id counts as the text "None" in the
noise; equal keys are ordered by id; rows that repeat an id and text share
the decision; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import ngrams
from plumbline.llm.common import keep, read
from plumbline.llm.topk import top

BITS = 14
#: Labelled documents of each class at most.
LABELLED = 20_000
SCALE = 20
SEED = "quality"


def labelled(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """label_id, good: at most ``most`` labelled documents of each class."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg((F.max("quality") == 1).alias("good"))
    by_hash = F.xxhash64("label_id")
    return one.where("good").orderBy(by_hash, "label_id").limit(most).unionByName(one.where("NOT good").orderBy(by_hash, "label_id").limit(most))


def _features(text: str | None) -> np.ndarray:
    h = ngrams.token_hashes(text)
    return np.concatenate([ngrams.bins(h, BITS), ngrams.pair_bins(h, BITS)]) if len(h) else np.empty(0, np.int64)


def feature_counts(docs: DataFrame) -> np.ndarray:
    """(2, bins): counts of raw and of target text; docs: text, good.  Tasks send sums of bins."""

    def run(batches):
        sums = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1), strict=True):
                n = np.bincount(_features(text.as_py()), minlength=1 << BITS)
                sums[0] += n
                if good.as_py():
                    sums[1] += n
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0][used]), pa.array(sums[1][used])], ["bin", "raw", "target"])

    found = docs.select("text", "good").mapInArrow(run, "bin bigint, raw bigint, target bigint").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    out = np.zeros((2, 1 << BITS), np.int64)
    out[:, found["bin"].to_numpy()] = np.stack([found["raw"].to_numpy(), found["target"].to_numpy()])
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Fixed-point log p_target - log p_raw of each bin, smoothed by the raw distribution."""
    raw = (counts[0] + 0.5) / (counts[0].sum() + 0.5 * counts.shape[1])
    target = (counts[1] + 10.0 * raw) / (counts[1].sum() + 10.0)
    return np.rint(np.log(target / raw) * (1 << SCALE)).astype(np.int64)


def _keyed(ratios: np.ndarray, row_id, text: str | None) -> tuple[int, int]:
    """Log weight and key in fixed point."""
    weight = int(ratios[_features(text)].sum())
    noise = -math.log(-math.log(ngrams.uniform(SEED, row_id)))
    return weight, weight + round(noise * (1 << SCALE))


class Selection:
    """What decides: the ratios, and the least key that is taken."""

    def __init__(self, docs: DataFrame, labels: DataFrame, most: int = LABELLED):
        spark = docs.sparkSession
        known = F.broadcast(keep(labelled(labels, most), "labelled"))  # at most 2 * most rows
        marked = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("label_id"), "left")
        self.ratios = spark.sparkContext.broadcast(log_ratios(feature_counts(marked)))
        self.scores = keep(self._scores(marked), "quality-keys")
        cut = self._part(self.scores.where("good IS NOT NULL").groupBy("doc_id").agg(F.max("log_weight").alias("w"), F.max("good").alias("good")).select("w", "good").toArrow())
        k = self.scores.where(F.col("log_weight") >= cut).where("doc_id IS NOT NULL").count()
        self.k = k
        self.least, self.last = top(self.scores.where("doc_id IS NOT NULL"), k) if k else (1 << 62, None)

    @staticmethod
    def _part(found) -> int:
        """The log weight that best parts good from bad, in the middle between them."""
        w, good = found["w"].to_numpy(), found["good"].to_numpy().astype(bool)
        if not good.any() or good.all():
            return 0
        order = np.argsort(w, kind="stable")
        w, good = w[order], good[order]
        # errors of a cut before place i: good ones below, bad ones from it on
        errors = np.concatenate([[0], np.cumsum(good)]) + (np.count_nonzero(~good) - np.concatenate([[0], np.cumsum(~good)]))
        best = np.flatnonzero(errors == errors.min())
        i = int(best[len(best) // 2])
        return int(w[0]) if i == 0 else int(w[-1]) + 1 if i == len(w) else int(w[i - 1] + w[i] + 1) // 2

    def _scores(self, marked: DataFrame) -> DataFrame:
        ratios = self.ratios

        def run(batches):
            for batch in batches:
                found = [_keyed(ratios.value, i.as_py(), t.as_py()) for i, t in zip(batch.column(0), batch.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "good", "log_weight", "key"])

        return marked.select("doc_id", "text", "good").mapInArrow(run, f"doc_id {marked.schema['doc_id'].dataType.simpleString()}, good boolean, log_weight bigint, key bigint")

    def filter(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that are taken, all columns; keys are made anew, so that no text is shuffled."""
        ratios, least, last = self.ratios, self.least, self.last
        at = docs.columns.index("doc_id"), docs.columns.index("text")

        def run(batches):
            for batch in batches:
                ids, texts = batch.column(at[0]), batch.column(at[1])
                taken = []
                for i, t in zip(ids, texts, strict=True):
                    row_id = i.as_py()
                    key = _keyed(ratios.value, row_id, t.as_py())[1]
                    taken.append(key > least or (key == least and (row_id is None or last is None or row_id <= last)))
                yield batch.filter(pa.array(taken, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    def decisions(self) -> DataFrame:
        """doc_id, log_weight, key, kept of every row."""
        kept = F.col("key") > self.least
        if self.last is not None:
            kept = kept | ((F.col("key") == self.least) & (F.col("doc_id").isNull() | (F.col("doc_id") <= self.last)))
        unit = float(1 << SCALE)
        return self.scores.select("doc_id", F.round(F.col("log_weight") / unit, 6).alias("log_weight"), F.round(F.col("key") / unit, 6).alias("gumbel_key"), kept.alias("kept"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return Selection(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality")).decisions()


QUERIES = {"op6_quality": op6_quality}
SQL: dict[str, str] = {}
