"""Language identification by error-correcting output codes.

Every language has a codeword; a binary classifier for each bit tells, from
hashed byte n-grams, languages whose codeword has that bit from the others.
The classifiers are the log-odds of the pooled n-gram distributions of the two
sides.  A text's bit margins are mean log-odds over its n-grams; the codeword
of least loss-weighted distance, sum of log(1 + exp(-code * margin)), is the
answer.  ``score`` is the answer's share of exp(-distance) over all codewords,
and ``ambiguous`` says that the runner-up is nearly as near.

Up to seven languages have the exhaustive code (2**(n-1) - 1 bits, every way
to part the languages); more have a seeded random code of 15 log2(n) bits.
Counts are sums over all training documents, by language and bin.

Training never sees documents whose crc32(id as text) mod 4 is 2, and uses
only text and lang.  Defined cases: a null text, or one without a letter, is
``und`` with score 0; a null lang isn't learned from; without any training
text all are ``und``; one language is always the answer, with score 1; equal
distances go to the language first by name; a null id is not held out and not
learned from; repeated rows give repeated rows.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import read

BITS = 15
HELD_OUT = 2
#: Margins are multiplied by this before the loss.
SHARPNESS = 4.0
#: Below this lead of the best codeword's distance over the next a row is ambiguous.
LEAD = 0.5
_LETTER = re.compile(r"[^\W\d_]")
#: Lower-case letters and bytes beyond ASCII stay, everything else is a gap.
_GAP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Bins of the byte trigrams and byte bigrams of a text, gaps as one space."""
    a = np.frombuffer(b" " + b" ".join(text.encode(errors="surrogatepass").translate(_GAP).split()) + b" ", np.uint8).astype(np.uint32)
    two = a[:-1] << 8 | a[1:]
    three = two[:-1] << 8 | a[2:]
    return np.concatenate([(x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS) for x in (two + np.uint32(1 << 24), three)])


def held_out(row_id: Column) -> Column:
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def language_counts(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name, and their counts (languages, bins); docs: text, lang."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << BITS, np.int64)
                sums[lang] += np.bincount(features(text.as_py()), minlength=1 << BITS)
        for lang, n in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(n[used])], ["lang", "bin", "n"])

    found = docs.select("text", "lang").mapInArrow(run, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(found["lang"].unique().to_pylist())
    out = np.zeros((len(langs), 1 << BITS), np.int64)
    place = {lang: i for i, lang in enumerate(langs)}
    out[[place[lang] for lang in found["lang"].to_pylist()], found["bin"].to_numpy()] = found["n"].to_numpy()
    return langs, out


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1, no two rows equal, no constant or repeated column."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        rows = np.array([[1, *rest] for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest], np.int8)
        return rows.T
    bits, choose, best = math.ceil(15 * math.log2(n)), np.random.default_rng(n), None
    for _ in range(50):
        code = choose.choice(np.array([1, -1], np.int8), (n, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2 + bits * np.eye(n, dtype=int)
        if np.abs(code.sum(axis=0)).max() < n and (best is None or apart.min() > best[0]):
            best = apart.min(), code
    return best[1]


class Classifier:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1]) if len(langs) else counts
        sides = [(share[bit > 0].mean(axis=0), share[bit < 0].mean(axis=0)) for bit in self.code.T]
        self.odds = np.array([np.log(a / b) for a, b in sides], np.float32).T if sides else np.zeros((1 << BITS, 0), np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not _LETTER.search(text):
            return "und", 0.0, True
        bins = features(text)
        margin = self.odds[bins].mean(axis=0, dtype=np.float64) * SHARPNESS
        distance = np.logaddexp(0, -self.code * margin[None, :]).sum(axis=1)
        best = int(distance.argmin())
        share = np.exp(distance[best] - distance)
        lead = np.partition(distance, 1)[1] - distance[best] if len(distance) > 1 else math.inf
        return self.langs[best], round(float(1 / share.sum()), 6), bool(lead < LEAD)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; docs: doc_id, text, lang."""
    training = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(Classifier(*language_counts(training)))

    def run(batches):
        classifier = model.value
        for batch in batches:
            found = [classifier.predict(t.as_py()) for t in batch.column(2)]
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
