"""The corpus pipeline: documents to a training mix in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that
the stage before it kept; between stages the rows are a Parquet table in the
shared folder.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import keep, read
from plumbline.llm.decontaminate import remove_contaminated
from plumbline.llm.line_dedup import drop_lines
from plumbline.llm.mixing import mixed_documents
from plumbline.llm.quality import Selection
from plumbline.llm.simhash import drop_near_duplicates


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards labelled good text takes; the others go."""
    return Selection(docs.select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality")).filter(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand, up to two edits, earlier in the corpus go; so do documents left without a line."""
    return drop_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return remove_contaminated(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with size, source_size, target and the words taken."""
    return mixed_documents(docs, read(spark, sf_dir, "labels"))


STAGES = [
    ("quality classifier", select_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
]

#: Hash fingerprints and trained ratios have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = keep(docs, f"stage-{n}")
    return docs
