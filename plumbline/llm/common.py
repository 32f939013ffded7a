"""What the operators of this subpackage share: reading, cutting lineage, words.

Lineage is cut with Parquet tables in the shared folder that the session
names in ``spark.checkpoint.dir``; nothing is ever written to a folder of one
machine on a cluster.  A session that names none (tests) gets a temporary one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the words that only white space ends (space, tab to return).
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: Separators of alphanumeric words: all of ASCII but 0-9 and a-z.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder, by whatever file system Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; removed at exit."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:  # a session of one machine, as in tests
            base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
            spark.conf.set("spark.checkpoint.dir", base)
        folder = f"{base.rstrip('/')}/plumbline-{app}-{uuid.uuid4().hex[:8]}"
        _folders[app] = folder
        atexit.register(_remove, spark, folder)
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before the process
        pass


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: short lineage, survives lost executors.

    The shuffle files of the write go as soon as it is done, not when the driver next collects garbage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, most_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if its counted ``rows`` are within the bound; else Spark shuffles."""
    return F.broadcast(df) if rows <= most_rows else df.hint("merge")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def alnum_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return F.array_remove(F.split(ascii_lower(text), NOT_ALNUM), "")


def alnum_word_count(text: Column) -> Column:
    """How many words alnum_words has; letters of both cases count, so nothing is lower-cased."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def space_word_count(text: Column) -> Column:
    """How many words white space separates; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def uniform(seed: str, *cols: Column) -> Column:
    """A repeatable number in (0, 1) from the columns' text, the same in any SQL engine."""
    word = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("?")) for c in cols])), 1, 12)
    return (F.conv(word, 16, 10).cast("double") + 0.5) / float(1 << 48)
