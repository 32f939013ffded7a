"""Reports about the session, its host and its folders."""

from __future__ import annotations

import importlib.metadata
import os
import platform
import sys
import urllib.parse

from pyspark.sql import DataFrame, SparkSession


def session_summary(spark: SparkSession) -> DataFrame:
    rows = [("spark", spark.version), ("python", platform.python_version()), ("platform", platform.platform()), ("master", spark.sparkContext.master), ("application", spark.sparkContext.appName), ("timezone", spark.conf.get("spark.sql.session.timeZone")), ("shuffle partitions", spark.conf.get("spark.sql.shuffle.partitions"))]
    return spark.createDataFrame(rows, "name string, value string")


def packages(spark: SparkSession) -> DataFrame:
    """Loaded top-level packages with versions, ordered without regard to case."""
    names = {m.partition(".")[0] for m in sys.modules}
    owners = importlib.metadata.packages_distributions()
    found = sorted({(d, importlib.metadata.version(d)) for n in names for d in owners.get(n, [])}, key=lambda x: x[0].lower())
    return spark.createDataFrame(found, "package string, version string")


def folders(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = [(p, len(os.listdir(p)) if os.path.isdir(p) else None) for p in paths]
    return spark.createDataFrame(rows, "folder string, files long")


def url_parts(spark: SparkSession, url: str) -> DataFrame:
    u = urllib.parse.urlparse(url)
    return spark.createDataFrame([("scheme", u.scheme), ("host", u.hostname or ""), ("port", str(u.port or "")), ("path", u.path), ("query", u.query)], "part string, value string")
