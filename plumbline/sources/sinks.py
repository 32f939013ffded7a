"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import geometry as G
from plumbline.types import is_geometry


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON and geometry as WKT, so that a text format can hold them."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if is_geometry(f):
            c = G.to_wkt(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.hex(c)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header; part files in parallel, or one file if asked for."""
    out = flat(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """With semantic metadata, which Parquet keeps."""
    df.write.mode("overwrite").parquet(path)
