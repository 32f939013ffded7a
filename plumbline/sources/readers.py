"""Files of many formats as DataFrames, chosen by extension."""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import tempfile
import urllib.error
import urllib.parse
import urllib.request
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.dataset import Dataset, no_nan
from plumbline.functions import geometry as G
from plumbline.types import retype

#: Formats in which a text column named geometry is read as WKT.
_PROMOTED = {".csv", ".tsv", ".xls", ".xlsx", ".parquet"}


def stem(path: str) -> str:
    """A dataset's default name: the file's name without its extension."""
    return os.path.splitext(os.path.basename(urllib.parse.urlparse(path).path if "://" in path else path))[0]


def extension(path: str) -> str:
    return os.path.splitext(urllib.parse.urlparse(path).path if "://" in path else path)[1].lower()


def url_exists(url: str, timeout: float = 5) -> bool:
    """Whether a HEAD request ends, after redirects, with status 200."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as answer:  # noqa: S310
            return answer.status == 200
    except (urllib.error.URLError, ValueError, OSError):
        return False


def download(url: str) -> str:
    """A web file as a local one; for cluster file systems Spark reads the address itself."""
    target = os.path.join(tempfile.mkdtemp(), os.path.basename(urllib.parse.urlparse(url).path) or "data")
    with urllib.request.urlopen(url, timeout=60) as answer, open(target, "wb") as f:  # noqa: S310
        shutil.copyfileobj(answer, f)
    return target


def read_file(spark: SparkSession, path: str, sep: str | None = None, sheet: int | str | None = None, **options) -> DataFrame:
    """One file by its extension.  Sheets are numbered from 1.  Unknown extensions are a ValueError."""
    ext = extension(path)
    if path.startswith(("http://", "https://")):
        path = download(path)
    reader = READERS.get(ext)
    if reader is None:
        raise ValueError(f"Unsupported file extension: {ext}")
    df = no_nan(reader(spark, path, ext=ext, sep=sep, sheet=sheet, **options))
    return promote_geometry(df) if ext in _PROMOTED else df


def read(spark: SparkSession, path: str, order_by=(), **options) -> Dataset | None:
    """A dataset named after its file; None if an uploaded file is gone."""
    if "://" not in path and not os.path.exists(path):
        return None
    return Dataset(read_file(spark, path, **options), name=stem(path), order_by=tuple(order_by))


def promote_geometry(df: DataFrame) -> DataFrame:
    """A text column named geometry as geometry, if all its values are WKT; else the plain column and a warning."""
    if dict(df.dtypes).get("geometry") != "string":
        return df
    filled = F.nullif(F.trim("geometry"), F.lit(""))
    bad = df.where(filled.isNotNull() & G.to_wkb(filled, "wkt").isNull()).limit(1).count()
    if bad:
        warnings.warn("column geometry is not WKT and stays text", stacklevel=2)
        return df
    return df.withColumn("geometry", G.to_wkb(filled, "wkt")).transform(retype, "geometry", "geometry", active=True)


def detect_separator(spark: SparkSession, path: str) -> str:
    """The candidate that occurs most in the header."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max((",", "\t", ";", "|"), key=lambda d: (line.count(d), d == ","))


def _csv(spark, path, *, ext, sep=None, sheet=None, **options):
    if sep == "auto":
        sep = detect_separator(spark, path)
    sep = sep or ("\t" if ext == ".tsv" else ",")
    settings = {"header": True, "inferSchema": True, "sep": sep, "enforceSchema": False, "escape": '"', "multiLine": True} | options
    return spark.read.options(**settings).csv(path)


def _excel(spark, path, *, sheet=None, **kw):
    import pandas as pd

    number = sheet - 1 if isinstance(sheet, int) else sheet
    return Dataset.of(pd.read_excel(path, sheet_name=0 if number is None else number), spark).df


def _feather(spark, path, **kw):
    import pyarrow.feather

    return spark.createDataFrame(pyarrow.feather.read_table(path.removeprefix("file://")))


def _geojson(spark, path, **kw):
    raw = spark.read.option("multiLine", True).option("prefersDecimal", False).text(path, wholetext=True)
    features = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    parts = features.select(F.get_json_object("f", "$.properties").alias("p"), F.get_json_object("f", "$.geometry").alias("g"))
    schema = spark.read.json(parts.where("p IS NOT NULL").select("p").rdd.map(lambda r: r[0])).schema  # of all features
    shape = G.to_wkb(F.col("g"), "geojson").alias("geometry", metadata={"semantic": "geometry", "crs": "EPSG:4326", "active": True})
    if not schema.fields:
        return parts.select(shape)
    return parts.select(F.from_json("p", schema).alias("p"), shape).select("p.*", "geometry")


def _geopackage(spark, path, *, sheet=None, **kw):
    """The named or first feature table of a SQLite container; the binary header before the geometry is taken off."""
    with sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True) as db:
        layers = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
        layer = next((x for x in layers if sheet in (None, x[0])), None)
        if layer is None:
            raise ValueError(f"no such layer: {sheet}")
        table, shape, srs = layer
        cursor = db.execute(f'SELECT * FROM "{table}"')  # noqa: S608
        names = [c[0] for c in cursor.description]
        rows = [list(r) for r in cursor]
    at = names.index(shape)
    for r in rows:
        if r[at] is not None:
            r[at] = bytearray(r[at][8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[r[at][3] >> 1 & 7] :])
    names[at] = "geometry"
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(rows, columns=names).astype(object).to_dict("records") or [], None if rows else ", ".join(f"`{n}` {'binary' if n == 'geometry' else 'string'}" for n in names))
    return retype(df.select(*names), "geometry", "geometry", crs=f"EPSG:{srs}", active=True)


def _xml(row_tag: str):
    def load(spark, path, **kw):
        return spark.read.format("xml").option("rowTag", row_tag).load(path)

    return load


def _grid(spark, path, **kw):
    """Multi-dimensional files need a reader that isn't always installed."""
    try:
        import xarray
    except ImportError as missing:
        raise ImportError("multi-dimensional files need the xarray package") from missing
    return Dataset.of(xarray.open_dataset(path).to_dataframe().reset_index(), spark).df


READERS = {
    ".csv": _csv, ".tsv": _csv, ".xls": _excel, ".xlsx": _excel, ".feather": _feather, ".geojson": _geojson, ".gpkg": _geopackage,
    ".parquet": lambda spark, path, **kw: spark.read.parquet(path),
    ".json": lambda spark, path, **kw: spark.read.option("multiLine", True).json(path),
    ".gml": _xml("gml:featureMember"), ".kml": _xml("Placemark"), ".nc": _grid, ".grib": _grid, ".h5": _grid, ".hdf5": _grid,
}


def summary(data: Dataset) -> dict[str, DataFrame]:
    """What an import shows: info, counts by column, descriptions of strings, and geometry."""
    from plumbline.operators import profile
    from plumbline.types import is_geometry

    df = data.df
    out = {"info": profile.info(df), "columns": profile.counts(df)}
    if any(t == "string" for _, t in df.dtypes):
        out["strings"] = profile.describe_categorical(df)
    for f in df.schema:
        if is_geometry(f):
            out["kinds"], out["bounds"] = profile.geometry_summary(df, f.name)
    return out


def geojson_text(shape: G.Shape) -> str:
    """GeoJSON of a shape."""
    if shape.code == 7:
        return json.dumps({"type": shape.name, "geometries": [json.loads(geojson_text(s)) for s in shape.coords]})
    return json.dumps({"type": shape.name, "coordinates": shape.coords})
