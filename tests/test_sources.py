import json
import sqlite3
import struct

import pandas as pd
import pyarrow as pa
import pyarrow.feather
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.sources import catalogues
from plumbline.sources.readers import extension, read, read_file, stem, summary, url_exists
from plumbline.sources.sinks import write_csv, write_parquet
from plumbline.types import friendly, retype


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,value,group\n1,1.5,x\n2,2.5,\n")
    (tmp_path / "b.TSV").write_text("id\tvalue\n1\t2\n")
    (tmp_path / "c.csv").write_text("id;value\n1;2\n")
    assert rows(read_file(spark, str(tmp_path / "a.csv"))) == [(1, 1.5, "x"), (2, 2.5, None)]
    assert rows(read_file(spark, str(tmp_path / "b.TSV"))) == [(1, 2)]
    assert rows(read_file(spark, str(tmp_path / "c.csv"), sep="auto")) == [(1, 2)]
    assert read(spark, str(tmp_path / "a.csv")).name == "a"
    assert read(spark, str(tmp_path / "gone.csv")) is None
    with pytest.raises(ValueError, match="Unsupported file extension: .xyz"):
        read_file(spark, str(tmp_path / "a.xyz"))


def test_other_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "v": "x"}, {"id": 2, "v": None}]))
    assert rows(read_file(spark, str(tmp_path / "a.json")))[0] == (1, "x")
    pyarrow.feather.write_feather(pa.table({"id": [1, 2]}), str(tmp_path / "a.feather"))
    assert rows(read_file(spark, str(tmp_path / "a.feather"))) == [(1,), (2,)]
    pd.DataFrame({"id": [1]}).to_parquet(tmp_path / "a.parquet")
    assert rows(read_file(spark, str(tmp_path / "a.parquet"))) == [(1,)]


def test_geometry_promotion(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,geometry\n1,"POINT (1 2)"\n2,\n')
    df = read_file(spark, str(tmp_path / "a.csv"))
    assert friendly(df.schema["geometry"]) == "geometry"
    assert [r[0] for r in df.orderBy("id").select(G.to_wkt(F.col("geometry"))).collect()] == ["POINT (1 2)", None]
    (tmp_path / "b.csv").write_text("id,geometry\n1,cube\n")
    with pytest.warns(UserWarning):
        assert friendly(read_file(spark, str(tmp_path / "b.csv")).schema["geometry"]) == "code"


def test_spatial(spark, tmp_path):
    features = [{"type": "Feature", "properties": {"n": i}, "geometry": {"type": "Point", "coordinates": [i, 2]}} for i in (1, 2)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    df = read_file(spark, str(tmp_path / "a.geojson"))
    assert sorted(r[0] for r in df.select(G.to_wkt(F.col("geometry"))).collect()) == ["POINT (1 2)", "POINT (2 2)"]
    with sqlite3.connect(tmp_path / "a.gpkg") as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('t', 'geom', 4326)")
        db.execute("CREATE TABLE t (fid INTEGER, geom BLOB)")
        db.execute("INSERT INTO t VALUES (1, ?)", (b"GP\x00\x01" + struct.pack("<i", 4326) + G.write_wkb(G.read_wkt("POINT (3 4)")),))
    df = read_file(spark, str(tmp_path / "a.gpkg"))
    assert df.select(G.to_wkt(F.col("geometry"))).first()[0] == "POINT (3 4)"
    (tmp_path / "a.kml").write_text("<kml><Document><Placemark><name>x</name></Placemark></Document></kml>")
    assert read_file(spark, str(tmp_path / "a.kml")).first()["name"] == "x"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "x,\"y\"")], "i int, l array<string>, s string")
    write_csv(df, str(tmp_path / "o.csv"), single=True)
    assert rows(read_file(spark, str(tmp_path / "o.csv"))) == [(1, '["a","b"]', 'x,"y"')]
    write_parquet(retype(df, "s", "text"), str(tmp_path / "o.parquet"))
    assert friendly(spark.read.parquet(str(tmp_path / "o.parquet")).schema["s"]) == "text"


def test_catalogue(spark):
    catalogues.register("own", lambda: ["b", "A"], lambda n: pd.DataFrame({"n": [n]}))
    assert catalogues.load(spark, "own::b").df.first()[0] == "b"
    assert [r[1] for r in catalogues.catalogue(spark).where("package = 'own'").collect()] == ["A", "b"]
    with pytest.raises(ValueError):
        catalogues.load(spark, "nope::x")
    assert catalogues.numbered_names("Iris      53\n---\nWine Quality   186\n") == ["Iris", "Wine Quality"]


def test_names():
    assert stem("/a/b/data.v1.csv") == "data.v1" and stem("https://x.org/f/data.csv?q=1") == "data"
    assert extension("https://x.org/f/data.CSV?q=1") == ".csv"
    assert url_exists("not a url") is False


def test_summary(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,g\n1,x\n2,x\n3,y\n")
    found = summary(read(spark, str(tmp_path / "a.csv")))
    assert tuple(found["strings"].first()) == ("g", 3, 2, "x", 2)


def test_stream_profile(spark, tmp_path):
    from plumbline.operators import profile
    from plumbline.streaming.profile import profiled

    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = profiled(stream, profile.counts, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["non_null"] == 5


def test_geojson_properties_of_all_features(spark, tmp_path):
    point = {"type": "Point", "coordinates": [1, 2]}
    features = [{"type": "Feature", "properties": {"a": i}, "geometry": point} for i in range(1200)]
    features.append({"type": "Feature", "properties": {"a": 0.5, "late": "x"}, "geometry": point})
    (tmp_path / "late.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    df = read_file(spark, str(tmp_path / "late.geojson"))
    assert dict(df.dtypes)["a"] == "double"
    assert [(r.a, r.late) for r in df.where("late IS NOT NULL").collect()] == [(0.5, "x")]
    bare = [{"type": "Feature", "properties": None, "geometry": point}]
    (tmp_path / "bare.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": bare}))
    assert read_file(spark, str(tmp_path / "bare.geojson")).columns == ["geometry"]
