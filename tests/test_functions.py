import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import basket as B
from plumbline.functions import geometry as G
from plumbline.functions import numbers as N
from plumbline.functions import text as X
from plumbline.functions.cyclic import Cycle
from plumbline.types import typed

DAYS = Cycle(categories=("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"))


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame([(0, "Sun"), (1, "Mon"), (2, None), (3, "Wed")], "i int, d string").coalesce(1)


def test_period_wraps(spark):
    df = spark.createDataFrame([(float(x),) for x in (-720, -360, -1, 360, 721)], "x double").coalesce(1)
    assert column(df, Cycle(period=360).values(F.col("x"))) == [0, 0, 359, 0, 1]


def test_codes_and_shifts(days):
    d = F.col("d")
    assert column(days, DAYS.codes(d)) == [6, 0, None, 2]
    assert column(days, DAYS.shift(d)) == ["Mon", "Tue", None, "Thu"]
    assert column(days, DAYS.predecessor(d)) == ["Sat", "Sun", None, "Tue"]
    assert column(days, DAYS.shift(d, 8)) == ["Mon", "Tue", None, "Thu"]


def test_distance(days, spark):
    assert column(days, DAYS.distance(F.col("d"), "Tue")) == [2, 1, None, 1]
    df = spark.createDataFrame([(359.0,), (0.0,), (1.0,)], "x double").coalesce(1)
    assert column(df, Cycle(period=360).distance(F.col("x"), 1, signed=True)) == [2, 1, 0]
    with pytest.raises(ValueError, match="not in the cycle"):
        DAYS.distance(F.col("d"), "Noday")


def test_equality(days, spark):
    assert column(days, DAYS.equals(F.col("d"), "Mon")) == [False, True, False, False]
    assert column(days, DAYS.equals(F.col("d"), "Noday")) == [False] * 4
    df = spark.createDataFrame([(1.0,), (None,)], "x double").coalesce(1)
    assert column(df, Cycle(period=360).equals(F.col("x"), 361)) == [True, False]


def test_strict_names_the_label(spark):
    df = spark.createDataFrame([("Noday",)], "d string")
    with pytest.raises(Exception, match="Noday"):
        df.select(DAYS.strict(F.col("d"))).collect()


@pytest.mark.parametrize(("kw", "error"), [({}, TypeError), ({"categories": ("a", "b"), "period": 2}, TypeError), ({"categories": ("a",)}, ValueError), ({"categories": ("a", "a")}, ValueError), ({"categories": ("a", None)}, ValueError), ({"period": 0}, ValueError), ({"period": math.inf}, ValueError), ({"period": True}, ValueError)])
def test_cycles_are_checked(kw, error):
    with pytest.raises(error):
        Cycle(**kw)


@pytest.fixture(scope="module")
def baskets(spark):
    rows = [(10, ["apples", "milk"]), (20, ["bread", "cheese"]), (30, None), (40, ["biscuits", "jam"]), (50, [])]
    return spark.createDataFrame(rows, "i int, b array<string>").coalesce(1)


def test_baskets(baskets):
    b = F.col("b")
    assert column(baskets, B.lengths(b)) == [2, 2, None, 2, 0]
    assert column(baskets, B.contains(b, "milk")) == [True, False, None, False, False]
    rows = [(r["i"], r["item"]) for r in B.explode(baskets, "b").collect()]
    assert rows == [(10, "apples"), (10, "milk"), (20, "bread"), (20, "cheese"), (30, None), (40, "biscuits"), (40, "jam"), (50, None)]
    wide = B.indicators(baskets, "b").orderBy("i")
    assert wide.columns == ["i", "apples", "biscuits", "bread", "cheese", "jam", "milk"]
    assert [r["milk"] for r in wide.collect()] == [True, False, False, False, False]


def test_contains_with_missing_item(spark):
    df = spark.createDataFrame([(["a", None],)], "b array<string>")
    assert column(df, B.contains(F.col("b"), "x")) == [False]


def test_delimited(spark):
    texts = ['"Smith, John",bread', "a, b", "a,,b", "one", None, '"say ""hi""", x']
    df = spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1)
    assert column(df, B.parse_delimited(F.col("x"), ",")) == [["Smith, John", "bread"], ["a", "b"], None, ["one"], None, ['say "hi"', "x"]]
    df = spark.createDataFrame([("a|b",), ("a||b",)], "x string").coalesce(1)
    assert column(df, B.parse_delimited(F.col("x"), "|")) == [["a", "b"], None]
    assert column(df, B.parse_delimited(F.col("x"), "||")) == [["a|b"], ["a", "b"]]


def test_json_lists(spark):
    df = spark.createDataFrame([('["a","b"]',), ('{"a":1}',), ("x",), (None,)], "x string").coalesce(1)
    assert column(df, B.is_json_list(F.col("x"))) == [True, False, False, False]
    assert column(df, B.parse_json(F.col("x"))) == [["a", "b"], None, None, None]


def test_text(spark):
    df = spark.createDataFrame([("One two  three.",), ("héé",), (None,), ("",)], "x string").coalesce(1)
    assert column(df, X.word_counts(F.col("x"))) == [3, 1, None, 0]
    assert column(df, X.lengths(F.col("x"))) == [15, 3, None, 0]
    df = spark.createDataFrame([("ABaba",), ("x",), ("",)], "x string").coalesce(1)
    assert column(df, F.array_sort(X.qgrams(F.col("x"), 2))) == [["ab", "ab", "ba", "ba"], ["x"], []]
    b = spark.createDataFrame([(True,), (False,), (None,)], "x boolean").coalesce(1)
    assert column(b, X.as_text(b.schema["x"], "coerce")) == ["True", "False", None]
    with pytest.raises(TypeError):
        X.as_text(b.schema["x"])


def test_numbers(spark):
    texts = ["1", " 2.5 ", "-1e3", "1f", "2.5d", "1_000", "1,000", "0x10", "True", "inf", "-Infinity", "nan", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1)
    found = column(df, N.to_number(F.col("x"), df.schema["x"].dataType))
    assert found == [1, 2.5, -1000, None, None, None, None, None, None, math.inf, -math.inf, None, None, None]


def test_dates(spark):
    df = spark.createDataFrame([("2024-1-5",), ("2024-02-30",), ("2024-01-05 10:00:00",), ("x",)], "x string").coalesce(1)
    assert [str(v)[:10] if v else None for v in column(df, N.to_timestamp(F.col("x"), "%Y-%m-%d"))] == ["2024-01-05", None, None, None]
    df = spark.createDataFrame([("5 jan 2024",), ("16 May 2026",)], "x string").coalesce(1)
    assert [str(v)[:10] for v in column(df, N.to_timestamp(F.col("x"), "%d %b %Y"))] == ["2024-01-05", "2026-05-16"]
    with pytest.raises(ValueError):
        N.java_format("%Q")


def test_decimal_places(spark):
    df = spark.createDataFrame([("1",), ("1.2",), ("1.23000",), ("nan",), (None,)], "x string").coalesce(1)
    assert column(df, N.decimal_places(F.col("x"))) == [0, 1, 2, None, None]


WKT = ["POINT (1 2)", "LINESTRING (1 2, 3 5)", "POLYGON ((0 0, 4 0, 4 3, 0 0))", "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "POINT Z (1 2 3)", "POINT EMPTY"]


@pytest.mark.parametrize("wkt", WKT)
def test_geometry_round_trip(wkt):
    shape = G.read_wkt(wkt)
    assert G.write_wkt(G.read_wkb(G.write_wkb(shape))) == wkt


@pytest.mark.parametrize("bad", ["", "POINT", "POINT (1)", "POINT (1 2", "LINESTRING (1 2)", "POLYGON ((0 0, 1 1, 2 2))", "hello", "POINT (1 2) x", "CIRCLE (1 2)"])
def test_bad_wkt(bad):
    assert G.read_wkt(bad) is None


def test_wkb_and_geojson():
    assert G.read_wkb(b"\x01\x02") is None
    assert G.read_wkb(b"not wkb at all") is None
    assert G.read_geojson('{"type": "Point", "coordinates": [1, 2]}').coords == (1.0, 2.0)
    assert G.read_geojson('{"type": "Feature", "geometry": null}') is None
    assert G.read_geojson("[1, 2]") is None


def test_geometry_columns(spark):
    df = spark.createDataFrame([(1, "POINT(174.76334 -36.84846)"), (2, "LINESTRING (1 2, 3 5)"), (3, " "), (4, None)], "i int, g string")
    g = df.select("i", G.as_geometry(F.col("g"), "g", "wkt", crs="EPSG:4326"))
    assert g.schema["g"].metadata == {"semantic": "geometry", "crs": "EPSG:4326"}
    assert [r[0] for r in g.orderBy("i").select(G.display(F.col("g"))).collect()] == ["Point(174.7633, -36.8485)", "LineString bound by 1.0000,2.0000 to 3.0000,5.0000", None, None]
    with pytest.raises(Exception, match="not valid WKT"):
        spark.createDataFrame([("x",)], "g string").select(G.as_geometry(F.col("g"), "g", "wkt")).collect()


@pytest.mark.parametrize(("pair", "options", "ok"), [([174.7, -36.8], {}, True), ([-36.8, 174.7], {}, True), ([174.7, -36.8], {"order": "lat-lon"}, False), ([200.0, 10.0], {}, False), ([200.0, 10.0], {"allow_longitude_360": True}, True), ([1.0], {}, False), ([1.0, 2.0, 3.0], {}, True), ([1.0, 2.0, 3.0], {"allow_z": False}, False), ([math.nan, 1.0], {}, False), ([1.25, 2.0], {"min_decimal_places": 2}, True), ([1.25, 2.0], {"min_decimal_places": 2, "require_both_precise": True}, False)])
def test_coordinates(spark, pair, options, ok):
    df = spark.createDataFrame([(pair,)], "p array<double>")
    assert column(df, G.is_coordinate(F.col("p"), **options)) == [ok]


def test_coordinate_points(spark):
    df = spark.createDataFrame([([-36.8, 174.7],), ([174.7, -36.8],)], "p array<double>").coalesce(1)
    assert [tuple(p) for p in column(df, G.coordinate_point(F.col("p")))] == [(174.7, -36.8)] * 2
    with pytest.raises(ValueError):
        G.is_coordinate(F.col("p"), order="up")


def test_metadata_is_kept(spark):
    df = spark.createDataFrame([("a",)], "x string").select(typed(F.upper("x"), "x", "text"))
    assert df.where("x = 'A'").schema["x"].metadata == {"semantic": "text"}
