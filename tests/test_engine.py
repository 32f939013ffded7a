import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.dataset import Dataset
from plumbline.operators import cluster, convert, dissimilarity, evidence, placeholders, preview, profile, sampling
from plumbline.operators.validate import validate
from plumbline.plans.pipeline import MOST_COPIES, Pipeline
from plumbline.roles import Role, RoleMap
from plumbline.types import friendly, label, retype


@pytest.fixture(scope="module")
def seeded(spark):
    rows = [(1, 10.0, "A", 100, "Train"), (0, 11.0, "B", 101, "Train"), (1, 12.0, "A", 102, "Test"), (0, 13.0, "B", 103, "Test")]
    return spark.createDataFrame(rows, "y long, x1 double, x2 string, id long, part string")


VALID = {"target": ["y"], "predictor": ["x1", "x2"], "identifier": ["id"], "partition": ["part"]}


def test_roles():
    m = RoleMap.from_primitive(VALID)
    assert Role.of(" Target ") is Role.TARGET
    with pytest.raises(ValueError):
        Role.of("boss")
    with pytest.raises(TypeError):
        Role.of(3)
    assert RoleMap.from_json(m.to_json()) == m
    assert list(m.to_primitive()) == [r.value for r in Role]
    m.add("x1", "weighting")
    m.remove("x1", "predictor")
    m.remove("x1", "weighting")
    assert "x1" not in m.roles
    m.rename("x2", "z")
    assert m.has("z", "predictor")
    with pytest.raises(KeyError):
        m.rename("gone", "z")


def test_validation(seeded):
    assert validate(Dataset(seeded, VALID)) == []
    assert validate(Dataset(seeded, {})) == [""]
    bad = {"target": ["y", "x1"], "identifier": ["x2"], "partition": ["id"], "weighting": ["part"]}
    assert validate(Dataset(seeded, bad)) == ["Target role must be singular", "Predictor role must be assigned to a variable", "Identifier/Sequence combination must be unique", "Partition role must have cardinality 2", "Weighting role must be numeric"]
    odd = validate(Dataset(seeded, {"predictor": ["x1", "nope"]}))
    assert odd[0].startswith("Columns present in data but missing from role map: id, part") and odd[1].endswith(": nope")
    gaps = seeded.withColumn("y", F.nullif("y", F.lit(1)))
    assert "Target role has missing values" in validate(Dataset(gaps, VALID))
    assert "Data has no observations" in validate(Dataset(seeded.limit(0), VALID))


def test_dataset(seeded, spark):
    d = Dataset(seeded, VALID, name="s")
    assert d.select_types("number").columns == ["y", "x1", "id"]
    assert d.select_roles(include=["predictor"]).columns == ["x1", "x2"]
    assert d.select_roles(exclude="predictor").columns == ["y", "id", "part"]
    with pytest.raises(ValueError):
        d.select_roles(include="target", exclude="target")
    assert Dataset(seeded).roles == RoleMap.uniform(seeded.columns)
    swapped = d.rename({"x1": "x2", "x2": "x1"})
    assert swapped.columns == ["y", "x2", "x1", "id", "part"] and swapped.roles.has("x2", "predictor")
    with pytest.raises(ValueError):
        d.rename({"x1": "y"})
    assert d.equals(Dataset(seeded.orderBy("x1"), VALID, name="s")) and not d.equals(d.named("t"))
    made = Dataset.of(pd.DataFrame({"a": [1.0, math.nan]}), spark)
    assert made.df.where("a IS NULL").count() == 1
    with pytest.raises(TypeError):
        Dataset.of(3, spark)


def test_samples(spark):
    df = spark.range(10).toDF("i").repartition(3)
    ids = lambda x: [r[0] for r in x.collect()]
    assert ids(sampling.sample(df, "i", 4)) == [0, 1, 8, 9]
    assert ids(sampling.sample(df, "i", 5)) == [0, 1, 7, 8, 9]
    assert len(ids(sampling.sample(df, "i", 50))) == 10
    a, b = (ids(sampling.sample(df, "i", 4, "random", seed=s)) for s in (1, 1))
    assert a == b == sorted(set(a)) and len(a) == 4
    for limit in (1, 2, 3, 4, 7, 9):
        assert ids(sampling.sample(df, "i", limit, "spaced")) == np.linspace(0, 9, num=limit, dtype=int).tolist()
    assert ids(sampling.take(df, ["i"], [3, -1, 3])) == [3, 9, 3]
    assert ids(sampling.take(df, ["i"], [3, -1], allow_fill=True)) == [3, None]
    with pytest.raises(ValueError):
        sampling.sample(df, "i", 3, "odd")
    with pytest.raises(IndexError):
        sampling.take(df, ["i"], [10])


def frame(spark, values, kind="string", name="x"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")


def test_cyclic_evidence(spark):
    e = evidence.cyclic_evidence(frame(spark, ["Jan", "feb", "MAR", "apr", "may", "jun"]), "x")
    assert (e.matches, e.confidence, e.cycle, e.period) == (True, "strong", "month_abbreviation", 12)
    assert not evidence.cyclic_evidence(frame(spark, ["mon", "noday"]), "x").matches
    e = evidence.cyclic_evidence(frame(spark, [0, 5, 23], "int", "hour"), "hour")
    assert (e.confidence, e.period, e.cycle) == ("strong", 24, "hour")
    e = evidence.cyclic_evidence(frame(spark, [1, 2, 3, 4, 5, 6, 7], "int"), "x")
    assert (e.confidence, e.period) == ("plausible", 7)
    e = evidence.cyclic_evidence(frame(spark, ["2024-01-01"], "string").select(F.to_date("x").alias("x")), "x")
    assert (e.matches, e.confidence) == (False, "certain")
    assert evidence.cyclic_evidence(frame(spark, [None], "string"), "x").confidence == "unknown"


@pytest.mark.parametrize("d", [",", "|", ";", "\t", "%"])
def test_list_evidence(spark, d):
    e = evidence.list_evidence(frame(spark, [f"a{d}b", f"c{d}d", None]), "x")
    assert (e.matches, e.confidence, e.delimiter) == (True, "plausible", d)


def test_list_evidence_kinds(spark):
    assert evidence.list_evidence(frame(spark, ['["a","b"]', '["c","d"]']), "x").representation == "json-array"
    assert evidence.list_evidence(frame(spark, [["a"]], "array<string>"), "x").confidence == "certain"
    prose = ["This is a sentence, with a comma and many other words.", "Another one, also with words. And more."]
    assert not evidence.list_evidence(frame(spark, prose), "x").matches


def test_text_evidence(spark):
    good = ["The first comment has a number of words.", "The second comment is different from it.", "A third comment, again with many words."]
    assert evidence.text_evidence(frame(spark, good), "x").matches
    e = evidence.text_evidence(frame(spark, ["aa", "aa", "aa"]), "x")
    assert all(w in e.reason for w in ("cardinality", "median length", "whitespace"))
    assert evidence.text_evidence(frame(spark, [1], "int"), "x").confidence == "certain"


def test_geometry_evidence(spark):
    e = evidence.geometry_evidence(frame(spark, ["POINT(174.763336 -36.848461)", "POINT(172.636225 -43.532054)", ""]), "x")
    assert (e.matches, e.representation, e.geometry_types) == (True, "wkt", ("Point",))
    e = evidence.geometry_evidence(frame(spark, ['{"type":"Point","coordinates":[1,2]}']), "x")
    assert e.representation == "geojson"
    hexed = "010100000000000000000000400000000000000840"
    assert evidence.geometry_evidence(frame(spark, [hexed, "0x" + hexed]), "x").representation == "wkb"
    pairs = frame(spark, [[174.7, -36.8]], "array<double>", "location")
    assert evidence.geometry_evidence(pairs, "location", allow_coordinate_pairs=True).representation == "coordinate-pair"
    assert not evidence.geometry_evidence(pairs.toDF("x"), "x", allow_coordinate_pairs=True).matches


def test_likeness(spark):
    assert evidence.is_numeric_like(frame(spark, ["1", "2.5", " ", None]), "x")
    assert not evidence.is_numeric_like(frame(spark, ["1", "b"]), "x")
    assert evidence.is_integer_like(frame(spark, ["1", "2.0"]), "x") and not evidence.is_integer_like(frame(spark, ["1.5"]), "x")
    assert evidence.is_date_like(frame(spark, ["2024-01-05"]), "x", formats=["%Y-%m-%d"]) and not evidence.is_date_like(frame(spark, ["2024-01-05"]), "x")
    few = frame(spark, ["a", "b", "c"] * 10)
    assert evidence.is_nominal_like(few, "x") and evidence.is_ordered_like(few, "x")
    assert evidence.is_ordered_like(frame(spark, ["low", "high"]), "x", known_orders=[("low", "medium", "high")])
    assert not evidence.is_ordered_like(frame(spark, ["low", "high"]), "x", known_orders=[("low", "medium", "high")], require_complete_order=True)
    with pytest.raises(ValueError):
        evidence.is_numeric_like(few, "x", threshold=2)
    assert evidence.allowed_types(frame(spark, ["zz"]), "x") == ["code"]


def test_conversion(spark):
    df = frame(spark, ["1", "2.5", "b", None])
    got = lambda t, **kw: [r[0] for r in df.coalesce(1).select(convert.convert(df, "x", t, **kw)).collect()]
    assert got("decimal") == [1.0, 2.5, None, None]
    assert got("integer") == [1, 2, None, None]
    assert got("ordered", order="1,2.5") == ["1", "2.5", None, None]
    ordered = df.select(convert.convert(df, "x", "ordered", order="1,2.5,b"))
    assert ordered.schema["x"].metadata == {"semantic": "ordered", "levels": ["1", "2.5", "b"]}
    assert convert.as_cyclic(ordered.schema["x"]) is not None
    with pytest.raises(TypeError):
        convert.as_cyclic(df.select(convert.convert(df, "x", "nominal")).schema["x"])
    with pytest.raises(ValueError, match="Unsupported"):
        got("nonsense")
    with pytest.raises(Exception, match="cannot be parsed"):
        frame(spark, ["a,,b"]).select(convert.as_list(frame(spark, ["a,,b"]), "x", delimiter=",")).collect()
    dates = frame(spark, ["05/01/2024", "31/12/2024"])
    assert [str(r[0])[:10] for r in dates.coalesce(1).select(convert.to_date(dates, "x")).collect()] == ["2024-01-05", "2024-12-31"]
    with pytest.raises(TypeError):
        a, b = (retype(frame(spark, [1.0], "double"), "x", "cyclic", period=p) for p in (7.0, 12.0))
        convert.concat([a, b])


def test_modify(seeded):
    out = convert.modify(Dataset(seeded, VALID), [convert.Change("x2", "letter", "nominal"), convert.Change("id", None, "code")])
    assert out.columns == ["y", "x1", "letter", "id", "part"] and out.roles.has("letter", "predictor")
    assert [friendly(f) for f in out.df.schema] == ["integer", "decimal", "nominal", "code", "code"]
    assert label(out.df.schema["letter"]) == "nom"
    assert convert.schema_table(out).where("orig_name = 'letter'").first()["orig_order"] == "A,B"


def test_placeholders(spark):
    df = spark.createDataFrame([(-999, -99.99, "NA", "1900-01-01"), (1, 2.5, "present", "2025-01-01"), (None, None, None, None)], "i long, f double, s string, t string").coalesce(1).withColumn("t", F.col("t").cast("timestamp_ntz"))
    coded, legend = placeholders.codes(df, {"int": [-999], "float": [-99.99], "str": ["na"], "datetime": ["1900-01-01"]})
    assert [tuple(r) for r in coded.collect()] == [(2, 3, 4, 5), (1, 1, 1, 1), (0, 0, 0, 0)]
    assert legend[4] == "str: na"
    assert placeholders.used(coded, legend) == ["int: -999", "float: -99.99", "str: na", "datetime: 1900-01-01"]
    done = placeholders.resolve(df, placeholders.used(coded, legend))
    assert [tuple(r)[:3] for r in done.collect()] == [(None, None, None), (1, 2.5, "present"), (None, None, None)]
    assert placeholders.resolve(df, []) is df
    inner = spark.createDataFrame([(-100,), (-99,), (3,)], "v long").coalesce(1)
    assert [r[0] for r in placeholders.codes(inner, {"int": [-99]})[0].collect()] == [1, 1, 1]
    assert [r[0] for r in placeholders.codes(inner, {"int": [-99]}, extrema=False)[0].collect()] == [1, 2, 1]
    assert placeholders.codes(inner, {"str": ["a"], "int": ["odd", -99]})[1] == {0: "Missing", 1: "Not Missing", 2: "int: odd", 3: "int: -99"}


def test_dissimilarity(spark):
    rows = [(1.0, 2.0, "a", "A"), (2.0, 4.0, "b", "A"), (3.0, None, None, "A"), (4.0, 8.0, "a", "B")]
    df = spark.createDataFrame(rows, "height double, height_copy double, grp string, code string")
    stats = {r["variable"]: r for r in profile.variable_statistics(df).collect()}
    assert stats["code"]["spread"] == 0.25 and stats["code"]["centrality"] is None
    names, m = dissimilarity.matrix(df)
    assert m.shape == (4, 4) and (np.diag(m) == 0).all() and np.allclose(m, m.T)
    corr = {(r["var_a"], r["var_b"]): r["corr"] for r in dissimilarity.pearson(df).collect()}
    assert corr["height", "height_copy"] == pytest.approx(1)
    assert dissimilarity.qgrams("ABaba", 2) == {"ab": 2, "ba": 2}
    constant = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert dissimilarity.pearson(constant).first()["corr"] is None


def test_spearman_ranks_pairs_anew(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, None), (None, 4.0), (5.0, 5.0)], "a double, b double")
    assert dissimilarity.spearman(df).first()["corr"] == pytest.approx(0.5)


def test_missingness(spark):
    n = None
    df = spark.createDataFrame([(n, n, 1.0, 1.0), (1.0, 1.0, n, 1.0), (n, n, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    found = {(r[0], r[1]): r[2] for r in dissimilarity.missingness(df).collect()}
    assert found["a", "b"] == 0 and found["a", "c"] == 1 and found["c", "d"] == 1
    assert {(r[0], r[1]): r[2] for r in dissimilarity.missingness(df.select("d", F.col("d").alias("e"))).collect()} == {("d", "e"): None}
    with pytest.raises(TypeError):
        dissimilarity.missingness(df, True)


def test_positions_with_many_columns_and_ties(spark):
    n = 5000
    df = spark.range(n, numPartitions=4).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 > 0, 1.0).alias("hot"), F.col("id").alias("v"), F.lit("x").alias("pad"))
    rows = sampling.positions(df, ["hot", "k"], "at").collect()
    assert sorted(r["at"] for r in rows) == list(range(n)) and set(rows[0].asDict()) == {"k", "hot", "v", "pad", "at"}
    ordered = [(r["hot"] is not None, r["hot"] or 0, r["k"]) for r in sorted(rows, key=lambda r: r["at"])]
    assert ordered == sorted(ordered)
    spaced = sampling.sample(df.withColumn("key", n - F.col("v")), "key", 6, "spaced").collect()
    assert [r["key"] for r in spaced] == [1 + i * (n - 1) // 5 for i in range(6)] and all(r["v"] == n - r["key"] for r in spaced)
    assert sampling.positions(df.limit(0), ["k"]).count() == 0


def test_divisive_against_its_definition():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(12, 2))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    rows, members = cluster.divisive(d), {i: {i} for i in range(12)}
    for k, (a, b, height, count) in enumerate(rows):
        whole = members[int(a)] | members[int(b)]
        members[12 + k] = whole
        assert len(whole) == count and height == d[np.ix_(sorted(whole), sorted(whole))].max()
        rest, gone = members[int(a)], members[int(b)]
        if count > 2:  # no member of the rest is nearer to those that left
            assert all(np.mean([d[i, j] for j in rest - {i}]) <= np.mean([d[i, j] for j in gone]) + 1e-9 for i in rest if len(rest) > 1)
    assert members[22] == set(range(12))


def test_linkage():
    d = np.array([[0, 1, 4, 5], [1, 0, 3, 6], [4, 3, 0, 2], [5, 6, 2, 0]], float)
    assert cluster.average(d).tolist() == [[0, 1, 1, 2], [2, 3, 2, 2], [4, 5, 4.5, 4]]
    div = cluster.divisive(d)
    assert div[-1].tolist()[2:] == [6, 4] and sorted(cluster.leaves(div, 4)) == [0, 1, 2, 3]
    assert cluster.average(d[:1, :1]).shape == (0, 4)


def test_preview(spark):
    df = spark.createDataFrame([(i, i + 0.1234, "ab"[i % 2]) for i in range(12)], "integer long, decimal double, nominal string")
    out = preview.preview(Dataset(retype(df, "nominal", "nominal")), "integer", digits=2)
    assert out.columns == ["integer\nint", "decimal\ndec", "nominal\nnom"]
    assert [r[0] for r in out.collect()] == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11]
    assert out.first()[1] == 0.12
    with pytest.raises(ValueError):
        preview.rounded(df, 11)


def test_structure_diff(spark):
    df = spark.createDataFrame([(1, "a")], "i long, s string")
    assert profile.structure(df) == ["rows: 1", "columns: 2", "i: dtype=integer, missing=0, unique=1", "s: dtype=code, missing=0, unique=1"]
    assert [r[1] for r in profile.structure_diff(df, df).collect()] == ["No committed modifications."]


def test_pipeline(seeded):
    p = Pipeline().insert("filter", condition="x1 > 10").insert("modify", changes=[{"name": "x2", "new_name": "z"}]).insert("preview")
    out = p.run(Dataset(seeded, VALID))
    assert out.columns[2] == "z" and out.df.count() == 3
    assert p.switch("filter", False).run(Dataset(seeded)).df.count() == 4
    assert [s.name for s in p.move("preview", 0).stages] == ["preview", "filter", "modify"]
    assert Pipeline.from_json(p.to_json()) == p
    assert "where" in p.code()
    assert p.remove("filter").run(None) is None
    with pytest.raises(ValueError):
        p.insert("nothing")
    with pytest.raises(KeyError):
        p.remove("nothing")
    full = Pipeline()
    for _ in range(MOST_COPIES):
        full = full.insert("preview")
    with pytest.raises(ValueError):
        full.insert("preview")
    with pytest.raises(ValueError):
        Pipeline.from_json('{"kind": "filter"}')
