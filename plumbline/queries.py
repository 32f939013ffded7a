"""The query catalogue: each operator applied to a whole table, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.dataset import Dataset
from plumbline.functions import basket as B
from plumbline.functions import geometry as G
from plumbline.functions import numbers as N
from plumbline.functions import text as X
from plumbline.functions.cyclic import Cycle
from plumbline.operators import cluster, convert, dissimilarity, evidence, placeholders, preview, profile, sampling, validate
from plumbline.plans.pipeline import Pipeline
from plumbline.roles import RoleMap
from plumbline.types import typed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _six(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- profiles

_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_LABELS = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "cde", "o_totalprice": "dec", "o_orderdate": "dte", "o_orderpriority": "cde"}


@query("profile_columns", " UNION ALL ".join(f"SELECT '{c}' AS variable, '{_LABELS[c]}' AS label, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM orders" for c in _ORDERS))
def profile_columns(spark, sf_dir):
    return profile.counts(table(spark, sf_dir, "orders"))


@query("describe_categorical", " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST(sum(n) AS BIGINT) AS count, count(*) AS \"unique\", arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1)" for c in ("o_orderstatus", "o_orderpriority")))
def describe_categorical(spark, sf_dir):
    return profile.describe_categorical(table(spark, sf_dir, "orders"))


@query("structure_lines", """
SELECT 0 AS ord, 'rows: ' || count(*) AS line FROM part UNION ALL SELECT 1, 'columns: 6'
UNION ALL SELECT 2, 'p_partkey: dtype=integer, missing=' || (count(*) - count(p_partkey)) || ', unique=' || count(DISTINCT p_partkey) FROM part
UNION ALL SELECT 3, 'p_name: dtype=code, missing=' || (count(*) - count(p_name)) || ', unique=' || count(DISTINCT p_name) FROM part
UNION ALL SELECT 4, 'p_brand: dtype=code, missing=' || (count(*) - count(p_brand)) || ', unique=' || count(DISTINCT p_brand) FROM part
UNION ALL SELECT 5, 'p_type: dtype=code, missing=' || (count(*) - count(p_type)) || ', unique=' || count(DISTINCT p_type) FROM part
UNION ALL SELECT 6, 'p_size: dtype=integer, missing=' || (count(*) - count(p_size)) || ', unique=' || count(DISTINCT p_size) FROM part
UNION ALL SELECT 7, 'p_retailprice: dtype=decimal, missing=' || (count(*) - count(p_retailprice)) || ', unique=' || count(DISTINCT p_retailprice) FROM part""")
def structure_lines(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(profile.structure(table(spark, sf_dir, "part")))), "ord int, line string")


def _diff_sql() -> str:
    line = lambda n, mark, c, kind: f"SELECT {n} AS ord, '{mark}{c}: dtype={kind}, missing=' || (count(*) - count({c})) || ', unique=' || count(DISTINCT {c}) AS line FROM part"
    fixed = "SELECT * FROM (VALUES (0, '--- original'), (1, '+++ modified'), (2, '@@ -2,7 +2,7 @@'), (3, ' columns: 6')) v(ord, line)"
    shown = ((" ", "p_partkey", "integer"), (" ", "p_name", "code"), ("-", "p_brand", "code"), ("+", "p_brand", "nominal"), (" ", "p_type", "code"), (" ", "p_size", "integer"), (" ", "p_retailprice", "decimal"))
    return " UNION ALL ".join([fixed, *(line(4 + n, *x) for n, x in enumerate(shown))])


@query("structural_diff", _diff_sql())
def structural_diff(spark, sf_dir):
    before = table(spark, sf_dir, "part")
    after = before.withColumn("p_brand", convert.convert(before, "p_brand", "nominal"))
    return profile.structure_diff(before, after)


@query("extrema", " UNION ALL ".join(f"SELECT '{c}' AS variable, min({c}) AS low, max({c}) AS high FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_linenumber")))
def extrema(spark, sf_dir):
    return profile.extrema(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_linenumber"])


@query("categorical_spread", " UNION ALL ".join(f"SELECT '{c}' AS variable, round(1 - max(n) / sum(n)::DOUBLE, 6) AS spread FROM (SELECT {c}, count(*) AS n FROM orders GROUP BY 1)" for c in ("o_orderstatus", "o_orderpriority")))
def categorical_spread(spark, sf_dir):
    return _six(profile.spread(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("key_uniqueness", "SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT l_orderkey || '|' || l_linenumber) AS n_keys, count(*) = count(DISTINCT l_orderkey || '|' || l_linenumber) AS is_unique FROM lineitem")
def key_uniqueness(spark, sf_dir):
    return profile.is_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_STATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _stats_sql(robust: bool) -> str:
    parts = []
    for c in _STATS:
        centre = f"median({c})" if robust else f"avg({c})"
        sd = f"1.4826::DOUBLE * mad({c})" if robust else f"stddev_samp({c})"
        parts.append(f"SELECT '{c}' AS variable, count(DISTINCT {c}) / count(*)::DOUBLE AS cardinality, {centre} AS centre, {sd} AS sd, avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5) AS sk FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)")
    parts.append("SELECT 'l_returnflag', (SELECT count(DISTINCT l_returnflag) / count(*)::DOUBLE FROM lineitem), NULL, 1 - max(n) / sum(n)::DOUBLE, NULL FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)")
    return f"""WITH s AS ({' UNION ALL '.join(parts)})
SELECT variable, round(cardinality, 6) AS cardinality, round(centre / max(abs(centre)) OVER (), 6) AS centrality,
       round(CASE WHEN centre IS NULL THEN sd ELSE sd / greatest(abs(centre), 1) END, 6) AS spread, round(sk / max(abs(sk)) OVER (), 6) AS skew FROM s"""


@query("numeric_stats_classic", _stats_sql(False))
def numeric_stats_classic(spark, sf_dir):
    return _six(profile.variable_statistics(table(spark, sf_dir, "lineitem").select(*_STATS, "l_returnflag")))


@query("numeric_stats_robust", _stats_sql(True))
def numeric_stats_robust(spark, sf_dir):
    return _six(profile.variable_statistics(table(spark, sf_dir, "lineitem").select(*_STATS, "l_returnflag"), robust=True))


# --- projections, filters, order


@query("select_dtypes_numeric", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def select_dtypes_numeric(spark, sf_dir):
    return Dataset(table(spark, sf_dir, "lineitem")).select_types(include="number").df


@query("select_dtypes_exclude_string", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate FROM lineitem")
def select_dtypes_exclude_string(spark, sf_dir):
    return Dataset(table(spark, sf_dir, "lineitem")).select_types(exclude="string").df


_ROLES = {"target": ["o_totalprice"], "predictor": ["o_orderpriority", "o_orderstatus"], "identifier": ["o_orderkey"], "sensitive": ["o_custkey"], "none": ["o_orderdate"]}


@query("select_role", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def select_role(spark, sf_dir):
    return Dataset(table(spark, sf_dir, "orders"), _ROLES).select_roles(include=["predictor", "identifier"], exclude=["target"]).df


@query("rename_swap", "SELECT n_nationkey AS n_regionkey, n_name, n_regionkey AS n_nationkey FROM nation")
def rename_swap(spark, sf_dir):
    return Dataset(table(spark, sf_dir, "nation")).rename({"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey"}).df


@query("nonblank_filter", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND NOT regexp_full_match(text, '\\s*')")
def nonblank_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"^\s*$")).select("doc_id")


@query("column_filters", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 150000 AND contains(lower(o_orderpriority), 'urg')")
def column_filters(spark, sf_dir):
    return preview.filtered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), {"o_totalprice": (1000, 150000), "o_orderpriority": "URG"})


@query("headtail", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS m FROM orders) WHERE rn <= 5 OR rn > m - 5")
def headtail(spark, sf_dir):
    return sampling.sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 10, "headtail")


@query("linspace_sample", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rn FROM lineitem) WHERE rn IN (SELECT (i * ((SELECT count(*) FROM lineitem) - 1)) // 99 FROM range(100) t(i))")
def linspace_sample(spark, sf_dir):
    return sampling.sample(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 100, "spaced")


@query("random_sample_size", "SELECT 1000 AS n, 1000 AS distinct_keys")
def random_sample_size(spark, sf_dir):
    found = sampling.sample(table(spark, sf_dir, "events").select("event_id"), "event_id", 1000, "random")
    return found.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("event_id").cast("int").alias("distinct_keys"))


@query("take_positions", "SELECT o.* EXCLUDE (rn, m), CAST(i AS INTEGER) AS nth FROM (VALUES (0, 5), (1, 0), (2, 5), (3, -1)) w(i, p) JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS m FROM orders) o ON rn = CASE WHEN p < 0 THEN m + p ELSE p END")
def take_positions(spark, sf_dir):
    from pyspark.sql import Window

    found = sampling.take(table(spark, sf_dir, "orders"), ["o_orderkey"], [5, 0, 5, -1])
    return found.withColumn("at", F.monotonically_increasing_id()).withColumn("nth", F.row_number().over(Window.orderBy("at")) - 1).drop("at")


@query("concat_union", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def concat_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return convert.concat([orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'")])


@query("preview_rounded", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice, 0) AS l_extendedprice, round_even(l_tax, 0) AS l_tax FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS rn, count(*) OVER () AS m FROM lineitem) WHERE rn <= 5 OR rn > m - 5")
def preview_rounded(spark, sf_dir):
    data = Dataset(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"))
    return preview.preview(data, ["l_orderkey", "l_linenumber"], digits=0, headers=False)


# --- cyclic

_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
_DAYS_SQL = "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']"


@query("cyclic_month", "SELECT o_orderkey, CAST(month(o_orderdate) % 12 AS DOUBLE) AS month FROM orders")
def cyclic_month(spark, sf_dir):
    cycle = Cycle(period=12)
    return table(spark, sf_dir, "orders").select("o_orderkey", cycle.typed(cycle.values(F.month("o_orderdate")), "month"))


@query("cyclic_hour", "SELECT event_id, CAST(hour(ts) AS DOUBLE) AS hour FROM events")
def cyclic_hour(spark, sf_dir):
    cycle = Cycle(period=24)
    return table(spark, sf_dir, "events").select("event_id", cycle.typed(cycle.values(F.hour("ts")), "hour"))


@query("cyclic_wrap_degrees", "SELECT c_custkey, round(((c_acctbal % 360) + 360) % 360, 6) AS bearing FROM customer")
def cyclic_wrap_degrees(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(Cycle(period=360).values(F.col("c_acctbal")), 6).alias("bearing"))


def _weekday(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", F.date_format("o_orderdate", "EEE").alias("day"))


@query("cyclic_weekday_shift", f"SELECT o_orderkey, CAST(d AS INTEGER) AS code, {_DAYS_SQL}[1 + (d + 8) % 7] AS later, {_DAYS_SQL}[1 + (d + 6) % 7] AS before FROM (SELECT o_orderkey, isodow(o_orderdate) - 1 AS d FROM orders)")
def cyclic_weekday_shift(spark, sf_dir):
    cycle = Cycle(categories=_DAYS)
    day = F.col("day")
    return _weekday(table(spark, sf_dir, "orders")).select("o_orderkey", cycle.codes(day).cast("int").alias("code"), cycle.typed(cycle.shift(day, 8), "later"), cycle.typed(cycle.predecessor(day), "before"))


@query("cyclic_distance", "SELECT event_id, ((18 - h + 12 + 24) % 24) - 12 AS signed, abs(((18 - h + 12 + 24) % 24) - 12) AS apart FROM (SELECT event_id, CAST(hour(ts) AS DOUBLE) AS h FROM events)")
def cyclic_distance(spark, sf_dir):
    cycle, hour = Cycle(period=24), F.hour("ts")
    return table(spark, sf_dir, "events").select("event_id", cycle.distance(hour, 18, signed=True).alias("signed"), cycle.distance(hour, 18).alias("apart"))


@query("cyclic_equality", "SELECT c_custkey, (((round(c_acctbal) % 360) + 360) % 360) = 1 AS is_one FROM customer")
def cyclic_equality(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", Cycle(period=360).equals(F.round("c_acctbal"), 361).alias("is_one"))


# --- baskets


def _baskets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", typed(F.split("p_name", " "), "words", "basket"))


@query("basket_lengths", "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n FROM part")
def basket_lengths(spark, sf_dir):
    return _baskets(spark, sf_dir).select("p_partkey", B.lengths(F.col("words")).alias("n"))


@query("basket_contains", "SELECT p_partkey, list_contains(string_split(p_name, ' '), (SELECT min(string_split(p_name, ' ')[1]) FROM part)) AS found FROM part")
def basket_contains(spark, sf_dir):
    baskets = _baskets(spark, sf_dir)
    item = baskets.agg(F.min(F.get("words", F.lit(0)))).first()[0]
    return baskets.select("p_partkey", B.contains(F.col("words"), item).alias("found"))


@query("basket_explode", "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS place, string_split(p_name, ' ')[i] AS item FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def basket_explode(spark, sf_dir):
    return B.explode(_baskets(spark, sf_dir), "words", place="place")


@query("basket_item_counts", "SELECT item, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS item FROM part) GROUP BY item")
def basket_item_counts(spark, sf_dir):
    return B.explode(_baskets(spark, sf_dir), "words").groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query("basket_indicators", "SELECT s AS item, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS s FROM part) GROUP BY s")
def basket_indicators(spark, sf_dir):
    wide = B.indicators(_baskets(spark, sf_dir), "words")
    flags = [c for c in wide.columns if c != "p_partkey"]
    return wide.agg(F.array(*[F.struct(F.lit(c).alias("item"), F.count_if(F.col(f"`{c}`")).alias("n")) for c in flags]).alias("r")).select(F.inline("r"))


_QUOTED = [(0, '"Smith, John",bread'), (1, "a,b , c"), (2, "a,,b"), (3, "one"), (4, None), (5, '"say ""hi""", x')]


@query("list_parse_quoted", """SELECT * FROM (VALUES (0, 'Smith, John|bread'), (1, 'a|b|c'), (2, NULL), (3, 'one'), (4, NULL), (5, 'say "hi"|x')) v(id, items)""")
def list_parse_quoted(spark, sf_dir):
    return spark.createDataFrame(_QUOTED, "id int, raw string").select("id", F.array_join(B.parse_delimited(F.col("raw"), ","), "|").alias("items"))


@query("json_array_valid", "SELECT event_id, json_type(props) = 'ARRAY' AS as_is, true AS wrapped FROM events")
def json_array_valid(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", B.is_json_list(F.col("props")).alias("as_is"), B.is_json_list(F.concat(F.lit("["), "props", F.lit("]"))).alias("wrapped"))


_PROSE = r"len(regexp_extract_all({c}, '\b[\w''-]+\b'))"


@query("delimiter_scores", rf"""
SELECT * FROM (SELECT ',' AS delimiter, round(avg(CASE WHEN list_contains(list_transform(string_split(x, ','), lambda i: trim(i)), '') THEN 0 ELSE 1 END), 6) AS parseable,
  round(avg(CASE WHEN NOT list_contains(list_transform(string_split(x, ','), lambda i: trim(i)), '') AND len(string_split(x, ',')) >= 2 THEN 1 ELSE 0 END), 6) AS multi,
  round(avg(CASE WHEN {_PROSE.format(c='x')} >= 10 OR regexp_matches(x, '[.!?](\s|$)') OR (contains(x, ', ') AND {_PROSE.format(c='x')} >= 6) THEN 1 ELSE 0 END), 6) AS prose FROM (SELECT replace(p_name, ' ', '|') AS x FROM part))
UNION ALL SELECT '|', round(avg(CASE WHEN list_contains(list_transform(string_split(x, '|'), lambda i: trim(i)), '') THEN 0 ELSE 1 END), 6),
  round(avg(CASE WHEN NOT list_contains(list_transform(string_split(x, '|'), lambda i: trim(i)), '') AND len(string_split(x, '|')) >= 2 THEN 1 ELSE 0 END), 6),
  round(avg(CASE WHEN {_PROSE.format(c='x')} >= 10 OR regexp_matches(x, '[.!?](\s|$)') THEN 1 ELSE 0 END), 6) FROM (SELECT replace(p_name, ' ', '|') AS x FROM part)""")
def delimiter_scores(spark, sf_dir):
    x = F.replace(F.col("p_name"), F.lit(" "), F.lit("|"))
    rows = [F.struct(F.lit(d).alias("delimiter"), *[F.round(c, 6).alias(n) for n, c in zip(("parseable", "multi", "prose"), three, strict=True)]) for d, three in zip((",", "|"), evidence.delimiter_scores(x, (",", "|")), strict=True)]
    return table(spark, sf_dir, "part").agg(F.array(*rows).alias("r")).select(F.inline("r"))


# --- text


@query("text_lengths", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def text_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.lengths(F.col("text")).alias("n"))


@query("text_word_counts", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n FROM documents")
def text_word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.word_counts(F.col("text")).alias("n"))


@query("prose_ratio", r"SELECT round(avg(CASE WHEN len(regexp_extract_all(text, '[0-9A-Za-z_''-]+')) >= 10 OR regexp_matches(text, '[.!?](\s|$)') THEN 1 ELSE 0 END), 3) AS prose FROM documents")
def prose_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.round(F.avg(B.prose_like(F.col("text")).cast("double")), 3).alias("prose"))


@query("text_qgrams", "SELECT n_nationkey, CAST(greatest(length(n_name) - 1, 1) AS INTEGER) AS n, lower(n_name[1:2]) AS first FROM nation")
def text_qgrams(spark, sf_dir):
    grams = X.qgrams(F.col("n_name"), 2)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.size(grams).alias("n"), F.get(grams, F.lit(0)).alias("first"))


def _text_evidence_sql(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS variable, (k > 100 OR k / n >= 0.8) AND med >= 20 AND ws >= 0.5 AS matches, CAST(k AS BIGINT) AS cardinality, round(k / n, 6) AS uniqueness_ratio, med AS median_length, round(ws, 6) AS whitespace_ratio
FROM (SELECT count(DISTINCT x)::DOUBLE AS k, count(*)::DOUBLE AS n, median(length(x))::DOUBLE AS med, avg(CASE WHEN regexp_matches(x, '\\s') THEN 1 ELSE 0 END) AS ws FROM (SELECT trim({c}, ' ' || chr(9) || chr(10) || chr(13)) AS x FROM {t}) WHERE x <> '')"""


@query("text_evidence", " UNION ALL ".join(_text_evidence_sql(t, c) for t, c in (("documents", "text"), ("part", "p_name"), ("customer", "c_mktsegment"))))
def text_evidence(spark, sf_dir):
    rows = []
    for t, c in (("documents", "text"), ("part", "p_name"), ("customer", "c_mktsegment")):
        e = evidence.text_evidence(table(spark, sf_dir, t), c)
        rows.append((c, e.matches, e.cardinality, round(e.uniqueness_ratio, 6), float(e.median_length), round(e.whitespace_ratio, 6)))
    return spark.createDataFrame(rows, "variable string, matches boolean, cardinality long, uniqueness_ratio double, median_length double, whitespace_ratio double")


# --- inference


@query("cyclic_evidence_numeric", """
SELECT 'l_linenumber' AS variable, (SELECT count(DISTINCT l_linenumber) / 7.0 >= 0.8 FROM lineitem) AS matches, 'plausible' AS confidence, 7.0::DOUBLE AS period
UNION ALL SELECT 'p_size', (SELECT count(DISTINCT p_size) / 60.0 >= 0.8 FROM part), 'plausible', 60.0
UNION ALL SELECT 'month', (SELECT min(month(o_orderdate)) >= 1 AND max(month(o_orderdate)) <= 12 FROM orders), 'strong', 12.0""")
def cyclic_evidence_numeric(spark, sf_dir):
    cases = [(table(spark, sf_dir, "lineitem"), "l_linenumber"), (table(spark, sf_dir, "part"), "p_size"), (table(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("month")), "month")]
    rows = [(c, e.matches, e.confidence, float(e.period)) for df, c in cases for e in [evidence.cyclic_evidence(df, c)]]
    return spark.createDataFrame(rows, "variable string, matches boolean, confidence string, period double")


@query("cyclic_evidence_vocab", """SELECT * FROM (VALUES ('EEE', true, 'weekday_abbreviation', 7.0::DOUBLE), ('EEEE', true, 'weekday', 7.0), ('MMMM', true, 'month', 12.0)) v(pattern, matches, cycle, period)""")
def cyclic_evidence_vocab(spark, sf_dir):
    rows = []
    for pattern in ("EEE", "EEEE", "MMMM"):
        e = evidence.cyclic_evidence(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", pattern).alias("label")), "label")
        rows.append((pattern, e.matches, e.cycle, float(e.period)))
    return spark.createDataFrame(rows, "pattern string, matches boolean, cycle string, period double")


def _like_sql() -> str:
    strings, out = {"o_orderstatus", "o_orderpriority"}, []
    for c in _ORDERS:
        numeric, date = c in ("o_orderkey", "o_custkey", "o_totalprice"), c == "o_orderdate"
        card = f"(SELECT count(DISTINCT {c}) <= 20 AND count(DISTINCT {c}) / count(*)::DOUBLE <= 0.2 FROM orders)"
        integer = "true" if c in ("o_orderkey", "o_custkey") else "(SELECT avg(CASE WHEN o_totalprice = round(o_totalprice) THEN 1 ELSE 0 END) >= 0.95 FROM orders)" if numeric else "false"
        order = f"(SELECT count(DISTINCT {c}) BETWEEN 3 AND 20 AND count(DISTINCT {c}) / count(*)::DOUBLE <= 0.2 FROM orders)" if c in strings else "false"
        out.append(f"SELECT '{c}' AS variable, {str(numeric).lower()} AS numeric_like, {integer} AS integer_like, {str(date).lower()} AS date_like, {'false' if date else card} AS nominal_like, {order} AS ordered_like")
    return " UNION ALL ".join(out)


@query("like_matrix", _like_sql())
def like_matrix(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    rows = [(c, evidence.is_numeric_like(df, c), evidence.is_integer_like(df, c), evidence.is_date_like(df, c, formats=N.DATE_FORMATS), evidence.is_nominal_like(df, c), evidence.is_ordered_like(df, c)) for c in df.columns]
    return spark.createDataFrame(rows, "variable string, numeric_like boolean, integer_like boolean, date_like boolean, nominal_like boolean, ordered_like boolean")


@query("allowed_types", """SELECT * FROM (VALUES ('p_brand', 'cyclic,nominal'), ('p_type', 'nominal,ordered'), ('p_retailprice', 'decimal')) v(variable, targets)""")
def allowed_types(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    df = df.select(F.concat(F.substring("p_brand", 1, 7), F.lit("x")).alias("p_brand"), "p_type", F.expr("p_retailprice + 0.001").alias("p_retailprice"))
    df = df.select(F.when(F.substring("p_brand", -2, 1) < "3", "low").otherwise("high").alias("p_brand"), "p_type", "p_retailprice")
    return spark.createDataFrame([(c, ",".join(evidence.allowed_types(df, c))) for c in df.columns], "variable string, targets string")


@query("list_evidence", """SELECT * FROM (VALUES ('words', true, 'typed-list', NULL), ('piped', true, 'delimited-string', '|'), ('json', true, 'json-array', NULL), ('plain', false, NULL, NULL)) v(variable, matches, representation, delimiter)""")
def list_evidence(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("words"), F.replace(F.col("p_name"), F.lit(" "), F.lit("|")).alias("piped"), F.to_json(F.split("p_name", " ")).alias("json"), F.col("p_brand").alias("plain"))
    rows = [(c, e.matches, e.representation, e.delimiter) for c in df.columns for e in [evidence.list_evidence(df, c)]]
    return spark.createDataFrame(rows, "variable string, matches boolean, representation string, delimiter string")


# --- conversion

_PRIORITIES = "1-URGENT,2-HIGH,3-MEDIUM"


@query("convert_decimal", "SELECT o_orderkey, o_totalprice AS price FROM orders")
def convert_decimal(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"))
    return df.select("o_orderkey", convert.convert(df, "price", "decimal"))


@query("convert_integer", "SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS price FROM orders")
def convert_integer(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"))
    return df.select("o_orderkey", convert.convert(df, "price", "integer"))


@query("convert_date", "SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day FROM orders")
def convert_date(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    return df.select("o_orderkey", convert.to_date(df, "day"))


@query("convert_ordered", f"SELECT o_orderkey, CASE WHEN list_contains(string_split('{_PRIORITIES}', ','), o_orderpriority) THEN o_orderpriority END AS o_orderpriority, CAST(nullif(list_position(string_split('{_PRIORITIES}', ','), o_orderpriority), 0) AS INTEGER) AS rank FROM orders")
def convert_ordered(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    levels = F.array(*[F.lit(x) for x in _PRIORITIES.split(",")])
    return df.select("o_orderkey", convert.convert(df, "o_orderpriority", "ordered", order=_PRIORITIES), F.nullif(F.array_position(levels, F.col("o_orderpriority")), F.lit(0)).cast("int").alias("rank"))


@query("convert_nominal", "SELECT o_orderkey, o_orderstatus FROM orders")
def convert_nominal(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", convert.convert(df, "o_orderstatus", "nominal"))


@query("convert_code", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def convert_code(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", convert.convert(df, "o_custkey", "code"))


@query("convert_list", "SELECT p_partkey, replace(p_name, ' ', '/') AS items FROM part")
def convert_list(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.col("p_name"), F.lit(" "), F.lit("|")).alias("items"))
    return df.select("p_partkey", convert.as_list(df, "items")).select("p_partkey", F.array_join("items", "/").alias("items"))


@query("schema_table", "SELECT * FROM (VALUES ('n_nationkey', 'integer', 'predictor'), ('n_name', 'code', 'predictor'), ('n_regionkey', 'integer', 'predictor')) v(orig_name, orig_type, role)")
def schema_table(spark, sf_dir):
    return convert.schema_table(Dataset(table(spark, sf_dir, "nation"))).select("orig_name", "orig_type", "role")


# --- placeholders

_SENTINELS = {"int": [1], "float": [0.0, 0.05], "str": ["f"], "datetime": ["1900-01-01"]}


def _with_dates(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", F.col("l_linestatus")).alias("status"), "l_discount", "l_tax")


_CODED = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 5 ELSE 0 END AS status, CASE WHEN l_discount = 0.0 AND dmin = 0.0 THEN 3 WHEN abs(l_discount - 0.05) < 1e-9 AND 0.05 IN (dmin, dmax) THEN 4 ELSE 1 END AS discount,
CASE WHEN l_tax = 0.0 AND tmin = 0.0 THEN 3 WHEN abs(l_tax - 0.05) < 1e-9 AND 0.05 IN (tmin, tmax) THEN 4 ELSE 1 END AS tax
FROM lineitem, (SELECT min(l_discount) AS dmin, max(l_discount) AS dmax, min(l_tax) AS tmin, max(l_tax) AS tmax FROM lineitem)"""


@query("placeholder_codes", f"SELECT l_orderkey, l_linenumber, CAST(status AS TINYINT) AS status, CAST(discount AS TINYINT) AS l_discount, CAST(tax AS TINYINT) AS l_tax FROM ({_CODED})")
def placeholder_codes(spark, sf_dir):
    return placeholders.codes(_with_dates(spark, sf_dir), _SENTINELS, keep=["l_orderkey", "l_linenumber"])[0]


@query("placeholder_summary", f"""SELECT variable, code, CASE code WHEN 0 THEN 'Missing' WHEN 3 THEN 'float: 0.0' WHEN 4 THEN 'float: 0.05' WHEN 5 THEN 'str: f' END AS label, count(*) AS n
FROM (SELECT 'status' AS variable, CAST(status AS INTEGER) AS code FROM ({_CODED}) UNION ALL SELECT 'l_discount', discount FROM ({_CODED}) UNION ALL SELECT 'l_tax', tax FROM ({_CODED})) WHERE code <> 1 GROUP BY ALL""")
def placeholder_summary(spark, sf_dir):
    coded, legend = placeholders.codes(_with_dates(spark, sf_dir), _SENTINELS, keep=["l_orderkey", "l_linenumber"])
    return placeholders.summary(coded, legend, keep=["l_orderkey", "l_linenumber"])


@query("placeholder_resolve", "SELECT l_orderkey, l_linenumber, CAST(NULL AS VARCHAR) AS status, CASE WHEN l_discount = 0.0 AND dmin = 0.0 THEN NULL ELSE l_discount END AS l_discount, CASE WHEN l_tax = 0.0 AND tmin = 0.0 THEN NULL ELSE l_tax END AS l_tax FROM lineitem, (SELECT min(l_discount) AS dmin, min(l_tax) AS tmin FROM lineitem)")
def placeholder_resolve(spark, sf_dir):
    return placeholders.resolve(_with_dates(spark, sf_dir), ["float: 0.0", "float: 0.05", "str: f"])


# --- roles


@query("role_frames", """SELECT * FROM (VALUES ('target', 'o_totalprice'), ('predictor', 'o_orderpriority, o_orderstatus'), ('identifier', 'o_orderkey'), ('weighting', ''), ('stratifier', ''), ('treatment', ''), ('geometry', ''), ('sequence', ''), ('sensitive', 'o_custkey'), ('partition', ''), ('none', 'o_orderdate')) v("Role", "Variable")""")
def role_frames(spark, sf_dir):
    return RoleMap.from_primitive(_ROLES).by_role(spark)


@query("role_validate_ok", "SELECT CAST(0 AS INTEGER) AS ord, '' AS message WHERE false")
def role_validate_ok(spark, sf_dir):
    roles = _ROLES | {"sensitive": [], "none": ["o_orderdate", "o_custkey"]}
    return validate.validation(Dataset(table(spark, sf_dir, "orders"), roles))


@query("role_validate_bad", """SELECT * FROM (VALUES (0, 'Target role must be singular'), (1, 'Predictor role must be assigned to a variable'), (2, 'Identifier/Sequence combination must be unique'), (3, 'Partition role must have cardinality 2'), (4, 'Weighting role must be numeric'), (5, 'Sensitive role must have low cardinality')) v(ord, message)""")
def role_validate_bad(spark, sf_dir):
    roles = {"target": ["l_tax", "l_discount"], "identifier": ["l_orderkey"], "partition": ["l_returnflag"], "weighting": ["l_linestatus"], "sensitive": ["l_partkey"], "none": ["l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]}
    return validate.validation(Dataset(table(spark, sf_dir, "lineitem"), roles))


# --- dissimilarity

_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_GAPPED = "(SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, l_tax FROM lineitem)"


def _gapped(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), "l_tax")


def _pair_names():
    from itertools import combinations

    return list(combinations(_CORR, 2))


@query("corr_pearson", " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, round(abs(corr({a}, {b})), 6) AS corr FROM {_GAPPED}" for a, b in _pair_names()))
def corr_pearson(spark, sf_dir):
    return _six(dissimilarity.pearson(_gapped(spark, sf_dir)))


@query("corr_spearman", " UNION ALL ".join(f"""SELECT '{a}' AS var_a, '{b}' AS var_b, round(abs(corr(ra, rb)), 6) AS corr FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS ra, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rb
FROM (SELECT {a} AS x, {b} AS y FROM {_GAPPED} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))""" for a, b in _pair_names()))
def corr_spearman(spark, sf_dir):
    return _six(dissimilarity.spearman(_gapped(spark, sf_dir)))


_HOLES = "(SELECT nullif(l_tax, 0) AS tax, nullif(l_discount, 0) AS discount, l_quantity AS quantity FROM lineitem)"


@query("missing_jaccard", " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, round(CASE WHEN count(*) FILTER ({a} IS NULL OR {b} IS NULL) >= 1 THEN 1 - count(*) FILTER ({a} IS NULL AND {b} IS NULL) / (count(*) FILTER ({a} IS NULL OR {b} IS NULL))::DOUBLE END, 6) AS distance FROM {_HOLES}" for a, b in (("tax", "discount"), ("tax", "quantity"), ("discount", "quantity"))))
def missing_jaccard(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.nullif("l_tax", F.lit(0.0)).alias("tax"), F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.col("l_quantity").alias("quantity"))
    return _six(dissimilarity.missingness(df))


@query("name_qgram_cosine", """
WITH n AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS name), g AS (SELECT name, gram, count(*) AS c FROM (SELECT name, substr(name, i::INTEGER, 2) AS gram FROM (SELECT name, unnest(range(1, length(name))) AS i FROM n)) GROUP BY ALL),
z AS (SELECT name, sqrt(sum(c * c)) AS size FROM g GROUP BY name)
SELECT a.name AS var_a, b.name AS var_b, round(CASE WHEN a.name = b.name THEN 0 ELSE 1 - coalesce((SELECT sum(x.c * y.c) FROM g x JOIN g y USING (gram) WHERE x.name = a.name AND y.name = b.name), 0) / (a.size * b.size) END, 6) AS distance FROM z a, z b""")
def name_qgram_cosine(spark, sf_dir):
    return _six(dissimilarity.long_matrix(spark, list(_CORR), dissimilarity.name_distance(list(_CORR), 2)))


def _mixed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), "l_returnflag", "l_linestatus")


@query("dissimilarity_matrix")
def dissimilarity_matrix(spark, sf_dir):
    return _six(dissimilarity.long_matrix(spark, *dissimilarity.matrix(_mixed(spark, sf_dir))))


@query("linkage_average")
def linkage_average(spark, sf_dir):
    return cluster.merge_table(spark, cluster.average(dissimilarity.matrix(_mixed(spark, sf_dir))[1]))


@query("linkage_divisive")
def linkage_divisive(spark, sf_dir):
    return cluster.merge_table(spark, cluster.divisive(dissimilarity.matrix(_mixed(spark, sf_dir), robust=True)[1]))


# --- geometry

_XY = "(c_custkey % 360) - 180 AS x, (c_custkey % 180) - 90 AS y"


def _points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 360 - 180).cast("double").alias("x"), (F.col("c_custkey") % 180 - 90).cast("double").alias("y"))


@query("wkt_point_xy", f"SELECT c_custkey, x::DOUBLE AS x, y::DOUBLE AS y FROM (SELECT c_custkey, {_XY} FROM customer)")
def wkt_point_xy(spark, sf_dir):
    wkt = F.format_string("POINT (%s %s)", F.col("x").cast("string"), F.col("y").cast("string"))
    return _points(spark, sf_dir).select("c_custkey", G.point_xy(wkt).alias("p")).select("c_custkey", "p.x", "p.y")


@query("coordinate_valid", f"SELECT c_custkey, y BETWEEN -90 AND 90 AND x BETWEEN -180 AND 180 AS lon_lat, x BETWEEN -90 AND 90 AND y BETWEEN -180 AND 180 AS lat_lon FROM (SELECT c_custkey, {_XY} FROM customer)")
def coordinate_valid(spark, sf_dir):
    pair = F.array("x", "y")
    return _points(spark, sf_dir).select("c_custkey", G.is_coordinate(pair, order="lon-lat").alias("lon_lat"), G.is_coordinate(pair, order="lat-lon").alias("lat_lon"))


@query("coordinate_to_point", f"SELECT c_custkey, CASE WHEN abs(y) <= 90 AND abs(x) > 90 THEN x ELSE y END::DOUBLE AS x, CASE WHEN abs(y) <= 90 AND abs(x) > 90 THEN y ELSE x END::DOUBLE AS y FROM (SELECT c_custkey, {_XY} FROM customer)")
def coordinate_to_point(spark, sf_dir):
    return _points(spark, sf_dir).select("c_custkey", G.coordinate_point(F.array("y", "x")).alias("p")).select("c_custkey", "p.x", "p.y")


def _shapes(spark, sf_dir) -> DataFrame:
    box = F.format_string("POLYGON ((%1$s %2$s, %3$s %2$s, %3$s %4$s, %1$s %4$s, %1$s %2$s))", *[c.cast("string") for c in (F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 2)])
    point = F.format_string("POINT (%s %s)", F.col("x").cast("string"), F.col("y").cast("string"))
    return _points(spark, sf_dir).select("c_custkey", G.as_geometry(F.when(F.col("c_custkey") % 2 == 0, box).otherwise(point), "shape", "wkt", crs="EPSG:4326"))


@query("geometry_types", "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Polygon' ELSE 'Point' END AS kind, count(*) AS n FROM customer GROUP BY 1")
def geometry_types(spark, sf_dir):
    return profile.geometry_summary(_shapes(spark, sf_dir), "shape")[0]


@query("geometry_bounds", f"SELECT 'EPSG:4326' AS crs, true AS active, min(x)::DOUBLE AS minx, min(y)::DOUBLE AS miny, max(CASE WHEN c_custkey % 2 = 0 THEN x + 1 ELSE x END)::DOUBLE AS maxx, max(CASE WHEN c_custkey % 2 = 0 THEN y + 2 ELSE y END)::DOUBLE AS maxy FROM (SELECT c_custkey, {_XY} FROM customer)")
def geometry_bounds(spark, sf_dir):
    return profile.geometry_summary(_shapes(spark, sf_dir), "shape")[1]


@query("geometry_display", f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN printf('Polygon bound by %.4f,%.4f to %.4f,%.4f', x::DOUBLE, y::DOUBLE, (x + 1)::DOUBLE, (y + 2)::DOUBLE) ELSE printf('Point(%.4f, %.4f)', x::DOUBLE, y::DOUBLE) END AS shown FROM (SELECT c_custkey, {_XY} FROM customer)")
def geometry_display(spark, sf_dir):
    return _shapes(spark, sf_dir).select("c_custkey", G.display(F.col("shape")).alias("shown"))


# --- sources and pipelines


@query("csv_roundtrip", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation")
def csv_roundtrip(spark, sf_dir):
    import tempfile

    from plumbline.sources.readers import read_file
    from plumbline.sources.sinks import write_csv

    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="plumbline-csv-")
    path = f"{base.rstrip('/')}/nation-{uuid.uuid4().hex}.csv"
    write_csv(table(spark, sf_dir, "nation"), path)
    return read_file(spark, path)


@query("pipeline_end_to_end", "SELECT l_orderkey AS order_id, CAST(l_linenumber AS VARCHAR) AS line, CASE WHEN l_tax = 0.0 AND (SELECT min(l_tax) FROM lineitem) = 0.0 THEN NULL ELSE l_tax END AS l_tax FROM lineitem WHERE l_quantity > 25")
def pipeline_end_to_end(spark, sf_dir):
    pipeline = (
        Pipeline().insert("modify", changes=[{"name": "l_orderkey", "new_name": "order_id"}, {"name": "l_linenumber", "new_name": "line", "new_type": "code"}]).insert("placeholders", sentinels=["float: 0.0"])
        .insert("roles", roles={"identifier": ["order_id", "line"], "target": ["l_tax"]}).insert("filter", condition="l_quantity > 25").insert("select", include=["identifier", "target"], by="roles")
    )
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_quantity")
    return pipeline.run(Dataset(df)).df
