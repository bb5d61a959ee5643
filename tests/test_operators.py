"""Operators on small tables, and the places where SQL's rules are easily missed."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from larkspur import catalog, functions, sources
from larkspur import operators as op
from larkspur.operators.pipeline import Pipeline

DATA = [(1, 6), (2, 2), (3, 5), (4, 7), (5, 9), (6, 3), (6, 22), (7, 46)] * 2 + [(1, 6), (2, 2), (3, 5), (4, 7)]
PRODUCTS = [("apple", 2, 10), ("orange", 3, 7), ("pineapple", 8, 15), ("apple", 3, 10), ("orange", 3, 8), ("pineapple", 8, 3)]
STUDENTS = [(1, "chris"), (2, "hj"), (3, "yash"), (4, "bob"), (5, "john")]
CLASSES = [(1, "databases"), (2, "databases"), (3, "opearting systems"), (1, "compilers"), (2, "algorithms"), (3, "databases"), (4, "chemistry"), (5, "calculus")]


@pytest.fixture(scope="module")
def data(spark):
    return sources.values(spark, DATA, "id int, value int")


@pytest.fixture(scope="module")
def products(spark):
    return sources.values(spark, PRODUCTS, "fruit string, price bigint, quantity bigint")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_filter_then_project(data):
    found = op.project(op.filter_rows(data, "id < 5"), new_id="id")
    assert found.columns == ["new_id"] and rows(found) == sorted([(i,) for i in (1, 2, 3, 4)] * 3)


def test_project_names(data):
    found = op.project(data, new_id=F.col("id"))
    assert found.columns == ["new_id"] and found.count() == 20


def test_grouped_sum(products):
    found = op.aggregate(products, ["fruit"], total_price=F.sum(F.col("price") * F.col("quantity")))
    assert rows(found) == [("apple", 50), ("orange", 45), ("pineapple", 144)]


def test_count(data):
    assert rows(op.aggregate(data, num=F.count("id"))) == [(20,)]


def test_joins(spark, data):
    students, classes = sources.values(spark, STUDENTS, "id int, name string"), sources.values(spark, CLASSES, "student_id int, class string")
    on = F.col("id") == F.col("student_id")
    assert op.join(students, classes, on).count() == 8
    assert op.join(students, classes, on, "left_anti").count() == 0
    few = sources.values(spark, STUDENTS[:3], "id int, name string")
    assert op.join(data, few, "id").count() == 9
    assert op.join(data, few, "id", "left_anti").count() == 11


def test_join_kinds_differ(spark):
    a, b = sources.values(spark, [(1,), (2,), (None,)], "k int"), sources.values(spark, [(2,), (3,), (None,)], "k int")
    counts = {how: op.join(a, b, "k", how).count() for how in ("inner", "left", "right", "full", "left_semi", "left_anti")}
    assert counts == {"inner": 1, "left": 3, "right": 3, "full": 5, "left_semi": 1, "left_anti": 2}
    assert op.join(a, b, a.k.eqNullSafe(b.k)).count() == 2


def test_join_condition_beyond_equality(spark):
    a, b = sources.values(spark, [(1, 5), (1, 9)], "k int, v int"), sources.values(spark, [(1, 7)], "k int, w int")
    assert rows(op.join(a, b, (a.k == b.k) & (F.col("v") < F.col("w"))).select("v", "w")) == [(5, 7)]


def test_pairs_of_a_large_join_stay_paired(spark):
    n = 5000
    a = spark.range(n).select("id", (F.col("id") * 3).alias("x"))
    b = spark.range(n).select((n - 1 - F.col("id")).alias("id"), ((n - 1 - F.col("id")) * 5).alias("y"))
    assert op.join(a, b, "id").where("x * 5 <> y * 3").count() == 0


def test_null_group_key(spark):
    found = op.aggregate(sources.values(spark, [(None, 1), (None, 2), ("a", 3)], "k string, v int"), ["k"], s=F.sum("v"))
    assert rows(found) == [("a", 3), (None, 3)]


def test_empty_input(spark):
    none = sources.values(spark, [], "k int, v int")
    assert rows(op.aggregate(none, n=F.count("*"), s=F.sum("v"))) == [(0, None)]
    assert rows(op.aggregate(none, ["k"], n=F.count("*"))) == [] and rows(op.sort(none, "k")) == []
    assert op.join(none, none.withColumnRenamed("v", "w"), "k").count() == 0


def test_order_of_many_rows(spark):
    found = [r.id for r in op.sort(spark.range(5000).select((F.col("id") * 7919 % 5003).alias("id")), "-id").collect()]
    assert found == sorted(found, reverse=True)
    best = [r.id for r in op.top_k(spark.range(5000), 3, "-id").collect()]
    assert best == [4999, 4998, 4997]


def test_null_order(spark):
    df = sources.values(spark, [(1,), (None,), (2,)], "v int")
    assert [r.v for r in op.sort(df, "v").collect()] == [1, 2, None]
    assert [r.v for r in op.sort(df, "-v", nulls="first").collect()] == [None, 2, 1]


def test_limit_and_offset(data):
    assert op.limit(data, 0).count() == 0 and op.limit(data, 99).count() == 20
    assert op.offset(op.sort(data, "id"), 18).count() == 2


def test_all_files_and_declared_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(3):
        sources.write(spark.range(i * 10, i * 10 + 10), path, mode="append")
    assert sources.scan(spark, path).count() == 30
    found = sources.scan(spark, path, schema="id bigint, extra string", where="id >= 25", columns=["id", "extra"])
    assert rows(found) == [(i, None) for i in range(25, 30)]


@pytest.mark.parametrize("kind", ["csv", "json", "orc", "parquet"])
def test_formats(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    sources.write(sources.values(spark, [(1, "a"), (2, None)], "k int, s string"), path, kind=kind)
    assert rows(sources.scan(spark, path, kind=kind, schema="k int, s string")) == [(1, "a"), (2, None)]


def test_one_row(spark):
    assert rows(sources.one_row(spark, a=F.lit(1), b=F.lit(None))) == [(1, None)]


def test_pushdown_and_pruning(spark, sf_dir):
    found = sources.scan(spark, f"{sf_dir}/lineitem.parquet", columns=["l_orderkey"], where="l_quantity < 5")
    plan = Pipeline(found).explain()
    assert "LessThan(l_quantity,5.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_top_k_is_not_a_sort(spark, sf_dir):
    plan = Pipeline(sources.scan(spark, f"{sf_dir}/orders.parquet")).then("top_k", 5, "-o_totalprice").explain()
    assert "TakeOrderedAndProject" in plan


def test_pipeline(products):
    found = Pipeline(products).then("filter_rows", "price > 2").then("aggregate", ["fruit"], n=F.count("*")).then("sort", "-n", "fruit")
    assert [tuple(r) for r in found.collect()] == [("orange", 2), ("pineapple", 2), ("apple", 1)]
    assert found.explain().startswith("source -> filter_rows -> aggregate -> sort")


def test_range_and_as_of_join(spark):
    spans = sources.values(spark, [(0, 10, "a"), (10, 35, "b"), (5, 6, "c")], "low int, high int, s string")
    points = sources.values(spark, [(0,), (5,), (9,), (10,), (34,), (35,)], "p int")
    assert rows(op.range_join(points, spans, "p", "low", "high", 7).select("p", "s")) == [(0, "a"), (10, "b"), (34, "b"), (5, "a"), (5, "c"), (9, "a")]
    left = sources.values(spark, [(1, 5), (1, 9), (2, 1)], "k int, t int")
    right = sources.values(spark, [(1, 4, "x"), (1, 9, "y")], "k int, u int, v string")
    assert rows(op.as_of_join(left, right, ["k"], "t", "u", ["v"])) == [(1, 5, "x"), (1, 9, "y"), (2, 1, None)]


def test_functions(spark):
    df = sources.values(spark, [(12, 18, -2.75), (0, 5, 2.75), (0, 0, 0.0)], "a bigint, b bigint, x double")
    found = df.select(functions.gcd(F.col("a"), F.col("b")), functions.lcm(F.col("a"), F.col("b")), functions.trunc(F.col("x"), 1), functions.safe_divide(F.col("x"), F.col("a").cast("double")))
    assert [tuple(r) for r in found.collect()] == [(6, 36, -2.7, -2.75 / 12), (5, 0, 2.7, None), (0, 0, 0.0, None)]


def test_schemas(spark):
    assert "o_orderpriority" in catalog.tpch_schema("orders")
    for ddl in catalog.TPCH_SCHEMAS.values():
        assert spark.createDataFrame([], ddl).count() == 0
    with pytest.raises(KeyError):
        catalog.tpch_schema("nothing")


def test_range_join_of_large_keys(spark):
    points = sources.values(spark, [(1700000000,)], "p bigint")
    spans = sources.values(spark, [(1699999990, 1700000001, "a"), (1699999990, 1700000000, "b")], "low bigint, high bigint, s string")
    assert rows(op.range_join(points, spans, "p", "low", "high", 25).select("s")) == [("a",)]


def test_range_join_loses_nothing(spark):
    for low, step, width in ((10**9, 1, 25), (1_700_000_000_000, 500, 1000), (0, 0.25, 3)):
        kind = "double" if isinstance(step, float) else "bigint"
        points = sources.values(spark, [(low + step * i,) for i in range(60)], f"p {kind}")
        edges = [(low + step * a, low + step * b, 7) for a in range(0, 40, 3) for b in (a, a + 1, a + 10)]
        spans = sources.values(spark, edges, f"low {kind}, high {kind}, _bin int")
        found = op.range_join(points, spans, "p", "low", "high", width)
        assert found.columns == ["p", "low", "high", "_bin"]
        assert sorted(map(tuple, found.collect())) == sorted((low + step * i, *e) for i in range(60) for e in edges if e[0] <= low + step * i < e[1])


def test_sort_merge_join_is_planned(spark, sf_dir):
    from larkspur.plans import registry

    plan = registry.QUERIES["join_sort_merge"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_only_small_sides_are_sent(spark, monkeypatch):
    from larkspur.operators import relational

    nation, other = (spark.range(25).withColumnRenamed("id", k) for k in ("a", "b"))
    plan = lambda: op.join(nation, other, F.col("a") == F.col("b"), small=True)._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(relational, "SENT_BYTES", 10)
    assert "strategy=broadcast" not in plan()


def test_gcd_and_whole_numbers(spark):
    big = [(2**62, 2**40), (7540113804746346429, 4660046610375530309), (0, 0), (-12, 18), (1, 9), (9, 1), (6, 6), (None, 3)]
    found = sources.values(spark, big, "a bigint, b bigint").select(functions.gcd(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in found] == [None if a is None else math.gcd(a, b) for a, b in big]
    texts = sources.values(spark, [("12",), (" -7 ",), ("A",), ("",), (None,), ("99999999999",)], "t string")
    assert [r[0] for r in texts.select(functions.whole_number(F.col("t"))).collect()] == [12, -7, None, None, None, None]


def test_texts_against_worked_values(spark, tmp_path):
    """Two of the query texts on rows whose results were worked out by hand."""
    from larkspur.plans import tpch

    at = datetime.datetime(1996, 3, 1)
    items = [("A", "F", 10.0, 100.0, 0.05, 0.1, at), ("A", "F", 20.0, 300.0, 0.06, 0.0, at), ("N", "O", 30.0, 50.0, 0.0, 0.0, datetime.datetime(2001, 1, 1))]
    sources.values(spark, items, "l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz").createOrReplaceTempView("lineitem")
    found = spark.sql(tpch.TEXTS["tpch01"]).collect()
    assert [tuple(r) for r in found] == [("A", "F", 30.0, 400.0, 377.0, 386.5, 15.0, 200.0, 0.055, 2)]
    spark.catalog.dropTempView("lineitem")
