"""Each registered query against DuckDB."""

import pytest
from comparing import same_rows

from larkspur.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_agrees_with_sql(spark, sf_dir, duck, name):
    found = registry.QUERIES[name](spark, sf_dir)
    wanted = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    same_rows(found.columns, [tuple(r) for r in found.collect()], columns, wanted.fetchall())


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert {f"tpch{n:02d}" for n in (*range(1, 11), *range(12, 18), 19)} <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["revenue"]
    assert set(registry.QUERIES) <= set(entry.queries())


def test_agg_approximate_keeps_no_state_for_each_part(spark, sf_dir, tmp_path):
    """No aggregate by part holds sketches or quantities; null flags are a group, null values count nowhere."""
    rows = [(f, p, q) for f in ("A", None) for p, q in ((1, 1.0), (1, 2.0), (None, 9.0), (2, None))] + [("N", None, None)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.QUERIES["agg_approximate"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == [("A", True, True), ("N", True, None), (None, True, True)]
    plan = registry.QUERIES["agg_approximate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    by_part = [line for line in plan.splitlines() if "Aggregate(keys=" in line and "l_partkey" in line.split("functions=")[0]]
    assert by_part and not any("percentile" in line or "approx" in line for line in by_part)
