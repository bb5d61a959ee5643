"""The relational tables: declared schemas, loading, and the derived ``partsupp``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared TPC-H schemas as DDL; a column that a file lacks reads as null.
TPCH_SCHEMAS = {
    "customer": "c_custkey INT, c_name STRING, c_address STRING, c_nationkey INT, c_phone STRING, c_acctbal DECIMAL(15,2), c_mktsegment STRING, c_comment STRING",
    "lineitem": "l_orderkey INT, l_partkey INT, l_suppkey INT, l_linenumber INT, l_quantity DECIMAL(15,2), l_extendedprice DECIMAL(15,2), l_discount DECIMAL(15,2), l_tax DECIMAL(15,2), l_returnflag STRING, l_linestatus STRING, l_shipdate DATE, l_commitdate DATE, l_receiptdate DATE, l_shipinstruct STRING, l_shipmode STRING, l_comment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT, n_comment STRING",
    "orders": "o_orderkey INT, o_custkey INT, o_orderstatus STRING, o_totalprice DECIMAL(15,2), o_orderdate DATE, o_orderpriority STRING, o_clerk STRING, o_shippriority INT, o_comment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_mfgr STRING, p_brand STRING, p_type STRING, p_size INT, p_container STRING, p_retailprice DECIMAL(15,2), p_comment STRING",
    "partsupp": "ps_partkey INT, ps_suppkey INT, ps_availqty INT, ps_supplycost DECIMAL(15,2), ps_comment STRING",
    "region": "r_regionkey INT, r_name STRING, r_comment STRING",
    "supplier": "s_suppkey INT, s_name STRING, s_address STRING, s_nationkey INT, s_phone STRING, s_acctbal DECIMAL(15,2), s_comment STRING",
}

#: Stands in for the table that the test data lack.
PARTSUPP_SQL = "SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def tpch_schema(table: str) -> str:
    """The declared schema of a table, as DDL; unknown names raise ``KeyError``."""
    return TPCH_SCHEMAS[table]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, all files of it; column pruning and filters reach this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partsupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return items.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.min(price).alias("ps_supplycost"))


def named(sql: str) -> list[str]:
    """The tables that a text names; ``partsupp`` is made from ``lineitem``."""
    words = set(re.findall(r"\w+", sql))
    return [t for t in TABLES if t in words or t == "lineitem" and "partsupp" in words]


def register(spark: SparkSession, sf_dir: str, tables=TABLES) -> None:
    """Makes the tables (and ``partsupp``) known to SQL as temporary views."""
    for name in tables:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
    if "lineitem" in tables:
        spark.sql(PARTSUPP_SQL).createOrReplaceTempView("partsupp")
