"""The TPC-H style queries, with literals that find rows in the test tables.

Spark and DuckDB run the same text: sums are rounded so that the order of addition doesn't show, and integers have one
width. The tables lack some columns of the benchmark; the texts leave these out or put similar ones in their place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur import catalog

REVENUE = "l_extendedprice * (1 - l_discount)"

TEXTS = {
    "tpch01": f"""
        SELECT l_returnflag, l_linestatus,
               round(sum(l_quantity), 2) AS sum_qty,
               round(sum(l_extendedprice), 2) AS sum_base_price,
               round(sum({REVENUE}), 2) AS sum_disc_price,
               round(sum({REVENUE} * (1 + l_tax)), 2) AS sum_charge,
               round(avg(l_quantity), 6) AS avg_qty,
               round(avg(l_extendedprice), 6) AS avg_price,
               round(avg(l_discount), 6) AS avg_disc,
               count(*) AS count_order
        FROM lineitem
        WHERE l_shipdate <= CAST('1998-09-02' AS date)
        GROUP BY l_returnflag, l_linestatus
        ORDER BY l_returnflag, l_linestatus""",
    "tpch02": """
        SELECT s_acctbal, s_name, n_name, p_partkey, ps_supplycost
        FROM part
        JOIN partsupp ON p_partkey = ps_partkey
        JOIN supplier ON s_suppkey = ps_suppkey
        JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        WHERE p_type LIKE '%PROMO' AND r_name = 'EUROPE'
          AND ps_supplycost = (
            SELECT min(ps_supplycost)
            FROM partsupp
            JOIN supplier ON s_suppkey = ps_suppkey
            JOIN nation ON s_nationkey = n_nationkey
            JOIN region ON n_regionkey = r_regionkey
            WHERE ps_partkey = p_partkey AND r_name = 'EUROPE')
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey, ps_supplycost
        LIMIT 100""",
    "tpch03": f"""
        SELECT l_orderkey, round(sum({REVENUE}), 2) AS revenue, o_orderdate
        FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
          AND o_orderdate < date '1998-03-15' AND l_shipdate > date '1998-03-15'
        GROUP BY l_orderkey, o_orderdate
        ORDER BY revenue DESC, o_orderdate, l_orderkey
        LIMIT 10""",
    "tpch04": """
        SELECT o_orderpriority, count(*) AS order_count
        FROM orders
        WHERE o_orderdate >= date '1996-07-01' AND o_orderdate < date '1996-10-01'
          AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
        GROUP BY o_orderpriority
        ORDER BY o_orderpriority""",
    "tpch05": f"""
        SELECT n_name, round(sum({REVENUE}), 2) AS revenue
        FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
          AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
          AND r_name = 'ASIA' AND o_orderdate >= date '1996-01-01' AND o_orderdate < date '1997-01-01'
        GROUP BY n_name
        ORDER BY revenue DESC""",
    "tpch06": """
        SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue
        FROM lineitem
        WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01'
          AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch07": f"""
        SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue
        FROM (
            SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation,
                   CAST(extract(year FROM l_shipdate) AS bigint) AS l_year, {REVENUE} AS volume
            FROM supplier, lineitem, orders, customer, nation n1, nation n2
            WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey
              AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
              AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7')
                OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6'))
              AND l_shipdate BETWEEN date '1995-01-01' AND date '1996-12-31') AS shipping
        GROUP BY supp_nation, cust_nation, l_year
        ORDER BY supp_nation, cust_nation, l_year""",
    "tpch08": f"""
        SELECT o_year, round(sum(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share
        FROM (
            SELECT CAST(extract(year FROM o_orderdate) AS bigint) AS o_year, {REVENUE} AS volume, n2.n_name AS nation
            FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
            WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey
              AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA'
              AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN date '1995-01-01' AND date '1996-12-31'
              AND p_type = 'ECONOMY') AS all_nations
        GROUP BY o_year
        ORDER BY o_year""",
    "tpch09": f"""
        SELECT nation, o_year, round(sum(amount), 2) AS sum_profit
        FROM (
            SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS bigint) AS o_year,
                   {REVENUE} - ps_supplycost * l_quantity AS amount
            FROM part, supplier, lineitem, partsupp, orders, nation
            WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey
              AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey
              AND p_name LIKE '%red%') AS profit
        GROUP BY nation, o_year
        ORDER BY nation, o_year DESC""",
    "tpch10": f"""
        SELECT c_custkey, c_name, round(sum({REVENUE}), 2) AS revenue, c_acctbal, n_name
        FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey
          AND o_orderdate >= date '1996-10-01' AND o_orderdate < date '1997-01-01' AND l_returnflag = 'R'
        GROUP BY c_custkey, c_name, c_acctbal, n_name
        ORDER BY revenue DESC, c_custkey
        LIMIT 20""",
    "tpch12": """
        SELECT l_linestatus,
               CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS bigint) AS high_line_count,
               CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS bigint) AS low_line_count
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate
          AND l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01'
        GROUP BY l_linestatus
        ORDER BY l_linestatus""",
    "tpch13": """
        SELECT c_count, count(*) AS custdist
        FROM (
            SELECT c_custkey, count(o_orderkey)
            FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%'
            GROUP BY c_custkey) AS c_orders(c_custkey, c_count)
        GROUP BY c_count
        ORDER BY custdist DESC, c_count DESC""",
    "tpch14": f"""
        SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo_revenue
        FROM lineitem, part
        WHERE l_partkey = p_partkey AND l_shipdate >= date '1995-09-01' AND l_shipdate < CAST('1995-10-01' AS date)""",
    "tpch15": f"""
        WITH revenue AS (
            SELECT l_suppkey AS supplier_no, round(sum({REVENUE}), 2) AS total_revenue
            FROM lineitem
            WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-04-01'
            GROUP BY supplier_no)
        SELECT s_suppkey, s_name, total_revenue
        FROM supplier, revenue
        WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)
        ORDER BY s_suppkey""",
    "tpch16": """
        SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt
        FROM partsupp, part
        WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%'
          AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
          AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
        GROUP BY p_brand, p_type, p_size
        ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch17": """
        SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly
        FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND p_type = 'PROMO'
          AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
    "tpch19": f"""
        SELECT round(sum({REVENUE}), 2) AS revenue
        FROM lineitem, part
        WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND p_type IN ('SMALL', 'PROMO')
               AND l_quantity >= 1 AND l_quantity <= 1 + 10 AND p_size BETWEEN 1 AND 5)
           OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND p_type IN ('MEDIUM', 'PROMO')
               AND l_quantity >= 10 AND l_quantity <= 10 + 10 AND p_size BETWEEN 1 AND 10)
           OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND p_type IN ('LARGE', 'PROMO')
               AND l_quantity >= 20 AND l_quantity <= 20 + 10 AND p_size BETWEEN 1 AND 15)""",
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog.register(spark, sf_dir, catalog.named(text))
        return spark.sql(text)

    return run


def oracle(text: str) -> str:
    """The same text for DuckDB, where partsupp isn't a table."""
    return text if "partsupp" not in text else f"SELECT * FROM (WITH partsupp AS ({catalog.PARTSUPP_SQL}) {text.strip()})"


QUERIES = {name: _query(text) for name, text in TEXTS.items()}
ORACLES = {name: oracle(text) for name, text in TEXTS.items()}
