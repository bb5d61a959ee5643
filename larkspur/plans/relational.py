"""A query for each relational operator and form, beside DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import catalog, functions, sources
from larkspur import operators as op

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a function as a query by its name, with the SQL that it must agree with."""

    def add(run):
        QUERIES[run.__name__] = run
        ORACLES[run.__name__] = sql
        return run

    return add


def both(name: str, sql: str) -> None:
    """Registers one text that Spark and DuckDB both run."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog.register(spark, sf_dir, catalog.named(sql))
        return spark.sql(sql)

    QUERIES[name], ORACLES[name] = run, sql


def table(spark: SparkSession, sf_dir: str, name: str, **how) -> DataFrame:
    return sources.scan(spark, f"{sf_dir}/{name}.parquet", **how)


# scans, filters, projections


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def scan_projection(spark, d):
    return table(spark, d, "lineitem", columns=["l_orderkey", "l_quantity"])


@query("SELECT l_orderkey, l_shipdate, l_quantity FROM lineitem WHERE l_shipdate >= date '1997-01-01' AND l_quantity < 5")
def scan_pushdown(spark, d):
    return table(spark, d, "lineitem", columns=["l_orderkey", "l_shipdate", "l_quantity"], where="l_shipdate >= timestamp_ntz'1997-01-01 00:00:00' AND l_quantity < 5")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE (l_quantity + 1) * 2 - 3 > 60 AND l_discount BETWEEN 0.02 AND 0.05 AND l_returnflag IN ('A', 'N') AND l_linestatus <> 'F' OR l_linenumber = 7")
def filter_pred(spark, d):
    q = F.col("l_quantity")
    hit = ((q + 1) * 2 - 3 > 60) & F.col("l_discount").between(0.02, 0.05) & F.col("l_returnflag").isin("A", "N") & (F.col("l_linestatus") != "F")
    return op.filter_rows(table(spark, d, "lineitem"), hit | (F.col("l_linenumber") == 7)).select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT p_partkey, p_name FROM part WHERE (p_name LIKE 'a%' OR p_name LIKE '%d' OR p_name LIKE '%re%' OR p_name LIKE '%a%e%') AND p_type NOT LIKE 'MED%'")
def filter_like(spark, d):
    name = F.col("p_name")
    hit = name.like("a%") | name.like("%d") | name.like("%re%") | name.like("%a%e%")
    return op.filter_rows(table(spark, d, "part"), hit & ~F.col("p_type").like("MED%")).select("p_partkey", "p_name")


@query("SELECT l_orderkey AS key, l_extendedprice * (1 - l_discount) AS price, CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity > 10 THEN 'mid' ELSE 'small' END AS size FROM lineitem")
def project_expr(spark, d):
    return op.project(table(spark, d, "lineitem"), key=F.col("l_orderkey"), price="l_extendedprice * (1 - l_discount)", size=F.when(F.col("l_quantity") > 40, "big").when(F.col("l_quantity") > 10, "mid").otherwise("small"))


@query("SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS bigint) AS y, o_orderdate < CAST('1997-01-01' AS date) AS early FROM orders")
def project_year(spark, d):
    return op.project(table(spark, d, "orders"), o_orderkey="o_orderkey", y=F.year("o_orderdate").cast("bigint"), early="o_orderdate < DATE'1997-01-01'")


# aggregates


@query("SELECT count(*) AS n, count(l_quantity) AS nq, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def agg_global(spark, d):
    return op.aggregate(table(spark, d, "lineitem"), n=F.count("*"), nq=F.count("l_quantity"), s=F.round(F.sum("l_quantity"), 2), a=F.round(F.avg("l_discount"), 6), lo=F.min("l_shipdate"), hi=F.max("l_shipdate"))


@query("SELECT count(*) AS n, sum(l_quantity) AS s FROM lineitem WHERE l_quantity < 0")
def agg_empty(spark, d):
    return op.aggregate(table(spark, d, "lineitem", where="l_quantity < 0"), n=F.count("*"), s=F.sum("l_quantity"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity), 0) AS s, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group(spark, d):
    return op.aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], s=F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), 0), n=F.count("*"))


@query("SELECT CAST(extract(year FROM o_orderdate) AS bigint) AS y, count(*) AS n FROM orders GROUP BY y")
def agg_group_expr(spark, d):
    return op.aggregate(table(spark, d, "orders"), [F.year("o_orderdate").cast("bigint").alias("y")], n=F.count("*"))


@query("SELECT nullif(l_returnflag, 'A') AS k, count(*) AS n FROM lineitem GROUP BY k")
def agg_null_key(spark, d):
    return op.aggregate(table(spark, d, "lineitem"), [F.nullif(F.col("l_returnflag"), F.lit("A")).alias("k")], n=F.count("*"))


@query("SELECT p_brand, count(DISTINCT l_suppkey) AS n FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand")
def agg_count_distinct(spark, d):
    joined = op.join(table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), table(spark, d, "part"), "p_partkey")
    return op.aggregate(joined, ["p_brand"], n=F.count_distinct("l_suppkey"))


@query("SELECT p_brand, round(100.0 * sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS share FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand")
def agg_conditional(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    price = F.col("l_extendedprice")
    return op.aggregate(joined, ["p_brand"], share=F.round(100.0 * F.sum(F.when(F.col("p_type") == "PROMO", price).otherwise(0)) / F.sum(price), 6))


@query("SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def agg_nested(spark, d):
    return op.aggregate(op.aggregate(table(spark, d, "orders"), ["o_custkey"], n=F.count("*")), ["n"], customers=F.count("*"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return op.distinct(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having(spark, d):
    return op.aggregate(table(spark, d, "orders"), ["o_custkey"], n=F.count("*"), having="n > 12")


both("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, round(sum(l_extendedprice) FILTER (WHERE l_discount < 0.05), 2) AS s FROM lineitem GROUP BY l_returnflag")
both("agg_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, median(l_quantity) AS m, bool_and(l_quantity > 0) AS b, CAST(bit_or(l_linenumber) AS bigint) AS bo FROM lineitem GROUP BY l_returnflag")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS bigint) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return op.aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], by="rollup", n=F.count("*"), g=F.grouping("l_linestatus").cast("bigint"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return op.aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], by="cube", n=F.count("*"))


both("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")

# joins and subqueries


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return op.join(table(spark, d, "orders"), table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query(f"SELECT l_orderkey, l_linenumber, ps_supplycost FROM lineitem JOIN ({catalog.PARTSUPP_SQL}) ps ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey")
def join_composite(spark, d):
    on = (F.col("l_partkey") == F.col("ps_partkey")) & (F.col("l_suppkey") == F.col("ps_suppkey"))
    return op.join(table(spark, d, "lineitem"), catalog.partsupp(spark, d), on).select("l_orderkey", "l_linenumber", "ps_supplycost")


@query("SELECT o_orderkey, n_name FROM orders JOIN nation ON o_custkey % 25 = n_nationkey + 0")
def join_expr_key(spark, d):
    return op.join(table(spark, d, "orders"), table(spark, d, "nation"), F.col("o_custkey") % 25 == F.col("n_nationkey") + 0, small=True).select("o_orderkey", "n_name")


@query("SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark, d):
    a, b = table(spark, d, "nation").alias("a"), table(spark, d, "nation").alias("b")
    return op.join(a, b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("n1"), F.col("b.n_name").alias("n2"))


@query("SELECT a.c_custkey AS k1, b.n_nationkey AS k2 FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT n_nationkey, nullif(n_nationkey, 3) AS k FROM nation) b ON a.k = b.k")
def join_null_key(spark, d):
    a = table(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k"))
    b = table(spark, d, "nation").select("n_nationkey", F.nullif(F.col("n_nationkey"), F.lit(3)).alias("k"))
    return op.join(a, b, "k").select(F.col("c_custkey").alias("k1"), F.col("n_nationkey").alias("k2"))


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey AND (l_quantity > p_size OR p_type = 'PROMO' AND l_quantity > 30)")
def join_residual(spark, d):
    on = (F.col("l_partkey") == F.col("p_partkey")) & ((F.col("l_quantity") > F.col("p_size")) | (F.col("p_type") == "PROMO") & (F.col("l_quantity") > 30))
    return op.join(table(spark, d, "lineitem"), table(spark, d, "part"), on).select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'")
def join_left(spark, d):
    return op.join(table(spark, d, "customer"), table(spark, d, "orders"), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderpriority") == "1-URGENT"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN orders ON c_custkey = o_custkey")
def join_right(spark, d):
    return op.join(table(spark, d, "customer", where="c_acctbal > 5000"), table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "right").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c FULL JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON c_custkey = o_custkey")
def join_full(spark, d):
    return op.join(table(spark, d, "customer", where="c_acctbal > 5000"), table(spark, d, "orders", where="o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
def join_semi(spark, d):
    return op.join(table(spark, d, "orders"), table(spark, d, "lineitem", where="l_quantity > 48"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 20)")
def join_anti(spark, d):
    return op.join(table(spark, d, "orders"), table(spark, d, "lineitem", where="l_quantity > 20"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


both("join_not_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT nullif(n_nationkey, 99) FROM nation WHERE n_regionkey = 2)")
both("join_not_in_null", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation)")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    return op.cross_join(table(spark, d, "region"), table(spark, d, "nation")).select("r_name", "n_name")


@query("SELECT a.n_nationkey AS k1, r_regionkey AS k2 FROM nation a JOIN region ON a.n_regionkey > r_regionkey")
def join_theta(spark, d):
    return op.join(table(spark, d, "nation"), table(spark, d, "region"), F.col("n_regionkey") > F.col("r_regionkey"), small=True).select(F.col("n_nationkey").alias("k1"), F.col("r_regionkey").alias("k2"))


@query("WITH bands AS (SELECT p_partkey AS low, p_partkey + p_size AS high FROM part) SELECT s_suppkey, low FROM supplier JOIN bands ON s_suppkey >= low AND s_suppkey < high")
def join_range(spark, d):
    bands = table(spark, d, "part").select(F.col("p_partkey").alias("low"), (F.col("p_partkey") + F.col("p_size")).alias("high"))
    return op.range_join(table(spark, d, "supplier").select("s_suppkey"), bands, "s_suppkey", "low", "high", 25).select("s_suppkey", "low")


@query("WITH p AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) SELECT e.event_id, p.event_id AS last_id FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_as_of(spark, d):
    events = table(spark, d, "events")
    last = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_id"))
    return op.as_of_join(events.select("event_id", "user_id", "ts"), last, ["user_id"], "ts", "ts", ["last_id"]).select("event_id", "last_id")


both("subq_corr_scalar", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > (SELECT 1.8 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = lineitem.l_partkey)")
both("subq_scalar", "SELECT s_suppkey FROM supplier WHERE s_acctbal = (SELECT max(s_acctbal) FROM supplier)")
both("subq_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
both("derived_table", "SELECT k, n FROM (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) AS t(k, n) WHERE n > 1")
both("lateral", "SELECT r_name, t.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) AS t")
both("cte_recursive", "WITH RECURSIVE t(i, f) AS (SELECT 1, 1 UNION ALL SELECT i + 1, f * (i + 1) FROM t WHERE i < 10) SELECT CAST(i AS bigint) AS i, CAST(f AS bigint) AS f FROM t")

# order, limits, sets


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def sort_multi(spark, d):
    return op.sort(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "-o_totalprice", "o_orderkey")


@query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 137)")
def limit_rows(spark, d):
    return op.aggregate(op.limit(table(spark, d, "orders"), 137), n=F.count("*"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, d):
    return op.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, "-o_totalprice", "o_orderkey")


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
def offset(spark, d):
    return op.offset(op.sort(table(spark, d, "nation").select("n_nationkey"), "n_nationkey"), 20)


@query("SELECT 1 AS one, 'x' AS s, 2.5::DOUBLE AS f")
def one_row(spark, d):
    return sources.one_row(spark, one=F.lit(1), s=F.lit("x"), f=F.lit(2.5))


both("values_rows", "SELECT CAST(a AS bigint) AS a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")

_SETS = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 500", "SELECT s_nationkey AS k FROM supplier"
for _name, _sql in {"union_all": "UNION ALL", "union_distinct": "UNION", "intersect": "INTERSECT", "except": "EXCEPT", "except_all": "EXCEPT ALL", "intersect_all": "INTERSECT ALL"}.items():

    def _set_query(spark, d, kind=_name.replace("union_distinct", "union")):
        left = table(spark, d, "customer", where="c_acctbal < 500").select(F.col("c_nationkey").alias("k"))
        return op.set_operation(kind, left, table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))

    QUERIES[_name], ORACLES[_name] = _set_query, f"{_SETS[0]} {_sql} {_SETS[1]}"

# windows


@query("SELECT o_orderkey, CAST(row_number() OVER w AS bigint) AS rn, CAST(rank() OVER v AS bigint) AS rk, CAST(dense_rank() OVER v AS bigint) AS dr, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def win_rank(spark, d):
    orders = table(spark, d, "orders")
    found = op.window(orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], rn=F.row_number())
    found = op.window(found, ["o_custkey"], ["o_orderpriority"], rk=F.rank(), dr=F.dense_rank(), pr=F.percent_rank(), cd=F.cume_dist())
    return found.select("o_orderkey", *(F.col(c).cast("bigint").alias(c) for c in ("rn", "rk", "dr")), F.round("pr", 6).alias("pr"), F.round("cd", 6).alias("cd"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS a, lead(o_orderkey, 2) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def win_lag_lead(spark, d):
    return op.window(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], a=F.lag("o_orderkey"), b=F.lead("o_orderkey", 2)).select("o_orderkey", "a", "b")


@query("SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS bigint) AS q FROM orders")
def win_ntile(spark, d):
    return op.window(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderkey"], q=F.ntile(4)).select("o_orderkey", F.col("q").cast("bigint").alias("q"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
def win_rows(spark, d):
    return op.window(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], rows=(-2, 0), s=F.sum("o_totalprice")).select("o_orderkey", F.round("s", 2).alias("s"))


@query("SELECT n_nationkey, CAST(count(*) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS bigint) AS n FROM nation")
def win_range(spark, d):
    return op.window(table(spark, d, "nation"), ["n_regionkey"], ["n_nationkey"], values=(-5, 5), n=F.count("*")).select("n_nationkey", "n")


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_first_last(spark, d):
    whole = (-(1 << 63), (1 << 63) - 1)
    return op.window(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], rows=whole, f=F.first("o_orderkey"), l=F.last("o_orderkey"), s=F.nth_value("o_orderkey", 2)).select("o_orderkey", "f", "l", "s")


# function families


@query("SELECT l_orderkey, l_linenumber, l_quantity, round(sqrt(l_quantity), 6) AS a, round(ln(l_quantity), 6) AS b, round(power(l_quantity, 2), 2) AS c, floor(l_extendedprice)::BIGINT AS e, ceil(l_extendedprice)::BIGINT AS f, sign(l_discount - 0.05)::DOUBLE AS g, CAST(gcd(l_orderkey, l_partkey) AS BIGINT) AS h, CAST(lcm(l_linenumber, l_suppkey) AS BIGINT) AS i, trunc(l_extendedprice) AS j, round(atan2(l_quantity, 3), 6) AS k, l_tax = 0 AS z FROM lineitem")
def fn_math(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return op.project(
        table(spark, d, "lineitem"), l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_quantity=q, a=F.round(F.sqrt(q), 6), b=F.round(F.log(q), 6), c=F.round(F.pow(q, F.lit(2)), 2),
        e=F.floor(p), f=F.ceil(p), g=F.signum(F.col("l_discount") - 0.05), h=functions.gcd(F.col("l_orderkey"), F.col("l_partkey")), i=functions.lcm(F.col("l_linenumber"), F.col("l_suppkey")),
        j=functions.trunc(p), k=F.round(F.atan2(q, F.lit(3)), 6), z=functions.iszero(F.col("l_tax")),
    )


@query("SELECT p_partkey, upper(p_name) AS a, length(p_name) AS b, substr(p_name, 2, 3) AS c, replace(p_name, 'e', '3') AS e, lpad(p_type, 12, '*') AS f, reverse(p_type) AS g, split_part(p_name, ' ', 1) AS h, strpos(p_name, 'a')::INT AS i, concat_ws('-', p_brand, p_type) AS j, levenshtein(p_type, 'PROMOTE')::INT AS k, starts_with(p_name, 'b') AS l, translate(p_type, 'AEO', '430') AS m, md5(p_name) AS n, sha256(p_name) AS o FROM part")
def fn_string(spark, d):
    n, t = F.col("p_name"), F.col("p_type")
    return op.project(
        table(spark, d, "part"), p_partkey="p_partkey", a=F.upper(n), b=F.length(n).cast("bigint"), c=F.substring(n, 2, 3), e=F.replace(n, F.lit("e"), F.lit("3")), f=F.lpad(t, 12, "*"), g=F.reverse(t), h=F.split_part(n, F.lit(" "), F.lit(1)),
        i=F.instr(n, "a"), j=F.concat_ws("-", "p_brand", t), k=F.levenshtein(t, F.lit("PROMOTE")), l=F.startswith(n, F.lit("b")), m=F.translate(t, "AEO", "430"), n=F.md5(n), o=F.sha2(n, 256),
    )


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS a, CAST(extract(quarter FROM o_orderdate) AS BIGINT) AS b, CAST(dayofyear(o_orderdate) AS BIGINT) AS c, strftime(o_orderdate, '%Y/%m/%d') AS e, CAST(datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS BIGINT) AS f, make_date(1999, 2, 3)::TIMESTAMP AS g, CAST(epoch(o_orderdate) AS BIGINT) AS h FROM orders")
def fn_date(spark, d):
    at = F.col("o_orderdate")
    return op.project(
        table(spark, d, "orders"), o_orderkey="o_orderkey", a=F.date_trunc("month", at).cast("timestamp_ntz"), b=F.quarter(at).cast("bigint"), c=F.dayofyear(at).cast("bigint"), e=F.date_format(at, "yyyy/MM/dd"),
        f=F.datediff(at, F.lit("1995-01-01").cast("date")).cast("bigint"), g=F.make_date(F.lit(1999), F.lit(2), F.lit(3)).cast("timestamp_ntz"), h=F.unix_timestamp(at.cast("timestamp")),
    )


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(event_type, 'none') AS t, nullif(event_type, 'view') AS nv FROM events")
def fn_json(spark, d):
    return op.project(table(spark, d, "events"), event_id="event_id", k=F.get_json_object("props", "$.k"), t=F.coalesce("event_type", F.lit("none")), nv=F.nullif(F.col("event_type"), F.lit("view")))


@query("SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS a, regexp_replace(p_name, '[aeiou]', '_', 'g') AS b, regexp_extract(p_brand, '#([0-9]+)', 1) AS c FROM part")
def fn_regex(spark, d):
    n = F.col("p_name")
    return op.project(table(spark, d, "part"), p_partkey="p_partkey", a=n.rlike("^[a-m]"), b=F.regexp_replace(n, "[aeiou]", "_"), c=F.regexp_extract("p_brand", "#([0-9]+)", 1))


@query("SELECT p_partkey, len(string_split(p_name, ' '))::BIGINT AS a, list_contains(string_split(p_name, ' '), 'red') AS b, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') AS c, string_split(p_name, ' ')[1] AS e, list_position([p_type, p_brand], p_brand)::BIGINT AS f FROM part")
def fn_array(spark, d):
    w = F.split("p_name", " ")
    return op.project(table(spark, d, "part"), p_partkey="p_partkey", a=F.size(w).cast("bigint"), b=F.array_contains(w, "red"), c=F.array_join(F.array_sort(F.array_distinct(w)), ","), e=F.element_at(w, 1), f=F.array_position(F.array("p_type", "p_brand"), F.col("p_brand")))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
def unnest(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))


@query("SELECT l_orderkey, l_linenumber, TRY_CAST(l_returnflag AS INT) AS a, CAST(l_quantity AS BIGINT) AS b, CAST(l_linenumber AS VARCHAR) AS c, l_extendedprice / nullif(l_linenumber - 1, 0) AS e FROM lineitem")
def fn_cast(spark, d):
    return op.project(table(spark, d, "lineitem"), l_orderkey="l_orderkey", l_linenumber="l_linenumber", a=functions.whole_number(F.col("l_returnflag")), b=F.col("l_quantity").cast("bigint"), c=F.col("l_linenumber").cast("string"), e=functions.safe_divide(F.col("l_extendedprice"), F.col("l_linenumber") - 1))


@query("SELECT n_regionkey, count(*) AS n, max(n_name) AS m, string_agg(n_name, ',' ORDER BY n_nationkey) AS s FROM nation GROUP BY n_regionkey")
def agg_collect(spark, d):
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return op.aggregate(table(spark, d, "nation"), ["n_regionkey"], n=F.count("*"), m=F.max("n_name"), s=F.array_join(names, ","))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def dealt_rows(spark, d):
    return op.gather(op.aggregate(op.deal(table(spark, d, "orders"), None, "o_custkey"), ["o_custkey"], n=F.count("*")), 2)


both("fn_trig", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({f}({x}), 6) AS {f}_" for f, x in [("sin", "l_quantity"), ("cos", "l_quantity"), ("tan", "l_discount"), ("asin", "l_discount"), ("acos", "l_discount"), ("atan", "l_quantity"), ("sinh", "l_discount"), ("cosh", "l_discount"), ("tanh", "l_discount"), ("cbrt", "l_quantity"), ("degrees", "l_discount"), ("radians", "l_quantity"), ("exp", "l_discount"), ("log2", "l_quantity"), ("log10", "l_quantity"), ("abs", "l_discount - 0.05")]) + ", round(pi(), 6) AS pi_, CAST(factorial(l_linenumber) AS bigint) AS factorial_ FROM lineitem")


@query("SELECT p_partkey, lower(p_brand) AS a, ltrim('  ' || p_type) AS b, rtrim(p_type || '  ') AS c, repeat(p_type, 2) AS e, left(p_name, 3) AS f, right(p_name, 3) AS g, ascii(p_name)::INT AS h, chr(65 + p_size) AS i, bit_length(p_name)::INT AS j, strlen(p_name)::INT AS k, to_hex(p_partkey) AS l, contains(p_name, 're') AS m, ends_with(p_name, 'd') AS n, base64(encode(p_type)) AS o, rpad(p_type, 8, '.') AS q, concat(p_brand, '/', p_size) AS r FROM part")
def fn_string_more(spark, d):
    n, t = F.col("p_name"), F.col("p_type")
    return op.project(
        table(spark, d, "part"), p_partkey="p_partkey", a=F.lower("p_brand"), b=F.ltrim(F.concat(F.lit("  "), t)), c=F.rtrim(F.concat(t, F.lit("  "))), e=F.repeat(t, 2), f=F.left(n, F.lit(3)), g=F.right(n, F.lit(3)), h=F.ascii(n), i=F.chr(F.col("p_size") + 65),
        j=F.bit_length(n), k=F.octet_length(n), l=F.hex("p_partkey"), m=F.contains(n, F.lit("re")), n=F.endswith(n, F.lit("d")), o=F.base64(t.cast("binary")), q=F.rpad(t, 8, "."), r=F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")),
    )


@query("SELECT event_id, CAST(extract(hour FROM ts) AS BIGINT) AS a, CAST(extract(minute FROM ts) AS BIGINT) AS b, (ts + INTERVAL 3 DAY)::TIMESTAMP AS c, last_day(ts)::TIMESTAMP AS e, CAST(extract(month FROM ts) AS BIGINT) AS f, CAST(extract(day FROM ts) AS BIGINT) AS g, make_timestamp(1000000 * event_id) AS h, ts::DATE::TIMESTAMP AS i, CAST(isodow(ts) AS BIGINT) AS j FROM events")
def fn_date_more(spark, d):
    at = F.col("ts")
    return op.project(
        table(spark, d, "events"), event_id="event_id", a=F.hour(at).cast("bigint"), b=F.minute(at).cast("bigint"), c=at + F.expr("INTERVAL 3 DAY"), e=F.last_day(at).cast("timestamp_ntz"), f=F.month(at).cast("bigint"), g=F.day(at).cast("bigint"),
        h=F.timestamp_seconds("event_id").cast("timestamp_ntz"), i=F.to_date(at).cast("timestamp_ntz"), j=(F.weekday(at) + 1).cast("bigint"),
    )


@query("SELECT n_regionkey, list_sort(list(n_nationkey))::BIGINT[] AS a, list_sum(list(n_nationkey))::BIGINT AS b, len(list_filter(list(n_nationkey), lambda x: x % 2 = 0))::BIGINT AS c, list_sort(list_transform(list(n_nationkey), lambda x: x * 2))::BIGINT[] AS e, list_sort(list_concat(list(n_nationkey), [99]))::BIGINT[] AS f FROM nation GROUP BY n_regionkey")
def fn_array_more(spark, d):
    keys = F.collect_list(F.col("n_nationkey").cast("bigint"))
    found = op.aggregate(table(spark, d, "nation"), ["n_regionkey"], k=keys)
    return op.project(found, n_regionkey="n_regionkey", a=F.array_sort("k"), b="aggregate(k, 0L, (x, y) -> x + y)", c=F.size(F.filter("k", lambda x: x % 2 == 0)).cast("bigint"), e=F.array_sort(F.transform("k", lambda x: x * 2)), f=F.array_sort(F.array_append("k", F.lit(99).cast("bigint"))))


@query("SELECT s.k AS k, s.v AS v, m['a'] AS a FROM (SELECT {'k': p_partkey, 'v': p_size} AS s, MAP {'a': p_brand, 'b': p_type} AS m FROM part)")
def fn_struct_map(spark, d):
    made = op.project(table(spark, d, "part"), s=F.struct(F.col("p_partkey").alias("k"), F.col("p_size").alias("v")), m=F.create_map(F.lit("a"), "p_brand", F.lit("b"), "p_type"))
    return made.select("s.k", "s.v", F.col("m")["a"].alias("a"))


both("agg_more", "SELECT l_returnflag, CAST(bit_and(l_linenumber) AS bigint) AS ba, CAST(bit_xor(l_linenumber) AS bigint) AS bx, bool_or(l_quantity > 49) AS bo, round(var_samp(l_quantity), 5) AS vs, round(stddev_pop(l_quantity), 6) AS sp, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS rs, CAST(regr_count(l_extendedprice, l_quantity) AS bigint) AS rc, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    from larkspur import streaming

    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streaming.tumbling(events, "ts", "6 hours", ("event_type",), n=F.count("*"), v=F.round(F.sum("value"), 2))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "v")


# further members of the function families


@query("SELECT l_orderkey, l_linenumber, round(asinh(l_quantity), 6) AS a, round(acosh(l_quantity), 6) AS b, round(atanh(l_discount), 6) AS c, round(cot(l_quantity), 4) AS e, round_even(l_quantity / 4, 0) AS f, isnan(l_tax) AS g, round(l_extendedprice, -2) AS h FROM lineitem")
def fn_math_more(spark, d):
    q, x = F.col("l_quantity"), F.col("l_discount")
    return op.project(table(spark, d, "lineitem"), l_orderkey="l_orderkey", l_linenumber="l_linenumber", a=F.round(F.asinh(q), 6), b=F.round(F.acosh(q), 6), c=F.round(F.atanh(x), 6), e=F.round(F.cot(q), 4), f=F.bround(q / 4, 0), g=F.isnan(F.nanvl(F.col("l_tax"), F.lit(0.0))), h=F.round("l_extendedprice", -2))


@query("SELECT event_id, coalesce(nullif(event_type, 'view'), 'seen') AS a, CASE WHEN nullif(event_type, 'click') IS NOT NULL THEN 'other' ELSE 'click' END AS b, greatest(value, 10) AS c, least(value, 10) AS e, if(value > 50, 'high', 'low') AS f, lower(typeof(value)) AS g, lower(typeof(event_id)) AS h FROM events")
def fn_conditional(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    return op.project(
        table(spark, d, "events"), event_id="event_id", a=F.nvl(F.nullif(kind, F.lit("view")), F.lit("seen")), b=F.nvl2(F.nullif(kind, F.lit("click")), F.lit("other"), F.lit("click")), c=F.greatest(value, F.lit(10.0)), e=F.least(value, F.lit(10.0)), f=F.when(value > 50, "high").otherwise("low"),
        g=F.typeof(value), h=F.typeof("event_id"),
    )


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS a, trim(p_name, 'ab') AS b, substr(p_name, 1, 1) || 'XY' || substr(p_name, 4) AS c, coalesce(list_position(['x', p_type, 'y'], p_type), 0)::INT AS e, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS f, decode(unhex(hex(p_name))) AS g, sha1(p_name) AS h, instr(p_brand, '#')::INT AS i FROM part")
def fn_string_third(spark, d):
    n, t = F.col("p_name"), F.col("p_type")
    return op.project(
        table(spark, d, "part"), p_partkey="p_partkey", a=F.initcap(n), b=F.btrim(n, F.lit("ab")), c=F.overlay(n, F.lit("XY"), 2, 2), e=F.find_in_set(t, F.concat(F.lit("x,"), t, F.lit(",y"))), f=F.substring_index(n, " ", 2), g=F.decode(F.unhex(F.hex(F.encode(n, "UTF-8"))), "UTF-8"), h=F.sha1(n.cast("binary")),
        i=F.position(F.lit("#"), F.col("p_brand")),
    )


@query("SELECT p_partkey, regexp_extract_all(p_name, '[aeiou]') AS a, len(regexp_extract_all(p_name, '[a-m]'))::INT AS b, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) AS c FROM part")
def fn_regex_more(spark, d):
    n = F.col("p_name")
    return op.project(table(spark, d, "part"), p_partkey="p_partkey", a=F.regexp_extract_all(n, F.lit("[aeiou]"), F.lit(0)), b=F.regexp_count(n, F.lit("[a-m]")), c=F.regexp_extract(n, "([a-z]+) ([a-z]+)", 2))


@query("SELECT event_id, strptime(strftime(ts, '%Y/%m/%d %H:%M'), '%Y/%m/%d %H:%M')::TIMESTAMP AS a, strftime(make_timestamp(1000000 * event_id), '%Y-%m-%d %H:%M:%S') AS b, time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS c, strftime(ts, '%d.%m.%Y') AS e, CAST(date_diff('month', TIMESTAMP '2023-01-01', date_trunc('month', ts)) AS BIGINT) AS f, dayname(ts)[1:3] AS g FROM events")
def fn_date_parse(spark, d):
    at = F.col("ts")
    form = "yyyy/MM/dd HH:mm"
    return op.project(
        table(spark, d, "events"), event_id="event_id", a=F.to_timestamp(F.date_format(at, form), form).cast("timestamp_ntz"), b=F.from_unixtime("event_id"), c=functions.date_bin("15 minutes", at).cast("timestamp_ntz"), e=F.date_format(at, "dd.MM.yyyy"),
        f=F.months_between(F.date_trunc("month", at), F.lit("2023-01-01").cast("timestamp")).cast("bigint"), g=F.date_format(at, "EEE"),
    )


@query("SELECT p_partkey, list_sort(list_distinct(list_concat(a, b))) AS u, list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS x, list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x)))) AS i, a[2:3] AS s, list_concat(a, b) AS f, list_filter(a, lambda x: x <> 'red') AS r, list_transform(range(3), lambda k: p_size) AS p, len(list_filter(a, lambda x: list_contains(b, x))) > 0 AS o, list_reverse(a) AS v FROM (SELECT *, string_split(p_name, ' ') AS a, string_split('red blue ' || lower(p_type), ' ') AS b FROM part)")
def fn_array_sets(spark, d):
    found = table(spark, d, "part").withColumns({"a": F.split("p_name", " "), "b": F.split(F.concat(F.lit("red blue "), F.lower("p_type")), " ")})
    return op.project(
        found, p_partkey="p_partkey", u=F.array_sort(F.array_union("a", "b")), x=F.array_sort(F.array_except("a", "b")), i=F.array_sort(F.array_intersect("a", "b")), s=F.slice("a", 2, 2), f=F.flatten(F.array("a", "b")), r=F.array_remove("a", "red"), p=F.array_repeat("p_size", 3),
        o=F.arrays_overlap("a", "b"), v=F.reverse("a"),
    )


@query("SELECT p_partkey, map_keys(m) AS k, map_values(m) AS v, cardinality(m)::INT AS n FROM (SELECT p_partkey, MAP {'a': p_brand, 'b': p_type} AS m FROM part)")
def fn_map_more(spark, d):
    made = op.project(table(spark, d, "part"), p_partkey="p_partkey", m=F.create_map(F.lit("a"), "p_brand", F.lit("b"), "p_type"))
    return op.project(made, p_partkey="p_partkey", k=F.map_keys("m"), v=F.map_values("m"), n=F.size("m"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, '{\"id\":' || event_id || ',\"t\":\"' || event_type || '\"}' AS j FROM events")
def fn_json_more(spark, d):
    return op.project(table(spark, d, "events"), event_id="event_id", k=F.from_json("props", "k string")["k"], j=F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("t"))))


@query("SELECT l_returnflag, true AS near_count, true AS near_median FROM lineitem GROUP BY l_returnflag")
def agg_approximate(spark, d):
    """Approximate aggregates within 10 % and one unit of the exact ones."""
    rows = table(spark, d, "lineitem", columns=["l_returnflag", "l_partkey", "l_quantity"])
    # apart: beside a distinct count, Spark would keep the state of every other aggregate for each distinct value
    near = op.aggregate(rows, ["l_returnflag"], near_parts=F.approx_count_distinct("l_partkey", 0.02), near_middle=F.percentile_approx("l_quantity", 0.5, 10_000))
    parts = op.aggregate(op.distinct(rows, "l_returnflag", "l_partkey"), ["l_returnflag"], parts=F.count("l_partkey"))
    counted = op.aggregate(rows, ["l_returnflag", "l_quantity"], n=F.count("*"))
    middle = op.aggregate(counted, ["l_returnflag"], middle=F.percentile("l_quantity", 0.5, F.col("n")))
    for exact in (parts, middle):
        near = op.join(near, exact.withColumnRenamed("l_returnflag", "flag"), F.col("l_returnflag").eqNullSafe(F.col("flag"))).drop("flag")
    return op.project(near, l_returnflag="l_returnflag", near_count=F.abs(F.col("near_parts") - F.col("parts")) <= 0.1 * F.col("parts"), near_median=F.abs(F.col("near_middle") - F.col("middle")) <= 1)


# files, views and descriptions


def _again(spark, d, kind: str, **options):
    """A table written in a format and read back with its schema."""
    found = table(spark, d, "orders", columns=["o_orderkey", "o_orderpriority", "o_totalprice"])
    path = sources.scratch(spark, kind)
    sources.write(found, path, kind=kind, **options)
    return sources.scan(spark, path, kind=kind, schema="o_orderkey bigint, o_orderpriority string, o_totalprice double", **options)


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def file_csv(spark, d):
    return _again(spark, d, "csv", header=True)


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def file_json(spark, d):
    return _again(spark, d, "json")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def file_orc(spark, d):
    return _again(spark, d, "orc")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY ALL")
def file_partitioned(spark, d):
    """Folders by the values of a column: the filter reads one of them."""
    path = sources.scratch(spark, "by-priority")
    sources.write(table(spark, d, "orders", columns=["o_orderkey", "o_orderpriority"]), path, partition_by=["o_orderpriority"])
    return op.aggregate(sources.scan(spark, path, where="o_orderpriority LIKE '1%'"), ["o_orderpriority"], n=F.count("*"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def create_view(spark, d):
    catalog.register(spark, d, ["customer"])
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW overdrawn AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
    return spark.sql("SELECT * FROM overdrawn")


@query("SELECT col_name, data_type FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) AS t(col_name, data_type)")
def describe_table(spark, d):
    catalog.register(spark, d, ["nation"])
    return spark.sql("DESCRIBE nation").select("col_name", "data_type")


@query("SELECT true AS filters, true AS prunes")
def explain_plan(spark, d):
    """The plan of a query as a row: it filters, and reads two columns."""
    catalog.register(spark, d, ["nation"])
    plan = F.col("plan")
    return spark.sql("EXPLAIN FORMATTED SELECT n_name FROM nation WHERE n_regionkey = 1").select(plan.contains("PushedFilters: [IsNotNull(n_regionkey), EqualTo(n_regionkey,1)]").alias("filters"), plan.contains("ReadSchema: struct<n_name:string,n_regionkey:int>").alias("prunes"))


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_sort_merge(spark, d):
    """The join of two large tables, as it is planned beyond every broadcast."""
    orders = table(spark, d, "orders", columns=["o_orderkey", "o_orderdate"])
    return op.join(table(spark, d, "lineitem", columns=["l_orderkey", "l_linenumber"]).hint("merge"), orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate")


# windows of time


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([b, b - INTERVAL 3 HOURS]) AS start FROM (SELECT event_type, time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') AS b FROM events)) GROUP BY ALL")
def sliding_window(spark, d):
    from larkspur import streaming

    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streaming.tumbling(events, "ts", "6 hours", ("event_type",), slide="3 hours", n=F.count("*"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh, event_id FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_window(spark, d):
    from larkspur import streaming

    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streaming.sessions(events, "ts", "30 minutes", ("user_id",), n=F.count("*"))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
