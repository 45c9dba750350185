"""Joins, SQL scripts over partitions by name, and checks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.jobs import build
from datakiln.jobs.sqlscript import Warehouse
from datakiln.operators import cubes, stats
from datakiln.queries.registry import Query, registrar, rounded, table
from datakiln.sources import runs

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = registrar(QUERIES)


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(count(*) AS BIGINT) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def inner_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables, equal keys; filters and columns reach the scans."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("items"))


@query("""SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("""SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""")
def full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select("c_custkey")
    return left.join(table(spark, sf_dir, "supplier").select("s_suppkey"), F.col("c_custkey") == F.col("s_suppkey"), "full")


@query("""SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_regionkey > r_regionkey""")
def cross_join_with_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unequal condition over two dimension tables of fixed size."""
    return table(spark, sf_dir, "region").crossJoin(table(spark, sf_dir, "nation")).filter("n_regionkey > r_regionkey").select("r_name", "n_name")


@query("""SELECT "key", n_name, r_name FROM (SELECT n_regionkey AS "key", n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS "key", r_name FROM region)""")
def natural_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("key"), "n_name")
    right = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), "r_name")
    return left.join(right, [c for c in left.columns if c in right.columns])


@query("""SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def code_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes to labels."""
    labels = cubes.value_labels(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")
    return cubes.with_labels(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", labels, "nation").select("c_custkey", "nation")


@query("""SELECT c_custkey, n_nationkey AS code FROM (SELECT c_custkey, coalesce(n_name, 'none') AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey) LEFT JOIN nation ON n_name = label""")
def labels_to_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels back to codes."""
    labels = cubes.value_labels(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")
    named = cubes.with_labels(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", labels, "nation")
    return cubes.with_codes(named, "nation", labels, "code").select("c_custkey", "code")


@query("""SELECT s_suppkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def linked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A foreign key that carries its row."""
    made = cubes.with_linked_row(table(spark, sf_dir, "supplier"), "s_nationkey", table(spark, sf_dir, "nation"), "n_nationkey", "nation")
    return made.select("s_suppkey", "nation.n_name", "nation.n_regionkey")


@query("""SELECT n_nationkey AS "key", b.balance AS customers_balance, b.n AS customers_n, s.balance AS suppliers_balance FROM nation
JOIN (SELECT c_nationkey AS k, round(avg(c_acctbal), 6) AS balance, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 HAVING count(*) > 1) b ON n_nationkey = b.k
JOIN (SELECT s_nationkey AS k, round(avg(s_acctbal), 6) AS balance FROM supplier GROUP BY 1) s ON n_nationkey = s.k""")
def indicator_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several filtered indicator tables on one entity key."""
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(rounded(F.avg("c_acctbal")).alias("balance"), F.count("*").alias("n"))
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(rounded(F.avg("s_acctbal")).alias("balance"))
    entity = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    return cubes.indicators(entity, "key", {"customers": (customers, F.col("n") > 1), "suppliers": (suppliers, None)})


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in (("l_quantity", "l_quantity"), ("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_extendedprice"), ("l_extendedprice", "l_discount"), ("l_discount", "l_discount"))))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of measures in one aggregation."""
    made = stats.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return made.withColumn("corr", rounded("corr"))


@query("""SELECT r_name AS region, CAST(count(*) AS BIGINT) AS big, round(max(o_totalprice), 2) AS dearest FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_totalprice > 100000 GROUP BY 1""")
def script_over_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script with partition names, views and a result."""
    house = Warehouse(spark, {f"sales.example-{n}-1": f"{sf_dir}/{n}.parquet" for n in ("orders", "customer", "nation", "region")})
    return house.run("""
        DROP VIEW IF EXISTS big_orders; -- from an earlier run
        INSTALL sales.example-orders-1;
        CREATE VIEW big_orders AS SELECT o_custkey AS cust, o_totalprice AS price FROM sales.example-orders-1 WHERE o_totalprice > 100000;
        SELECT r_name AS region, count(*) AS big, round(max(price), 2) AS dearest FROM big_orders AS b
        JOIN sales.example-customer-1 AS c ON b.cust = c.c_custkey JOIN sales.example-nation-1 AS n ON c.c_nationkey = n.n_nationkey
        JOIN sales.example-region-1 AS r ON n.n_regionkey = r.r_regionkey GROUP BY r_name;
        """)


@query("""SELECT c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def script_in_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script whose SELECT stands before the views that it needs."""
    house = Warehouse(spark, {f"any.order-{n}-1": f"{sf_dir}/{n}.parquet" for n in ("orders", "customer")})
    return house.run("""
        SELECT c_mktsegment AS segment, count(*) AS orders, round(sum(price), 2) AS total FROM done_orders JOIN any.order-customer-1 AS c ON cust = c.c_custkey GROUP BY c_mktsegment;
        CREATE VIEW done_orders AS SELECT o_custkey AS cust, o_totalprice AS price FROM any.order-orders-1 WHERE o_orderstatus = 'F';
        SELECT 'never run';
        """)


INDEXED = "SELECT c_mktsegment AS segment, count(*) AS items, round(sum(l_quantity), 2) AS quantity FROM by.query-lineitem-1 AS l JOIN by.query-orders-1 AS o ON l.l_orderkey = o.o_orderkey JOIN by.query-customer-1 AS c ON o.o_custkey = c.c_custkey GROUP BY c_mktsegment"


def indexed_house(spark: SparkSession, sf_dir: str) -> Warehouse:
    return Warehouse(spark, {f"by.query-{n}-1": f"{sf_dir}/{n}.parquet" for n in ("lineitem", "orders", "customer")})


@query("""SELECT c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS items, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def joins_indexed_from_the_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions saved in buckets of the columns on which a statement joins them, as its plan tells, and the statement over them."""
    house = indexed_house(spark, sf_dir)
    house.index_joins(INDEXED)
    return house.query(INDEXED)


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def not_yet_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a manifest does not have: the incremental step of a build."""
    seen = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    listed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"))
    return runs.still_pending(listed, seen.withColumnRenamed("o_orderkey", "name")).withColumnRenamed("name", "o_orderkey")


@query("""SELECT 'rule:priced' AS "check", '0' AS expected, CAST(count(*) FILTER (o_totalprice <= 50000) AS VARCHAR) AS found FROM orders
UNION ALL SELECT 'rows', '1', CAST(count(*) AS VARCHAR) FROM orders""")
def failed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a built table that do not hold."""
    orders = table(spark, sf_dir, "orders")
    return build.failed_checks(orders, columns=orders.columns, rows=1, rules={"priced": F.col("o_totalprice") > 50000, "named": F.col("o_orderkey").isNotNull()})
