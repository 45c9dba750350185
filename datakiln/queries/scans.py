"""What is carried along ordered rows, and folds by functions of the user."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.operators import headers, row_index, rows, transforms
from datakiln.queries.registry import Query, registrar, table

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = registrar(QUERIES)


@query("""SELECT o_orderkey, max(o_totalprice) OVER w AS highest, min(o_totalprice) OVER w AS lowest, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END IGNORE NULLS) OVER w AS finished_by, bool_and(o_orderstatus <> 'P') OVER w AS none_pending
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def carried_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest and lowest price so far, the last clerk that finished an order, and whether none is pending yet, along the orders of each customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    price, finished = F.col("o_totalprice"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    made = {"highest": ("greatest", price), "lowest": ("least", price), "finished_by": ("last", finished), "none_pending": ("every", F.col("o_orderstatus") != "P")}
    return row_index.prefix_scan(orders, ["o_custkey"], ["o_orderkey"], made).select("o_orderkey", *made)


@query("""SELECT "key", price, max(price) OVER w AS highest, CAST(coalesce(sum(CAST(price AS BIGINT)) OVER w, 0) AS BIGINT) AS total, last_value(clerk IGNORE NULLS) OVER w AS clerk FROM (
  SELECT o_orderkey AS "key", CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice) END AS price, CASE WHEN o_orderpriority <= '2' THEN o_orderpriority END AS clerk FROM orders)
WINDOW w AS (ORDER BY "key" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def accumulated_by_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column transforms that carry a value along the rows: the highest price so far, the sum so far, and gaps filled with the last clerk."""
    c = headers.ColumnSpec
    price = F.when(F.col("o_orderstatus") != "P", F.round("o_totalprice").cast("string")).otherwise("n/a")
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), price.alias("price"), F.when(F.col("o_orderpriority") <= "2", F.col("o_orderpriority")).alias("clerk"), F.col("o_orderkey").alias("nr"))
    specs = [c(1, "key", "int"), c(2, "price", "float", transform=";;clear_error"), c(3, "highest", "float", transform=";row.price|highest"), c(4, "total", "int", transform=";row.price|total"), c(5, "clerk", "str", transform=";filled")]
    functions = {"highest": lambda v, accumulator: accumulator("greatest", v), "total": lambda v, accumulator: accumulator("sum", v.cast("bigint")), "filled": lambda v, accumulator: accumulator("last", v)}
    return transforms.checked(transforms.cast_columns(raw, headers.TableSpec("orders", {s.name: s for s in specs}), functions, order=["nr"]))


@query("""SELECT o_orderkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM orders""")
def scanned_by_user_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest order of its status so far, the later one of equals, by a function of the user that does not commute; three statuses hold all rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("key")).alias("order"))
    dearer = lambda a, b: b if b["price"] >= a["price"] else a
    made = row_index.scan_with(orders, ["o_orderstatus"], ["o_orderkey"], "order", "best", dearer, "struct<price:double,key:bigint>")
    return made.select("o_orderkey", F.col("best.key").alias("best"))


@query("""SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, max(o_totalprice) AS best FROM orders GROUP BY ALL""")
def folded_by_user_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of the best price by year, merged by functions of the user for each priority, state by state."""
    sold = F.struct(F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"))

    def add(best: dict, x: dict) -> dict:
        best[x["year"]] = max(best.get(x["year"], x["price"]), x["price"])
        return best

    def merge(a: dict, b: dict) -> dict:
        return a | {year: max(price, a.get(year, price)) for year, price in b.items()}

    folded = rows.tree_fold(table(spark, sf_dir, "orders").select("o_orderpriority", sold.alias("sold")), ["o_orderpriority"], "sold", dict, add, merge, "map<int,double>")
    return folded.select("o_orderpriority", F.explode("state").alias("year", "best"))
