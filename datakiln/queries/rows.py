"""Selecting, editing, sampling, numbering and ordering rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.functions import nested, values
from datakiln.functions.casts import nullify
from datakiln.operators import row_index, rows
from datakiln.queries.registry import Query, registrar, rounded, table
from datakiln.sources import readers, runs

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = registrar(QUERIES)
POSITIONS = rows.sample_positions()


@query("""SELECT event_id, event_type, CASE WHEN value < 20 THEN NULL ELSE value END AS v FROM events WHERE event_type = 'click' AND NOT coalesce(CASE WHEN value < 20 THEN NULL ELSE value END > 60, FALSE)""")
def select_and_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Select keeps what is true, skip drops only what is true: a null passes the skip."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value") < 20, None).otherwise(F.col("value")).alias("v"))
    return rows.skip_rows(rows.select_rows(events, F.col("event_type") == "click"), F.col("v") > 60)


@query("""SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_quantity, l_extendedprice * (1 - l_discount) AS net, split_part(l_returnflag || '/' || l_linestatus, '/', 1) AS flag, split_part(l_returnflag || '/' || l_linestatus, '/', 2) AS status FROM lineitem""")
def edit_add_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions, edits of input values, additions and one expression over two columns, in one projection."""
    items = table(spark, sf_dir, "lineitem")
    gone = [c for c in items.columns if c not in ("l_orderkey", "l_linenumber", "l_quantity")]
    both = F.split(F.concat_ws("/", "l_returnflag", "l_linestatus"), "/")
    return rows.add_delete_expand(items, gone, {"l_quantity": lambda c: c * 2}, {"net": F.col("l_extendedprice") * (1 - F.col("l_discount"))}, {("flag", "status"): both})


@query("""SELECT o_custkey, o_orderstatus, o_orderkey, o_orderpriority, o_custkey AS o_custkey_5 FROM orders""")
def slice_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by ranges and single places, also from the end and repeated."""
    return rows.slice_columns(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "1:3,0,-1,1")


@query("""SELECT doc_id, nullif(trim(lang, ' ' || chr(9) || chr(10) || chr(13)), '') AS lang, nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, '') AS source FROM documents""")
def nullify_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns stripped; blank becomes null."""
    docs = table(spark, sf_dir, "documents")
    messy = docs.select("doc_id", F.concat(F.lit(" \t"), "lang", F.lit("\n")).alias("lang"), F.when(F.col("doc_id") % 3 == 0, " \n ").otherwise(F.col("source")).alias("source"))
    return rows.nullify_blanks(messy)


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def head_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in a stated order, without a full sort."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").transform(rows.head, 25, [F.desc("o_totalprice"), "o_orderkey"])


@query(f"""SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS spot FROM lineitem) WHERE spot IN ({', '.join(map(str, POSITIONS))})""")
def exponential_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at places that grow apart exponentially along a total order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rows.sample(items, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey % (SELECT greatest(count(*) // 20, 1) FROM orders) = 0 ORDER BY o_orderkey LIMIT 20""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (count / 20)-th id, 20 rows at most."""
    return rows.systematic_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("""SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'""")
def filtered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality filters joined by "and", then columns; both reach the scan."""
    return rows.where_equal(table(spark, sf_dir, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F"}, ["l_orderkey", "l_quantity"])


@query("""SELECT round(sum(l_quantity), 6) AS sum_l_quantity, round(min(l_discount), 6) AS min_l_discount, max(l_partkey) AS max_l_partkey FROM lineitem""")
def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Associative folds over all rows."""
    return rows.fold(table(spark, sf_dir, "lineitem"), ["l_quantity"], ["l_discount"], ["l_partkey"]).select(rounded("sum_l_quantity").alias("sum_l_quantity"), rounded("min_l_discount").alias("min_l_discount"), "max_l_partkey")


@query("""SELECT CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS id, o_orderkey FROM orders""")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free numbers along a total order, by ranges instead of one window."""
    return row_index.with_row_number(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT o_custkey, o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM orders""")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An accumulator along each customer's orders."""
    orders = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return row_index.running_total(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cents").select("o_custkey", "o_orderkey", "running")


@query("""SELECT name, nation FROM (SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, CAST(NULL AS INTEGER) FROM supplier)""")
def union_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of several tables by column name, missing columns null."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return united(spark, customers=customers, suppliers=suppliers)


def united(spark: SparkSession, **frames: DataFrame) -> DataFrame:
    """Frames as sources of one run."""
    for name, df in frames.items():
        df.createOrReplaceTempView(f"united_{name}")
    return runs.together(spark, [readers.SourceSpec(name, f"united_{name}", "frame") for name in frames]).drop("_source")


@query("""SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier""")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = [table(spark, sf_dir, t).select(F.col(c).alias("nation")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return united(spark, customers=nations[0], suppliers=nations[1]).distinct()


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, json_keys(props)[1] AS path FROM events""")
def flattened_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects as (path, value) rows."""
    leaves = nested.flattened_rows(table(spark, sf_dir, "events").select("event_id", "props"), "props")
    return leaves.select("event_id", F.col("value").cast("bigint").alias("n"), "path")


@query("""SELECT p_partkey, upper(p_name) AS shouted, lower(p_brand) AS quiet, p_type AS bare, substr(p_name, 1, 5) AS shortened, p_brand || '-' || CAST(p_size AS VARCHAR) AS name FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case, quotes, cuts and joined names."""
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("shouted"), F.lower("p_brand").alias("quiet"), values.dequote(F.concat(F.lit('"'), "p_type", F.lit('"'))).alias("bare"), values.cut(c("p_name"), 5).alias("shortened"),
        values.name_from_parts(c("p_brand"), nullify(F.lit(" ")), F.lit(""), c("p_size")).alias("name"),
    )
