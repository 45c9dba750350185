"""Casts, codes, error reports, inference and headers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datakiln.functions import casts
from datakiln.operators import headers, infer, transforms
from datakiln.operators.cubes import measure_by
from datakiln.operators.rows import skip_rows
from datakiln.queries.registry import Query, registrar, rounded, table

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = registrar(QUERIES)

SPOILT_SQL = """
spoilt AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus,
    CASE WHEN l_quantity > 45 THEN '*' WHEN l_linenumber = 7 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS quantity,
    CASE WHEN l_discount > 0.09 THEN 'n/a' ELSE ' ' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) || ' ' END AS cents
  FROM lineitem)"""


def spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a messy source: text columns, some values spoilt."""
    quantity = F.when(F.col("l_quantity") > 45, "*").when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    cents = F.when(F.col("l_discount") > 0.09, "n/a").otherwise(F.concat(F.lit(" "), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), F.lit(" ")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", quantity.alias("quantity"), cents.alias("cents"))


def spoilt_table() -> headers.TableSpec:
    specs = [
        headers.ColumnSpec(1, "l_orderkey", "int", role="k"),
        headers.ColumnSpec(2, "l_returnflag", "str", role="d"),
        headers.ColumnSpec(3, "l_linestatus", "str", role="d"),
        headers.ColumnSpec(4, "quantity", "int", role="m", transform=";;clear_error"),
        headers.ColumnSpec(5, "quantity_code", "str", parent="quantity", transform=";row.quantity.failed_value"),
        headers.ColumnSpec(6, "cents", "float", role="m"),
        headers.ColumnSpec(7, "price", "float", role="m", transform=";row.cents|hundredth"),
    ]
    return headers.TableSpec("items", {c.name: c for c in specs})


def cast_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.cast_columns(spoilt(spark, sf_dir), spoilt_table(), {"hundredth": lambda v: v / 100})


@query(f"""WITH {SPOILT_SQL.strip()}, cast_ AS (
  SELECT l_returnflag, l_linestatus, try_cast(trim(cents) AS DOUBLE) / 100 AS price, CASE WHEN quantity = '*' THEN quantity END AS code FROM spoilt)
SELECT l_returnflag, l_linestatus, round(avg(price), 6) AS price, CAST(count(*) AS BIGINT) AS count FROM cast_
WHERE code IS NULL GROUP BY 1, 2""")
def cast_skip_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy text to a declared table, rows with a quantity code skipped, mean price and count by two dimensions."""
    kept = skip_rows(cast_items(spark, sf_dir), F.col("quantity_code") == "*")
    return measure_by(kept, "price", ["l_returnflag", "l_linestatus"]).withColumn("price", rounded("price"))


@query(f"""WITH {SPOILT_SQL.strip()}
SELECT quantity_code, CAST(count(*) AS BIGINT) AS rows, CAST(sum(quantity) AS BIGINT) AS quantity FROM (
  SELECT CASE WHEN quantity = '*' THEN '*' END AS quantity_code, try_cast(nullif(quantity, '') AS BIGINT) AS quantity FROM spoilt) GROUP BY 1""")
def code_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failed to cast stays beside the value as a code."""
    return cast_items(spark, sf_dir).groupBy("quantity_code").agg(F.count("*").alias("rows"), F.sum("quantity").alias("quantity"))


@query(f"""WITH {SPOILT_SQL.strip()}
SELECT 'cents' AS "column", cents AS value, CAST(count(*) AS BIGINT) AS rows FROM spoilt WHERE cents = 'n/a' GROUP BY cents""")
def cast_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that failed and were not cleared, by column."""
    return transforms.error_report(cast_items(spark, sf_dir))


NUMBERS_SQL = """
texts AS (
  SELECT l_orderkey, l_linenumber, CASE CAST(l_orderkey % 7 AS INTEGER)
    WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 1 THEN ' -' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || chr(9)
    WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5' WHEN 3 THEN '1.0d' WHEN 4 THEN '  ' WHEN 5 THEN '1,' || CAST(l_linenumber AS VARCHAR) || '00' ELSE 'x' || l_returnflag END AS t
  FROM lineitem),
stripped AS (SELECT *, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM texts)"""


@query(f"""WITH {NUMBERS_SQL.strip()}, made AS (SELECT *,
  regexp_matches(s, '^[+-]?[0-9]+$') AS whole, regexp_matches(s, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') AS number,
  regexp_matches(replace(s, ',', ''), '^[+-]?[0-9]+$') AS commas FROM stripped)
SELECT l_orderkey, l_linenumber,
  CASE WHEN whole THEN try_cast(s AS BIGINT) END AS as_int, CASE WHEN number THEN try_cast(s AS DOUBLE) END AS as_float, nullif(t, '') AS as_text,
  CASE WHEN number THEN CAST(round(try_cast(s AS DOUBLE)) AS BIGINT) END AS rounded, CASE WHEN number THEN CAST(trunc(try_cast(s AS DOUBLE)) AS BIGINT) END AS cut,
  CASE WHEN commas THEN try_cast(replace(s, ',', '') AS BIGINT) END AS cleaned, coalesce(CASE WHEN whole THEN try_cast(s AS BIGINT) END, -1) AS defaulted,
  CASE WHEN nullif(s, '') IS NOT NULL AND NOT whole THEN t END AS code,
  coalesce(CASE WHEN whole THEN CAST(try_cast(s AS BIGINT) AS VARCHAR) END, t) AS kept FROM made""")
def number_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number cast over texts in many forms."""
    items = table(spark, sf_dir, "lineitem")
    whole, kind = F.col("l_quantity").cast("bigint").cast("string"), F.col("l_orderkey") % 7
    t = (
        F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit(" -"), whole, F.lit("\t"))).when(kind == 2, F.concat(whole, F.lit(".5"))).when(kind == 3, "1.0d").when(kind == 4, "  ")
        .when(kind == 5, F.concat(F.lit("1,"), F.col("l_linenumber").cast("string"), F.lit("00"))).otherwise(F.concat(F.lit("x"), "l_returnflag"))
    )
    texts = items.select("l_orderkey", "l_linenumber", t.alias("t"))
    c = F.col("t")
    return texts.select(
        "l_orderkey", "l_linenumber", casts.to_int(c).alias("as_int"), casts.to_float(c).alias("as_float"), casts.to_text(c).alias("as_text"), casts.parse_int(c).alias("rounded"),
        casts.int_cut(c).alias("cut"), casts.clean_int(c).alias("cleaned"), casts.int_or(c, -1).alias("defaulted"), casts.failed_value(c, casts.to_int(c)).alias("code"), casts.keep_or_cast(c, "int").alias("kept"),
    )


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS stroke, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS short_year,
  strftime(date_trunc('second', o_orderdate), '%Y-%m-%d %H:%M:%S') AS stamp, strftime(o_orderdate, '%H:%M:00') AS clock, CAST(NULL AS VARCHAR) AS junk FROM orders""")
def date_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, timestamps and times from texts in several forms."""
    orders = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate")
    text = lambda f: F.date_format(at, f)
    return orders.select(
        "o_orderkey",
        casts.to_date(text("yyyy-MM-dd")).cast("string").alias("day"),
        casts.to_date(F.concat(F.lit(" "), text("MM/dd/yyyy"))).cast("string").alias("stroke"),
        casts.to_date(text("MM/dd/yy")).cast("string").alias("short_year"),
        F.date_format(casts.to_timestamp(text("yyyy-MM-dd'T'HH:mm:ss")), "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        casts.to_time(text("h:mm a")).alias("clock"),
        casts.to_date(F.concat(F.lit("not "), text("yyyy"))).cast("string").alias("junk"),
    )


@query("""SELECT o_orderkey, CAST(DATE '1899-12-30' + CAST(60 + o_orderkey % 40000 AS INTEGER) AS VARCHAR) AS day_1900,
  CAST(DATE '1904-01-01' + CAST(60 + o_orderkey % 40000 AS INTEGER) AS VARCHAR) AS day_1904 FROM orders""")
def spreadsheet_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serial day numbers in both calendars."""
    serial = (F.col("o_orderkey") % 40000 + 60).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(casts.excel_date(serial)).cast("string").alias("day_1900"), F.to_date(casts.excel_date(serial, 1904)).cast("string").alias("day_1904"))


@query("""WITH long AS (
  SELECT 'key' AS "column", CAST(o_orderkey AS VARCHAR) AS t FROM orders UNION ALL SELECT 'price', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.25' FROM orders
  UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'status', o_orderstatus FROM orders
  UNION ALL SELECT 'coded', CASE WHEN o_orderkey % 50 = 0 THEN '*' ELSE CAST(o_custkey AS VARCHAR) END FROM orders UNION ALL SELECT 'blank', '  ' FROM orders),
kinds AS (SELECT "column", CASE WHEN trim(t) = '' THEN 'null' WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN 'int' WHEN try_cast(t AS DOUBLE) IS NOT NULL THEN 'float' WHEN regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'date' ELSE 'str' END AS kind FROM long)
SELECT "column", CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (kind = 'null') AS BIGINT) AS nulls, CAST(count(*) FILTER (kind = 'int') AS BIGINT) AS "int",
  CAST(count(*) FILTER (kind = 'float') AS BIGINT) AS "float", CAST(count(*) FILTER (kind = 'date') AS BIGINT) AS "date", CAST(count(*) FILTER (kind = 'str') AS BIGINT) AS str,
  CASE "column" WHEN 'key' THEN 'int' WHEN 'price' THEN 'float' WHEN 'day' THEN 'date' WHEN 'status' THEN 'str' WHEN 'coded' THEN 'int' ELSE 'unknown' END AS datatype, "column" = 'coded' AS has_codes
FROM kinds GROUP BY "column" """)
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of text columns from one pass over all values."""
    key = F.col("o_orderkey")
    texts = table(spark, sf_dir, "orders").select(
        key.cast("string").alias("key"), F.concat(F.floor("o_totalprice").cast("string"), F.lit(".25")).alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("status"),
        F.when(key % 50 == 0, "*").otherwise(F.col("o_custkey").cast("string")).alias("coded"), F.lit("  ").alias("blank"),
    )
    return infer.resolved(infer.type_counts(texts)).select("column", "total", "nulls", "int", "float", "date", "str", "datatype", "has_codes")


@query("""SELECT c_custkey AS customer_key, c_name AS column1, c_nationkey AS n_a_key, c_nationkey AS n_a_key_4 FROM customer""")
def mangled_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy names mangled, blank ones named by position, repeated ones by place."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_nationkey")
    return headers.mangled(rows.toDF(" Customer Key ", " ", "N/A -- Key__", "n.a. key"))


@query("""SELECT s_suppkey AS "key", s_name AS name, CAST(NULL AS DOUBLE) AS missing, s_nationkey AS nation FROM supplier""")
def table_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a declared layout: renamed, missing columns null, others dropped."""
    layout = T.StructType([T.StructField("key", T.LongType()), T.StructField("name", T.StringType()), T.StructField("missing", T.DoubleType()), T.StructField("nation", T.IntegerType())])
    return headers.laid_out(headers.renamed(table(spark, sf_dir, "supplier"), {"s_suppkey": "key", "s_name": "name", "s_nationkey": "nation"}), layout)


@query("""SELECT r_regionkey, r_name FROM region""")
def without_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with a header but no data are dropped; zeros and empty texts are no data."""
    rows = table(spark, sf_dir, "region").withColumns({"none": F.lit(None).cast("string"), "empty": F.lit(""), "zero": F.lit(0)})
    return headers.without_empty_columns(rows)


@query("""SELECT c_custkey AS id, n_name AS state_name, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_nationkey / 100.0 END AS rate, CASE WHEN c_nationkey % 4 = 0 THEN '1.5' END AS rate_code,
  CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE round(c_nationkey / 100.0 * 100, 6) END AS percent, '19' || CAST(70 + c_nationkey AS VARCHAR) || '/20' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS years, CAST(1970 + c_nationkey AS INTEGER) AS first_year,
  round((c_nationkey + 1) / 1.645 * 1.96, 6) AS wider, c_nationkey * 3 AS thrice, replace(upper(c_mktsegment), 'A', 'x|v') AS segment, lower(c_mktsegment) AS abbreviation, CAST(12 AS INTEGER) AS zip FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def value_types_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of declared value types, their attributes, a linked table of states, and SQL expressions in the pipes."""
    n = F.col("c_nationkey")
    rate = F.when(n % 4 == 0, "1.5").otherwise((n / 100).cast("string"))
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), n.cast("string").alias("state"), rate.alias("rate"), F.concat(F.lit("19"), n + 70, F.lit("-20"), F.lpad(n.cast("string"), 2, "0")).alias("years"),
        (n + 1).cast("string").alias("margin"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit(" "), "c_mktsegment").alias("abbreviation"), F.lit("00012").alias("zip"),
    )
    c = headers.ColumnSpec
    specs = [
        c(1, "id", "int"), c(2, "state", "int", valuetype="fips/state"), c(3, "state_name", "str", transform=";row.state.name"), c(4, "rate", "float", valuetype="rate", transform=";;clear_error"), c(5, "rate_code", "str", transform=";row.rate.failed_value"),
        c(6, "percent", "float", transform=";row.rate.percent"), c(7, "years", "str", valuetype="year/range"), c(8, "first_year", "int", transform=";row.years.start"), c(9, "margin", "float", valuetype="margin/90"), c(10, "wider", "float", transform=";row.margin.m95"),
        c(11, "thrice", "int", transform=";{row.state * 3}"), c(12, "segment", "str", transform="upper|{replace(v, 'A', concat('x', char(124), 'v'))}"), c(13, "abbreviation", "str", valuetype="stusab"), c(14, "zip", "int", valuetype="zip"),
    ]
    states = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("state"), F.col("n_name").alias("name"))
    made = transforms.cast_columns(raw, headers.TableSpec("people", {s.name: s for s in specs}), linked={"fips/state": states})
    return made.select("id", "state_name", "rate", "rate_code", rounded("percent").alias("percent"), "years", F.col("first_year").cast("int").alias("first_year"), rounded("wider").alias("wider"), F.col("thrice").cast("int").alias("thrice"), "segment", "abbreviation", F.col("zip").cast("int").alias("zip"))
