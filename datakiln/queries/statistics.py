"""Statistics, measures by dimensions, labels and coverage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.functions import values
from datakiln.operators import coverage, cubes, stats
from datakiln.queries.registry import Query, registrar, rounded, table

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = registrar(QUERIES)


def _stats_sql(c: str, number: bool) -> str:
    x = f"CAST({c} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    n = f"count({c})"
    shape = f"round(skewness({x}) * ({n} - 2) / sqrt({n} * ({n} - 1.0)), 6)" if number else "NULL"
    return f"""SELECT '{c}' AS "column", CAST({n} AS BIGINT) AS count, CAST(count(DISTINCT {c}) AS BIGINT) AS nuniques, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std,
      round(min({x}), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max,
      {shape} AS skewness, {f"round(kurtosis_pop({x}), 6)" if number else "NULL"} AS kurtosis FROM lineitem"""


@query(" UNION ALL ".join(_stats_sql(c, c != "l_returnflag") for c in ("l_quantity", "l_extendedprice", "l_tax", "l_returnflag")))
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, moments and exact quartiles of several columns in one pass."""
    items = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_tax", "l_returnflag")
    made = stats.column_stats(items, exact=True)
    return made.select("column", "count", "nuniques", *[rounded(n).alias(n) for n in stats.NUMBERS])


@query("""SELECT l_returnflag, 'l_quantity' AS "column", CAST(count(l_quantity) AS BIGINT) AS count, round(avg(l_quantity), 6) AS mean, round(max(l_quantity), 6) AS max, CAST(max(length(CAST(l_shipdate AS DATE)::VARCHAR)) AS BIGINT) AS width FROM lineitem GROUP BY 1""")
def statistics_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics for each partition key; quantiles and distinct counts are sketches here."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.to_date("l_shipdate").alias("day"))
    made = stats.column_stats(items, ["l_returnflag"])
    wide = made.groupBy("l_returnflag").agg(F.max(F.when(F.col("column") == "day", F.col("width"))).alias("width"))
    return made.filter(F.col("column") == "l_quantity").join(wide, "l_returnflag").select("l_returnflag", "column", "count", rounded("mean").alias("mean"), rounded("max").alias("max"), wide.width)


@query("""SELECT "column", value, CAST(count(*) AS BIGINT) AS count FROM (
  SELECT 'c_mktsegment' AS "column", c_mktsegment AS value FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer) WHERE value IS NOT NULL GROUP BY 1, 2""")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value to count of each column."""
    return stats.value_counts(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


@query("""SELECT "column", CAST(rank AS INTEGER) AS rank, value, count FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM (
  SELECT 'p_brand' AS "column", p_brand AS value, CAST(count(*) AS BIGINT) AS count FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, CAST(count(*) AS BIGINT) FROM part GROUP BY p_type)) WHERE rank <= 10""")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column's most frequent values."""
    return stats.top_values(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("""SELECT 'o_orderstatus' AS "column", string_agg(value || '=' || CAST(n AS VARCHAR), ',' ORDER BY value) AS uvalues FROM (SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1)""")
def unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of value to count, for columns of few values only: the key column is left out."""
    maps = stats.uvalues(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus", "o_orderkey"], most=100)
    pairs = F.transform(F.array_sort(F.map_entries("uvalues")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return maps.select("column", F.array_join(pairs, ",").alias("uvalues"))


@query("""WITH b AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders),
n AS (SELECT least(CAST(floor((o_totalprice - low) / ((high - low) / 16)) AS INTEGER), 15) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
SELECT 'o_totalprice' AS "column", round(low, 6) AS low, round(high, 6) AS high, (SELECT string_agg(CAST(coalesce(n.n, 0) AS VARCHAR), ',' ORDER BY i.i) FROM (SELECT unnest(range(16)) AS i) i LEFT JOIN n ON n.bin = i.i) AS hist FROM b""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal widths between the bounds, the last bin closed."""
    made = stats.histograms(table(spark, sf_dir, "orders"), ["o_totalprice"])
    return made.select("column", rounded("low").alias("low"), rounded("high").alias("high"), F.array_join(F.col("hist").cast("array<string>"), ",").alias("hist"))


@query("""WITH v AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS value FROM customer UNION ALL SELECT 'c_custkey', CAST(c_custkey AS VARCHAR) FROM customer),
d AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS place FROM (SELECT DISTINCT "column", value FROM v))
SELECT v."column", CASE v."column" WHEN 'c_mktsegment' THEN 'n' ELSE 'i' END AS lom, CAST(count(*) AS BIGINT) AS count, any_value(s.sample) AS sample
FROM v JOIN (SELECT "column", string_agg(value, ',' ORDER BY place) AS sample FROM d WHERE place <= 10 GROUP BY 1) s ON v."column" = s."column" GROUP BY v."column" """)
def statistics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of measurement, counts and the first values in order."""
    return stats.stats_report(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_custkey"]).drop("nuniques")


@query("""SELECT l_returnflag, round(avg(l_extendedprice), 6) AS l_extendedprice, CAST(count(*) AS BIGINT) AS count FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IS NOT NULL GROUP BY 1""")
def measure_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and rows by one dimension; a filter given as all options stands for the first."""
    made = cubes.measure_by(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], {"l_linestatus": ["O", "F"]})
    return made.withColumn("l_extendedprice", rounded("l_extendedprice"))


@query("""SELECT c_mktsegment, c_nationkey, round(avg(c_acctbal), 6) AS c_acctbal, CAST(count(*) AS BIGINT) AS count, string_agg(DISTINCT c_name, ', ' ORDER BY c_name) AS names FROM customer GROUP BY 1, 2""")
def measure_with_joined_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dimensions, and a text column as its joined distinct values."""
    rows = table(spark, sf_dir, "customer").withColumn("names", F.col("c_name"))
    return cubes.measure_by(rows, "c_acctbal", ["c_mktsegment", "c_nationkey"], extra=["names"]).withColumn("c_acctbal", rounded("c_acctbal"))


@query("""SELECT l_returnflag, round(avg(l_tax) FILTER (l_linestatus = 'F'), 6) AS "F", round(avg(l_tax) FILTER (l_linestatus = 'O'), 6) AS "O" FROM lineitem GROUP BY 1""")
def unstacked_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second dimension spread over columns."""
    made = cubes.unstacked(table(spark, sf_dir, "lineitem"), "l_tax", "l_returnflag", "l_linestatus", ["F", "O"])
    return made.select("l_returnflag", rounded("F").alias("F"), rounded("O").alias("O"))


SETS = [("l_returnflag",), ("l_linestatus",), ("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber")]


@query(" UNION ALL ".join(
    f"""SELECT '{",".join(s)}' AS "set", {", ".join(d if d in s else f"NULL AS {d}" for d in ("l_returnflag", "l_linestatus", "l_linenumber"))}, round(avg(l_discount), 6) AS l_discount, CAST(count(*) AS BIGINT) AS count
    FROM lineitem WHERE {" AND ".join(f"{d} IS NOT NULL" for d in s)} GROUP BY {", ".join(s)}"""
    for s in SETS
))
def all_dimension_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dimension set in one scan, from sums and counts at the finest grain."""
    return cubes.all_sets(table(spark, sf_dir, "lineitem"), "l_discount", SETS).withColumn("l_discount", rounded("l_discount"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS label FROM nation UNION ALL SELECT DISTINCT o_orderstatus, o_orderstatus FROM orders""")
def value_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with their labels; few values without labels are their own."""
    named = cubes.value_labels(table(spark, sf_dir, "nation"), "n_nationkey", "n_name").withColumn("code", F.col("code").cast("string"))
    return named.union(cubes.value_labels(table(spark, sf_dir, "orders"), "o_orderstatus"))


@query("""SELECT CAST(l_linenumber AS VARCHAR) AS code, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS labels FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def ambiguous_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that have more than one label."""
    made = cubes.ambiguous_labels(cubes.value_labels(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag"))
    return made.select(F.col("code").cast("string").alias("code"), "labels")


@query("""SELECT o_orderpriority, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS years FROM (SELECT DISTINCT o_orderpriority, year(o_orderdate) AS y FROM orders UNION SELECT DISTINCT o_orderpriority, unnest([1971, 1972, 1973]) FROM orders) GROUP BY 1""")
def time_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of the date column and of a declared interval."""
    rows = table(spark, sf_dir, "orders").withColumn("declared", F.lit("1971-01-01/1973-05-05"))
    made = coverage.time_coverage(rows, ["o_orderpriority"], ["o_orderdate"], ["declared"])
    return made.select("o_orderpriority", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


@query("""SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS rows, min(o_orderkey) AS min_id, max(o_orderkey) AS max_id, CAST(count(DISTINCT year(o_orderdate)) AS INTEGER) AS years,
  array_to_string(list_sort(list(DISTINCT year(o_orderdate)))[1:5], ',') AS first_years FROM orders GROUP BY 1""")
def partition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, id bounds, and how many and which years each partition covers."""
    return coverage.partition_summary(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderkey", F.year("o_orderdate"))


D62 = values.DIGITS62


@query(f"""WITH ids AS (SELECT s_suppkey, '0O' || substr('{D62}', CAST(s_nationkey // 62 AS INTEGER) + 1, 1) || substr('{D62}', CAST(s_nationkey % 62 AS INTEGER) + 1, 1)
    || substr('{D62}', CAST((s_suppkey % 7 + 1) // 62 AS INTEGER) + 1, 1) || substr('{D62}', CAST((s_suppkey % 7 + 1) % 62 AS INTEGER) + 1, 1) AS county, s_suppkey % 2 AS part FROM supplier)
SELECT part, string_agg(DISTINCT county, ',' ORDER BY county) AS places, '2qZZZZZZZZZ' AS grains FROM ids GROUP BY part""")
def space_and_grain_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block groups rolled up to counties, and the grain they are given at."""
    c = F.col
    ids = table(spark, sf_dir, "supplier").select((c("s_suppkey") % 2).alias("part"), values.gvid(c("s_nationkey"), c("s_suppkey") % 7 + 1, c("s_suppkey") * 3 + 1, F.lit(2)).alias("gvid"))
    space, grain = coverage.space_coverage(ids, ["part"], "gvid"), coverage.grain_coverage(ids, ["part"], "gvid")
    return space.join(grain, "part").select("part", F.array_join("places", ",").alias("places"), F.array_join("grains", ",").alias("grains"))


@query("""SELECT string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years FROM orders""")
def joint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years of a bundle from those of its partitions."""
    parts = coverage.time_coverage(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderdate"]).withColumn("bundle", F.lit(1))
    return coverage.joint_coverage(parts, ["bundle"], "years").select(F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))
