"""Partitioned builds: naming, coalescing with ids, looking up, and reports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.jobs import build, scratch
from datakiln.queries.registry import Query, registrar, rounded, table
from datakiln.streaming.ingest import windowed_counts

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = registrar(QUERIES)


def partitioned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return build.with_partition(orders, "orders", time=F.year("o_orderdate"), segment=F.col("o_orderstatus"))


@query("""SELECT 'orders-' || CAST(year(o_orderdate) AS VARCHAR) || '-' || o_orderstatus AS partition, CAST(count(*) AS BIGINT) AS rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def partition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to partitions by year and segment, named by their parts, blanks skipped."""
    return partitioned_orders(spark, sf_dir).groupBy("partition").agg(F.count("*").alias("rows"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT CAST(row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderstatus, o_orderkey) AS BIGINT) AS id, CAST(year(o_orderdate) AS VARCHAR) AS p_time, o_orderkey FROM orders""")
def coalesced_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a year as one partition: ids from 1 by segment name, then key, without gaps."""
    rows = partitioned_orders(spark, sf_dir).select("o_orderkey", "p_time", "p_segment")
    return build.numbered_in_partitions(rows, ["p_time"], ["p_segment", "o_orderkey"]).select("id", "p_time", "o_orderkey")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM orders)""")
def written_and_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned write, and one partition read back by its directories."""
    path = scratch.folder(spark, "build")
    rows = partitioned_orders(spark, sf_dir)
    build.write_partitions(rows, path)
    first = table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")).cast("string")).first()[0]
    return build.read_partitions(spark, path, time=first, segment=build.ANY).select("o_orderkey", "o_orderstatus")


@query("""SELECT 'orders-' || o_orderstatus AS partition, CAST(count(*) AS BIGINT) AS rows, min(o_orderkey) AS min_id, max(o_orderkey) AS max_id FROM orders GROUP BY 1""")
def finalized_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and id bounds of each partition."""
    made = build.finalized(build.with_partition(table(spark, sf_dir, "orders"), "orders", segment=F.col("o_orderstatus")), "o_orderkey")
    return made.select("partition", "rows", "min_id", "max_id")


@query("""SELECT o_orderkey, '007' AS p_segment FROM orders WHERE o_orderstatus = 'F'""")
def looked_up_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that look like numbers are found, and come back, as the texts they are."""
    path = scratch.folder(spark, "texts")
    segment = F.when(F.col("o_orderstatus") == "F", "007").otherwise("08")
    build.write_partitions(build.with_partition(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "orders", segment=segment), path)
    return build.read_partitions(spark, path, segment="007").select("o_orderkey", "p_segment")


@query("""SELECT 'orders-' || o_orderstatus AS partition, CAST(count(*) AS BIGINT) AS rows, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years,
  CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN CAST(min(year(o_orderdate)) AS VARCHAR) ELSE min(year(o_orderdate)) || ' to ' || max(year(o_orderdate)) END || ' ' || count(*) || ' Rows.' AS title,
  CAST(count(o_totalprice) AS BIGINT) AS prices, round(avg(o_totalprice), 6) AS mean, round(min(o_totalprice), 6) AS least FROM orders GROUP BY o_orderstatus""")
def finalized_with_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What finalising a build tells of each partition: rows, time covered, title, and the statistics of a column."""
    rows = build.with_partition(table(spark, sf_dir, "orders"), "orders", segment=F.col("o_orderstatus"))
    held = build.finalized(rows, "o_orderkey", years=["o_orderdate"])
    told = build.finalized_statistics(rows, ["o_totalprice"]).select("partition", F.col("count").alias("prices"), rounded("mean").alias("mean"), rounded("min").alias("least"))
    return held.join(told, "partition").select("partition", "rows", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "title", "prices", "mean", "least")


AFTER_SQL = """WITH t AS (SELECT o_totalprice AS x, o_orderpriority FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 3 = 0), n AS (SELECT count(*) AS n FROM t)
SELECT 'o_totalprice' AS "column", CAST(count(x) AS BIGINT) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max, round(skewness(x) * (count(x) - 2) / sqrt(count(x) * (count(x) - 1.0)), 4) AS skewness, round(kurtosis_pop(x), 4) AS kurtosis, TRUE AS near_distinct, TRUE AS near_median FROM t
UNION ALL SELECT 'o_orderpriority', CAST(count(o_orderpriority) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, TRUE, TRUE FROM t"""


@query(AFTER_SQL)
def statistics_after_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of a table, merged from those stored with its partitions after one of them was written anew: no other is read.

    Counts and moments are those of SQL; the sketches are held against exact figures with their bounds.
    """
    path, columns = scratch.folder(spark, "statistics"), ["o_totalprice", "o_orderpriority"]
    orders = build.with_partition(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", *columns), "orders", segment=F.col("o_orderstatus"))
    build.store_statistics(orders, path, columns)
    build.store_statistics(orders.filter("o_orderstatus = 'F' and o_orderkey % 3 = 0"), path, columns)
    made = build.stored_statistics(spark, path)
    now = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F' or o_orderkey % 3 = 0")
    below = F.avg((F.col("o_totalprice") <= F.col("p50")).cast("double"))
    [median] = made.filter(F.col("column") == "o_totalprice").select("p50").collect()
    rank, prices, priorities = now.withColumn("p50", F.lit(median.p50)).agg(below, F.count_distinct("o_totalprice"), F.count_distinct("o_orderpriority")).first()
    exact = F.when(F.col("column") == "o_totalprice", F.lit(prices)).otherwise(F.lit(priorities))
    return made.select(
        "column", "count", *[rounded(c, 4).alias(c) for c in ("mean", "std", "min", "max", "skewness", "kurtosis")], (F.abs(F.col("nuniques") - exact) <= 0.07 * exact).alias("near_distinct"),
        (F.col("p50").isNull() | F.lit(abs(rank - 0.5) <= 0.03)).alias("near_median"),
    )


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, CAST(count(*) AS BIGINT) AS rows FROM events GROUP BY 1, 2""")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed counts of the stream job, over the table."""
    made = windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")
    return made.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "rows")
