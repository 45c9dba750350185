"""Steps by configuration, rows by user code, kinds of sources, limited runs and partitions of sources over the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datakiln.jobs import build, scratch
from datakiln.operators import rows
from datakiln.queries.registry import Query, registrar, rounded, table
from datakiln.sources import readers, runs

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = registrar(QUERIES)


@query("""SELECT 'all' AS part, CAST(count(*) AS BIGINT) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders UNION ALL SELECT 'some', CAST(count(*) AS BIGINT), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE nullif(o_orderstatus, 'F') IS DISTINCT FROM 'P'""")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, and beside them those that match; null differs from every value."""
    orders = rows.keep_columns(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderkey"]).withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F")))
    parts = zip(("all", "some"), rows.split_matching(orders, rows.not_equal(F.col("o_orderstatus"), F.lit("P"))), strict=True)
    everything, some = (df.agg(F.lit(name).alias("part"), F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys")) for name, df in parts)
    return everything.union(some)


@query("""SELECT CAST(count(*) FILTER (value > 60) AS BIGINT) AS skipped, CAST(count(*) FILTER (NOT coalesce(value > 60, FALSE)) AS BIGINT) AS passed FROM events""")
def skipped_and_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a step skipped and passed, counted by the run that writes what passed."""
    kept, seen = rows.skip_counted(table(spark, sf_dir, "events").select("event_id", "value"), F.col("value") > 60)
    scratch.save(kept, "passed")
    return spark.createDataFrame([(seen.get["skipped"], seen.get["passed"])], "skipped long, passed long")


@query("""SELECT t AS destination, CAST(count(*) FILTER (t = 'cheap' AND o_totalprice > 200000) AS BIGINT) AS skipped, CAST(count(*) FILTER (t <> 'cheap' OR o_totalprice <= 200000) AS BIGINT) AS passed, TRUE AS rated FROM orders, (VALUES ('cheap'), ('all')) d(t) GROUP BY 1""")
def skipped_for_one_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step that skips rows of one destination table only, counted by the writes themselves, with their rate."""
    orders, found = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), []
    for name in ("cheap", "all"):
        kept, seen = rows.skip_counted(orders, F.col("o_totalprice") > 200000, f"skip {name}", table=name, only="cheap")
        run = rows.measured_run(kept, lambda df, name=name: scratch.save(df, name), f"write {name}")
        found.append((name, seen.get["skipped"], run.rows, run.rate > 0))
    return spark.createDataFrame(found, "destination string, skipped long, passed long, rated boolean")


@query("""SELECT o_orderkey, substr(o_orderpriority, instr(o_orderpriority, '-') + 1) AS priority FROM orders WHERE o_orderstatus <> 'P'""")
def rows_by_user_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as dicts through a function of the user, which may drop them."""

    def changed(row: dict) -> dict | None:
        return None if row["o_orderstatus"] == "P" else {"o_orderkey": row["o_orderkey"], "priority": row["o_orderpriority"].split("-", 1)[-1]}

    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("priority", T.StringType())])
    return rows.modify(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), changed, schema)


@query("""SELECT c_name AS name, c_acctbal * 2 AS balance, 'doubled' AS note FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_name, s_acctbal / 2, 'halved' FROM supplier""")
def configured_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of named steps, changed by what a configuration says of each source."""
    scaled = lambda by: lambda df: df.withColumn("balance", F.col("balance") * by)
    noted = lambda text: lambda df: df.withColumn("note", F.lit(text))
    phases = {"source": {"narrow": lambda df: df.select("name", "balance")}, "body": {"scale": scaled(2)}}
    changes = {"body": {"-positive": lambda df: df.filter("balance > 0"), "+note": noted("doubled")}, "body-suppliers": {"!scale": scaled(0.5), "+note": noted("halved")}}
    sources = {
        "customers": table(spark, sf_dir, "customer").withColumnsRenamed({"c_name": "name", "c_acctbal": "balance"}),
        "suppliers": table(spark, sf_dir, "supplier").withColumnsRenamed({"s_name": "name", "s_acctbal": "balance"}),
    }
    made = []
    for name, df in sources.items():
        for steps in rows.configured(phases, changes, source=name).values():
            df = rows.run_steps(df, steps)
        made.append(df)
    return made[0].unionByName(made[1])


@query("""SELECT 'people-' || CAST(2000 + n_regionkey AS VARCHAR) || '-R' || CAST(n_regionkey AS VARCHAR) || '-' || n_name AS partition, CAST(count(*) AS BIGINT) AS rows FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def partitions_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions named by what the source of each row covers: here each nation is a source."""
    nations = table(spark, sf_dir, "nation")
    region = F.col("n_regionkey").cast("string")
    covers = nations.select(F.col("n_name").alias("_source"), (F.col("n_regionkey") + 2000).cast("string").alias("time"), F.concat(F.lit("R"), region).alias("space"), F.lit("").alias("grain"), F.col("n_name").alias("segment"))
    people = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("_source"))
    return build.source_partition(people, covers, "people").groupBy("partition").agg(F.count("*").alias("rows"))


@query("""SELECT o_orderstatus AS p_segment, CAST(count(*) FILTER (o_orderstatus <> 'F' OR o_totalprice > 100000) AS BIGINT) AS rows, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS written FROM orders GROUP BY 1""")
def overwritten_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second build replaces the partition that it has rows for and no other; the first one's rows are counted as they are written."""
    path = scratch.folder(spark, "overwritten")
    orders = build.with_partition(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "orders", segment=F.col("o_orderstatus"))
    counted, seen = rows.observed(orders)
    build.write_partitions(counted, path)
    build.write_partitions(orders.filter("o_orderstatus = 'F' and o_totalprice > 100000"), path)
    held = build.read_partitions(spark, path).groupBy("p_segment").agg(F.count("*").alias("rows"))
    return held.withColumn("written", F.lit(seen.get["rows"]).cast("long"))


@query("""WITH n AS (SELECT count(*) AS n, sum(o_orderkey) AS keys FROM orders) SELECT kind, CAST(n AS BIGINT) AS rows, CAST(keys AS BIGINT) AS keys, moment, expected, TRUE AS within FROM n,
  (VALUES ('normal', 'mean', 100.0), ('normal', 'deviation', 15.0), ('normal', 'skewness', 0.0), ('exponential', 'mean', 2.0), ('exponential', 'deviation', 2.0), ('exponential', 'skewness', 2.0), ('triangular', 'mean', 4.666667), ('triangular', 'deviation', 2.054805), ('triangular', 'skewness', 0.191249)) m(kind, moment, expected)""")
def generated_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator beside the orders: as many random rows as there are orders, and three moments of each kind held against those of its distribution."""
    orders = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).first()
    columns = {"normal": readers.random_normal(100, 15, 1), "exponential": readers.random_exponential(0.5, 2), "triangular": readers.random_triangular(0, 10, 4, 3)}
    made = readers.read(spark, readers.SourceSpec("noise", "noise", "generator"), {"noise": lambda spark: readers.generated(spark, orders.n, columns)})
    measures = {"mean": F.avg, "deviation": F.stddev_samp, "skewness": F.skewness}
    expected = {"normal": (100.0, 15.0, 0.0), "exponential": (2.0, 2.0, 2.0), "triangular": (14 / 3, (38 / 9) ** 0.5, 0.191249)}
    error = 8 / max(orders.n, 1) ** 0.5  # of a moment in deviations: several times what chance allows
    each = []
    for kind, wanted in expected.items():
        for (moment, f), value in zip(measures.items(), wanted, strict=True):
            slack = error * (wanted[1] if moment != "skewness" else 3.0)
            each.append(F.struct(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.lit(orders.keys).alias("keys"), F.lit(moment).alias("moment"), F.lit(round(value, 6)).alias("expected"), (F.abs(f(kind) - value) < slack).alias("within")))
    return made.agg(F.array(*each).alias("all")).select(F.explode("all").alias("x")).select("x.*")


@query("""SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS rows, round(sum(o_totalprice * weight), 2) AS weighed FROM orders JOIN (VALUES (1, 1.5), (2, 1.25), (3, 1.0), (4, 0.75), (5, 0.5)) w(place, weight) ON CAST(substr(o_orderpriority, 1, 1) AS INTEGER) = place GROUP BY 1""")
def local_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of local rows, its columns called after their types, joined to the orders."""
    weights = readers.from_rows(spark, ((n, 1.75 - n / 4) for n in range(1, 6)))
    orders = table(spark, sf_dir, "orders").withColumn("place", F.substring("o_orderpriority", 1, 1).cast("int"))
    return orders.join(weights, F.col("place") == F.col("int")).groupBy("o_orderpriority").agg(F.count("*").alias("rows"), rounded(F.sum(F.col("o_totalprice") * F.col("float")), 2).alias("weighed"))


@query("""SELECT 'by status' AS _source, o_orderstatus, CAST(count(*) AS BIGINT) AS rows FROM orders GROUP BY 2""")
def sql_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that is a statement."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("sql_source_orders")
    spec = readers.SourceSpec("by status", "SELECT o_orderstatus, count(*) AS rows FROM sql_source_orders GROUP BY o_orderstatus", "sql")
    return runs.together(spark, [spec])


@query(f"""SELECT 'customers' AS _source, CAST(least(count(*), {runs.LIMITED_ROWS}) AS BIGINT) AS rows FROM customer UNION ALL SELECT 'suppliers', CAST(least(count(*), {runs.LIMITED_ROWS}) AS BIGINT) FROM supplier""")
def limited_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial run of the sources of one destination: a bounded number of rows of each."""
    kinds = {"customers": ("customer", "people"), "suppliers": ("supplier", "people"), "orders": ("orders", "sales")}
    specs = [readers.SourceSpec(name, f"{sf_dir}/{file}.parquet", "partition", dest_table=dest) for name, (file, dest) in kinds.items()]
    return runs.together(spark, runs.only(specs, tables={"people"}), limited=True).groupBy("_source").agg(F.count("*").alias("rows"))
