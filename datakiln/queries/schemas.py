"""Names, merged and declared schemas, staged transforms, guarded casts and dimension rules over the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datakiln.functions import casts, valuetypes
from datakiln.jobs import build, scratch
from datakiln.operators import cubes, headers, infer, transforms
from datakiln.queries.registry import Query, registrar, rounded, table

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = registrar(QUERIES)


@query("""SELECT c_custkey AS "key", c_name AS nave_name FROM customer""")
def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names by position, in ASCII; columns of a blank name dropped, of the others those of a layout kept."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    named = headers.renamed_by_position(rows, [headers.ascii_name(n) for n in ("key", "naïve_name", " ", "segment")])
    layout = T.StructType([T.StructField("nave_name", T.StringType()), T.StructField("key", T.LongType())])
    return headers.only_laid_out(headers.without_blank_names(named), layout)


@query("""SELECT 'customers' AS kind, CAST(count(*) AS BIGINT) AS rows, round(sum(floor(c_acctbal)), 2) AS balance, CAST(count(*) FILTER (c_custkey % 50 = 0) AS BIGINT) AS codes, CAST(0 AS BIGINT) AS errors, CAST(count(*) * (count(*) + 1) / 2 AS BIGINT) AS ids, 'bigint,bigint,double,bigint,string' AS types FROM customer
UNION ALL SELECT 'suppliers', CAST(count(*) AS BIGINT), round(sum(s_acctbal), 2), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(count(*) * (count(*) + 1) / 2 AS BIGINT), 'bigint,bigint,double,bigint,string' FROM supplier""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two text sources cast to one table whose types are inferred from both, promoted where they differ, codes beside values, rows numbered in the first column."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(key.cast("string").alias("key"), F.floor("c_acctbal").cast("string").alias("balance"), F.when(key % 50 == 0, "*").otherwise(key.cast("string")).alias("coded"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_acctbal").cast("string").alias("balance"))
    sources = {"customers": customers, "suppliers": suppliers}
    made = headers.merged("people", [infer.inferred(df) for df in sources.values()])
    types = ",".join(f.dataType.simpleString() for f in made.schema())
    parts = [transforms.cast_columns(df, made).withColumn("kind", F.lit(kind)) for kind, df in sources.items()]
    held = parts[0].unionByName(parts[1]).groupBy("kind")
    return held.agg(F.count("*").alias("rows"), rounded(F.sum("balance"), 2).alias("balance"), F.count("coded_code").alias("codes"), F.sum(F.size("_errors")).alias("errors"), F.sum("id").alias("ids")).withColumn("types", F.lit(types))


@query("""SELECT CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS id, CAST(c_custkey AS BIGINT) AS number, c_name AS title, round(c_acctbal, 2) AS balance, '2:c_name>title,3:c_acctbal>balance' AS changes FROM customer""")
def table_of_a_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table declared by a frame's types, its source headed by the table's names less the key, the differing names listed, rows numbered in the key."""
    frame = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number"), "c_name", "c_acctbal")
    made = headers.table_of_frame(frame.toDF("number", "title", "balance"), "people")
    source = headers.headed_by(frame.select(*[F.col(c).cast("string") for c in frame.columns]), made)
    listed = headers.column_changes({"customers": (frame.columns, made)}, spark)
    pairs = F.array_sort(F.collect_list(F.concat(F.col("position").cast("string"), F.lit(":"), "source_column", F.lit(">"), "column")))
    changes = listed.agg(F.array_join(pairs, ",").alias("changes")).first().changes  # one row for each column
    rows = transforms.checked(transforms.cast_columns(source.withColumn("nr", F.col("number").cast("long")), made, order=["nr"]))
    return rows.withColumn("balance", rounded("balance", 2)).withColumn("changes", F.lit(changes))


@query("""SELECT c_mktsegment AS segment, round(avg(c_acctbal), 4) AS balance, round(avg(c_acctbal / 10), 4) AS balance_se, CAST(count(*) AS BIGINT) AS count FROM customer GROUP BY 1""")
def declared_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema exported as CSV and declared from it again; its roles name the dimensions, the measure and what hangs on it."""
    c = headers.ColumnSpec
    specs = [c(1, "id", "int", role="k"), c(2, "segment", "str", "dimension", "d"), c(3, "balance", "float", "measure", "m", description="what is held"), c(4, "balance_se", "float", "se", "e", "balance", transform="^{cast(balance as double) / 10}")]
    path = scratch.folder(spark, "schema")
    build.extract(headers.schema_rows(spark, [headers.TableSpec("people", {s.name: s for s in specs})]), path)
    people = headers.declared_schema(spark, path)["people"]
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("string").alias("balance"))
    cast = transforms.cast_columns(raw, people)
    dimensions, [measure] = headers.by_role(cast.schema, "d"), headers.by_role(cast.schema, "m")
    [error] = headers.children(cast.schema, measure)
    both = cubes.measure_by(cast, measure, dimensions).join(cubes.measure_by(cast, error, dimensions).drop("count"), dimensions)
    return both.select(*dimensions, rounded(measure, 4).alias(measure), rounded(error, 4).alias(error), "count")


@query("""SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS line, o_orderkey AS "key", CASE WHEN o_orderstatus = 'P' THEN -0.5 ELSE o_totalprice / 2 END AS price, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
  'shop/orders' AS origin, CAST(NULL AS VARCHAR) AS absent, CAST(7 AS BIGINT) AS slot FROM orders""")
def staged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers, a handler for what does not cast, a later stage, parts of another column, arguments of the run, a column that the source lacks."""
    c = headers.ColumnSpec
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("nr"), F.col("o_orderkey").cast("string").alias("key"), F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )
    specs = [
        c(1, "line", "int", transform="^row_number"), c(2, "key", "int"), c(3, "price", "float", transform="!minus_one;halved"), c(4, "day", "date"), c(5, "year", "int", transform=";row.day.year"), c(6, "month", "int", transform=";row.day.month"),
        c(7, "origin", "str", transform="^origin"), c(8, "absent", "str"), c(9, "slot", "int", transform="^slot"),
    ]
    functions = {"minus_one": lambda: F.lit(-1.0), "halved": lambda v: v / 2, "origin": lambda source, bundle: F.lit(f"{bundle}/{source}"), "slot": lambda i_d: F.lit(i_d - 1)}
    made = transforms.cast_columns(raw, headers.TableSpec("orders", {s.name: s for s in specs}), functions, order=["nr"], source="orders", bundle="shop")
    return transforms.checked(made).drop("day")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber % 5 AS k, CAST(l_quantity AS BIGINT) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN n + CAST(0.5 AS DOUBLE) END AS number, CASE WHEN k = 0 THEN n + CAST(0.5 AS DOUBLE) WHEN k IN (2, 3) THEN -1 END AS defaulted, CASE WHEN k = 0 THEN n + CAST(0.5 AS DOUBLE) END AS finite, CASE WHEN k = 0 THEN n + CAST(0.5 AS DOUBLE) END AS no_nan,
  CASE k WHEN 0 THEN CAST(n AS VARCHAR) || '.5' WHEN 1 THEN 'nan' WHEN 3 THEN 'junk' WHEN 4 THEN 'inf' END AS text, CASE WHEN k = 0 THEN n END AS cut, CAST(n AS DOUBLE) AS percentile, -n / CAST(2 AS DOUBLE) AS latitude FROM t""")
def guarded_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults, what is no number, no value or not finite, and values of types that are floats in text."""
    k, n = F.col("l_linenumber") % 5, F.col("l_quantity").cast("bigint")
    t = F.when(k == 0, F.concat(F.lit(" "), n.cast("string"), F.lit(".5\t"))).when(k == 1, " nan").when(k == 2, " \n ").when(k == 3, "junk").otherwise("inf")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t"), n.alias("n"))
    c, plain = F.col("t"), ~k.isin(1, 4)
    return rows.select(
        "l_orderkey", "l_linenumber", F.when(plain, casts.parse_float(c)).alias("number"), F.when(plain, casts.float_or(c, -1.0)).alias("defaulted"), casts.finite(casts.to_float(c)).alias("finite"), F.when(k != 4, casts.nan_is_null(casts.to_float(c))).alias("no_nan"),
        casts.parse_text(c).alias("text"), casts.first_that_works(casts.to_int(c), casts.int_cut(c)).alias("cut"), valuetypes.resolved("pctl").cast(F.concat(F.col("n").cast("string"), F.lit("%"))).alias("percentile"),
        valuetypes.resolved("lat").cast((-F.col("n") / 2).cast("string")).alias("latitude"),
    )


@query("""WITH o AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS price FROM orders)
SELECT CASE grouping(priority, status, year) WHEN 3 THEN 'priority' WHEN 5 THEN 'status' WHEN 6 THEN 'year' WHEN 1 THEN 'priority,status' WHEN 2 THEN 'priority,year' ELSE 'status,year' END AS "set", priority, status, year, round(avg(price), 4) AS price, CAST(count(*) AS BIGINT) AS count
FROM o GROUP BY GROUPING SETS ((priority), (status), (year), (priority, status), (priority, year), (status, year))""")
def sets_of_primary_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets that the rules for dimensions allow, of the declared dimensions with more than one value, and the measure by each."""
    role = {"role": "d"}
    named = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate"), "constant": F.lit("x")}
    df = table(spark, sf_dir, "orders").select(*[c.alias(n, metadata=role) for n, c in named.items()], F.col("o_totalprice").alias("price"))
    distinct = df.agg(*[F.count_distinct(n).alias(n) for n in named]).first().asDict()
    primary = cubes.primary_dimensions(df.schema, distinct)
    sets = cubes.dimension_sets({d: distinct[d] for d in primary}, time={"year"})
    for s in sets:
        cubes.check_axes(primary, dict.fromkeys(s["filters"]), list(s["axes"]))
    made = cubes.all_sets(df, "price", [tuple(sorted(s["axes"])) for s in sets])
    return made.select("set", "priority", "status", "year", rounded("price", 4).alias("price"), "count")
