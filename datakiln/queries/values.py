"""Semantic values: years, intervals, shares, errors, ages, codes and geography, on texts made from the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.functions import values as v
from datakiln.queries.registry import Query, registrar, rounded, table

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = registrar(QUERIES)


@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, CAST(o_orderkey % 5 AS INTEGER) AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 0 THEN y END AS start, CASE WHEN k < 4 THEN CAST(y AS VARCHAR) || '/' || CAST(CASE WHEN k = 0 THEN y + 1 ELSE y + k END AS VARCHAR) END AS range FROM o""")
def years_and_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single years and ranges in each form; the rest fails to null."""
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.concat(F.lit(" "), y)).when(k == 1, F.concat_ws("-", y, y + 1)).when(k == 2, F.concat_ws("--", y, y + 2)).when(k == 3, F.concat_ws("/", y, y + 3)).otherwise(F.concat(y, F.lit(" or so")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", v.year_start(F.col("t")).alias("start"), v.range_text(F.col("t")).alias("range"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 5 AS INTEGER) AS k FROM orders),
i AS (SELECT *, CASE k WHEN 0 THEN make_date(year(d), 1, 1) WHEN 1 THEN d WHEN 2 THEN d WHEN 3 THEN CAST(d - INTERVAL 14 MONTH AS DATE) END AS a,
  CASE k WHEN 0 THEN make_date(year(d) + 1, 1, 1) WHEN 1 THEN CAST(d + INTERVAL 400 DAY AS DATE) WHEN 2 THEN CAST(CAST(d + INTERVAL 24 MONTH AS DATE) + INTERVAL 3 DAY AS DATE) WHEN 3 THEN d END AS b FROM o)
SELECT o_orderkey, CAST(a AS VARCHAR) || '/' || CAST(b AS VARCHAR) AS interval, array_to_string(CASE WHEN k < 4 THEN range(year(a), year(CASE WHEN k = 1 THEN b ELSE CAST(b - INTERVAL 1 DAY AS DATE) END) + 1) END, ',') AS years FROM i""")
def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO intervals in each form and the years they cover."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.year(d).cast("string")).when(k == 1, F.concat_ws("/", d, F.date_add(d, 400))).when(k == 2, F.concat_ws("E", d, F.lit("P2Y3D"))).when(k == 3, F.concat_ws("/", F.lit("P1Y2M"), d)).otherwise("some day")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    years = F.array_join(v.expand_to_years(F.col("t")).cast("array<string>"), ",")
    return rows.select("o_orderkey", v.interval_text(F.col("t")).alias("interval"), years.alias("years"))


@query("""SELECT o_orderpriority, CAST(min(year(o_orderdate)) AS VARCHAR) || '/' || CAST(max(year(o_orderdate)) AS VARCHAR) AS compressed,
  CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN CAST(min(year(o_orderdate)) AS VARCHAR) ELSE CAST(min(year(o_orderdate)) AS VARCHAR) || ' to ' || CAST(max(year(o_orderdate)) AS VARCHAR) END || ' ' || CAST(count(*) AS VARCHAR) || ' Rows.' AS description FROM orders GROUP BY 1""")
def time_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datakiln.operators.coverage import short_description

    grouped = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.collect_set(F.year("o_orderdate")).alias("years"), F.count("*").alias("rows"))
    return grouped.select("o_orderpriority", v.compress_years(F.col("years")).alias("compressed"), short_description(F.col("years"), F.col("rows")).alias("description"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_discount, CAST(round(l_tax * 100) AS BIGINT) AS tax, l_linenumber % 2 AS odd FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN odd = 0 THEN round(l_discount, 6) END AS share, CASE WHEN odd = 0 THEN round(l_discount * 100, 6) END AS of_hundred, CAST(tax AS DOUBLE) AS percent, round(tax / 100.0, 6) AS rate FROM l""")
def shares_and_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proportions above one fail; percent signs go."""
    c = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).otherwise(F.col("l_discount") + 1.5).cast("string")
    p = F.concat(F.round(F.col("l_tax") * 100).cast("bigint").cast("string"), F.lit("%"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rounded(v.share(c)).alias("share"), rounded(v.share_percent(c)).alias("of_hundred"), v.percent(p).alias("percent"), rounded(v.percent_rate(p)).alias("rate"))


@query("""SELECT p_partkey, round(p_size / 1.645, 6) AS se, round(p_size / 1.645 * 1.96, 6) AS m95, round(p_size / 1.645 * 2.575, 6) AS m99, round(p_retailprice - p_size / 1.645 * 1.96, 6) AS lower, round(p_retailprice + p_size / 1.645 * 1.96, 6) AS upper,
  round(p_size / 1.645 / nullif(p_size - 10, 0), 6) AS relative FROM part""")
def errors_and_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of error, standard errors and confidence intervals."""
    se = v.margin_to_se(F.col("p_size"), 90)
    interval = v.confidence(F.col("p_retailprice"), se, 95)
    return table(spark, sf_dir, "part").select(
        "p_partkey", rounded(se).alias("se"), rounded(v.convert_margin(F.col("p_size"), 90, 95)).alias("m95"), rounded(v.se_to_margin(se, 99)).alias("m99"), rounded(interval["lower"]).alias("lower"), rounded(interval["upper"]).alias("upper"),
        rounded(v.relative_error(se, F.col("p_size") - 10)).alias("relative"),
    )


@query("""WITH p AS (SELECT p_partkey, p_size AS n, p_partkey % 6 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN printf('%02d-%02d', 0, n) WHEN 1 THEN printf('%02d-%02d', n, 120) WHEN 2 THEN printf('%02d-%02d', n, n + 5) WHEN 3 THEN printf('%02d-%02d', n, n + 2) WHEN 4 THEN printf('%02d-%02d', n, n) END AS ages,
  CASE WHEN k = 5 THEN n END AS low FROM p""")
def age_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age groups in words and as ranges."""
    n, k = F.col("p_size"), F.col("p_partkey") % 6
    words = F.when(k == 0, F.format_string("Under %d years", n)).when(k == 1, F.format_string("%d years and over", n)).when(k == 2, F.format_string("%d to %d years", n, n + 4)).when(k == 3, F.format_string("%d and %d years", n, n + 1)).when(k == 4, F.format_string("%d years", n)).otherwise(F.format_string("%d-%d", n, n + 9))
    rows = table(spark, sf_dir, "part").select("p_partkey", words.alias("t"))
    return rows.select("p_partkey", v.age_text(v.census_age(F.col("t"))).alias("ages"), v.age_range(F.col("t"))["low"].alias("low"))


@query("""SELECT p_partkey, CASE WHEN p_size % 11 BETWEEN 1 AND 9 THEN CAST(p_size % 11 AS INTEGER) END AS number,
  [NULL, 'aian', 'asian', 'black', 'hisp', 'nhopi', 'white', 'other', 'multiple', 'all', NULL][CAST(p_size % 11 + 1 AS INTEGER)] AS name FROM part""")
def race_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator numbers to own numbers and names."""
    number = v.race_number((F.col("p_size") % 11).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", number.alias("number"), v.race_name(number).alias("name"))


D62 = v.DIGITS62


@query(f"""WITH s AS (SELECT s_suppkey, CAST(s_nationkey + 1 AS INTEGER) AS state, CAST(s_suppkey % 300 + 1 AS INTEGER) AS county, CAST(s_suppkey * 7 % 1000000 AS INTEGER) AS tract FROM supplier)
SELECT s_suppkey, state, county, tract, printf('%04d', tract // 100) || '.' || printf('%02d', tract % 100) AS dotted, printf('05000US%02d%03d', state, county) AS long_form,
  '0O' || substr('{D62}', state // 62 + 1, 1) || substr('{D62}', state % 62 + 1, 1) || substr('{D62}', county // 62 + 1, 1) || substr('{D62}', county % 62 + 1, 1) AS gvid, '0OZZZZ' AS grain FROM s""")
def geo_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census codes cut into parts, dotted tracts, county ids in two forms, and the summary grain."""
    state, county, tract = F.col("s_nationkey") + 1, (F.col("s_suppkey") % 300 + 1).cast("int"), (F.col("s_suppkey") * 7 % 1000000).cast("int")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.format_string("%02d%03d%06d", state.cast("int"), county, tract).alias("code"))
    parts = v.geo_parts(F.col("code"))
    own = v.gvid(parts["state"], parts["county"])
    return rows.select(
        "s_suppkey", parts["state"].alias("state"), parts["county"].alias("county"), parts["tract"].alias("tract"), v.tract_dotted(parts["tract"]).alias("dotted"), v.county_long(parts["state"], parts["county"]).alias("long_form"),
        own.alias("gvid"), v.summary_grain(own).alias("grain"),
    )


@query("""SELECT n_nationkey, n_name || ' County' AS name, n_name AS short, 'county' AS division, 'Region ' || CAST(n_regionkey AS VARCHAR) AS state, string_agg(DISTINCT k, ' ' ORDER BY k) AS keywords FROM nation,
  LATERAL (SELECT unnest([lower(n_name), lower(n_name) || '.example', lower(n_name) || '.example.com', 'example.com', 'com']) AS k) GROUP BY ALL""")
def names_and_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of county names, and all leading and trailing parts of a dotted source name."""
    named = F.concat("n_name", F.lit(" County, Region "), F.col("n_regionkey").cast("string"))
    parts = v.county_name_parts(named)
    words = v.source_keywords(F.concat(F.lower("n_name"), F.lit(".example.com")))
    return table(spark, sf_dir, "nation").select("n_nationkey", *[parts[p].alias(p) for p in ("name", "short", "division", "state")], F.array_join(words, " ").alias("keywords"))
