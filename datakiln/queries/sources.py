"""Sources: text files written from the tables and read back as any messy source would be."""

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.functions import casts
from datakiln.jobs import build, scratch, search
from datakiln.operators import headers
from datakiln.queries.registry import Query, registrar, table
from datakiln.sources import readers, runs

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = registrar(QUERIES)


@query("""SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer""")
def delimited_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files with a header, all columns as text, cast to a declared schema."""
    path = scratch.folder(spark, "csv")
    build.extract(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), path)
    rows = readers.read(spark, readers.SourceSpec("customer", path))
    c = F.col
    return rows.select(casts.to_int(c("c_custkey")).alias("c_custkey"), casts.to_text(c("c_name")).alias("c_name"), F.round(casts.to_float(c("c_acctbal")), 2).alias("c_acctbal"), casts.to_int(c("c_nationkey")).alias("c_nationkey"))


@query("""SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size FROM part""")
def fixed_width_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of fixed widths, blanks as nulls."""
    path = scratch.folder(spark, "fixed")
    line = F.concat(F.lpad(F.col("p_partkey").cast("string"), 12, " "), F.rpad("p_brand", 20, " "), F.lpad(F.col("p_size").cast("string"), 6, " "))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    rows = readers.fixed_width(spark, path, [("p_partkey", 1, 12), ("p_brand", 13, 20), ("p_size", 33, 6)])
    return rows.select(casts.to_int(F.col("p_partkey")).alias("p_partkey"), "p_brand", casts.to_int(F.col("p_size")).alias("p_size"))


@query("""SELECT CASE kind WHEN 'customer' THEN 'customers' ELSE 'suppliers' END AS _source, CAST(count(*) AS BIGINT) AS rows, CAST(sum("key") AS BIGINT) AS keys FROM (
  SELECT 'customer' AS kind, c_custkey AS "key" FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) GROUP BY 1""")
def many_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sources in one run, each row with the name of its source."""
    specs = []
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        path = scratch.folder(spark, name)
        table(spark, sf_dir, name).select(F.col(key).alias("key")).write.parquet(path)
        specs.append(readers.SourceSpec(f"{name}s", path, "partition"))
    return runs.together(spark, specs).groupBy("_source").agg(F.count("*").alias("rows"), F.sum("key").alias("keys"))


@query("""SELECT CAST(r_regionkey AS VARCHAR) AS doc, r_name AS title, r_name || ' region ' || string_agg(n_name || ' nation', ' ' ORDER BY n_name || ' nation') AS text, 'geo' AS keywords FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def dataset_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a dataset from its title, summary and the names and descriptions of its columns."""
    datasets = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("title"), F.lit("region").alias("summary"), F.lit("geo").alias("keywords"))
    columns = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("dataset_id"), F.col("n_name").alias("name"), F.lit("nation").alias("description"))
    return search.dataset_documents(datasets, columns)


@query("""SELECT o_orderstatus AS doc, 'orders ' || o_orderstatus AS title, 'orders ' || o_orderstatus || ' part of orders ' || string_agg(DISTINCT o_orderpriority, ' ' ORDER BY o_orderpriority) AS text,
  string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ' ' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) || ' CA county' AS keywords FROM orders GROUP BY 1""")
def partition_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a partition from its name, its values and what it covers."""
    orders = table(spark, sf_dir, "orders")
    named = F.concat(F.lit("orders "), F.col("o_orderstatus"))
    parts = orders.groupBy("o_orderstatus").agg(F.array_sort(F.collect_set(F.year("o_orderdate"))).alias("years"))
    parts = parts.select(F.col("o_orderstatus").alias("id"), named.alias("name"), F.lit("part of orders").alias("description"), "years", F.array(F.lit("CA")).alias("places"), F.array(F.lit("county")).alias("grains"))
    values = orders.select(F.col("o_orderstatus").alias("partition_id"), F.col("o_orderpriority").alias("value")).distinct()
    return search.partition_documents(parts, values)


@query("""SELECT c_name AS name, c_nationkey AS nation, 'customers' AS kind FROM customer UNION ALL SELECT s_name, s_nationkey, 'suppliers' FROM supplier""")
def column_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two sources under the names that a column map gives them."""
    frames = {"customers": table(spark, sf_dir, "customer"), "suppliers": table(spark, sf_dir, "supplier")}
    changes = [("customers", "c_name", "name"), ("customers", "c_nationkey", "nation"), ("suppliers", "s_name", "name"), ("suppliers", "s_nationkey", "nation")]
    parts = [headers.mapped_columns(df, kind, changes).select("name", "nation", F.lit(kind).alias("kind")) for kind, df in frames.items()]
    return parts[0].unionByName(parts[1])


@query("""SELECT 'customers of ' || CAST(c_nationkey % 2 AS VARCHAR) AS _source, c_custkey, 'Zürich ' || c_name AS name FROM customer""")
def folders_of_tabbed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of tab-separated Latin-1 files, read by one scan, each row with its source."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Zürich "), "c_name").alias("name"), (F.col("c_nationkey") % 2).alias("side"))
    specs = []
    for side in (0, 1):
        path = scratch.folder(spark, f"side {side}")
        rows.filter(F.col("side") == side).drop("side").write.options(header=True, sep="\t", encoding="ISO-8859-1").csv(path)
        specs.append(readers.SourceSpec(f"customers of {side}", path, "tsv", encoding="ISO-8859-1"))
    return runs.together(spark, specs).withColumn("c_custkey", casts.to_int(F.col("c_custkey")))


#: Rows of one archive.
ROWS_AN_ARCHIVE = 1000


def put_archive(folder: str):
    """For applyInArrow: the lines of a group as an archive with a file of lines and one that is not wanted."""

    def run(rows: pa.Table) -> pa.Table:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("data/items.csv", "key,name\n" + "".join(f"{line}\n" for line in rows.column("line").to_pylist()))
            archive.writestr("about.txt", "nothing\n")
        system, root = scratch.located(folder)
        system.create_dir(root, recursive=True)
        name = f"{rows.column('nation')[0]}-{rows.column('nth')[0]}.zip"
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(held.getvalue())
        return pa.table({"name": [name]})

    return run


def archived(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """(nation, nth, line) as an archive for each nation and nth; the folder."""
    path = scratch.folder(spark, name)
    lines.groupBy("nation", "nth").applyInArrow(put_archive(path), "name string").count()
    return path


@query("""SELECT c_custkey AS "key", c_name || chr(10) || ', "x"' AS name FROM customer""")
def zipped_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of a bounded number of lines; the records of one member by name, cells in quotes that hold line breaks."""
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit('\n, ""x"""'))
    lines = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_custkey") / ROWS_AN_ARCHIVE).alias("nth"), line.alias("line"))
    rows = readers.read(spark, readers.SourceSpec("items", archived(spark, lines, "archives"), "zip", member=r"\.csv$"))
    return rows.select(casts.to_int(F.col("key")).alias("key"), "name")


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 2 THEN c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def files_of_unlike_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder whose files have their columns in other orders, and some of them fewer: each by its own header."""
    path = scratch.folder(spark, "layouts")
    orders = (("c_custkey", "c_name", "c_nationkey"), ("c_mktsegment", "c_nationkey", "c_name", "c_custkey"), ("c_name", "c_custkey"))
    for nth, names in enumerate(orders):
        table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 3 == nth).select(*names).write.mode("append").option("header", True).csv(path)
    rows = readers.read(spark, readers.SourceSpec("customers", path))
    return rows.select(casts.to_int(F.col("c_custkey")).alias("c_custkey"), "c_name", casts.to_int(F.col("c_nationkey")).cast("int").alias("c_nationkey"), "c_mktsegment")


@query("""SELECT kind, CAST(count(*) AS BIGINT) AS rows, CAST(sum("key") AS BIGINT) AS keys, round(sum(balance), 2) AS balance FROM (
  SELECT 'customers' AS kind, c_custkey AS "key", c_acctbal AS balance FROM customer UNION ALL SELECT 'suppliers', s_suppkey, s_acctbal FROM supplier UNION ALL SELECT 'nations', n_nationkey, NULL FROM nation) GROUP BY 1""")
def sources_of_unlike_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three text sources with columns in other orders in one run: one job for their headers, one scan for each distinct one."""
    columns = {"customers": ("customer", {"c_custkey": "key", "c_acctbal": "balance"}), "suppliers": ("supplier", {"s_acctbal": "balance", "s_suppkey": "key"}), "nations": ("nation", {"n_nationkey": "key"})}
    specs = []
    for name, (file, named) in columns.items():
        path = scratch.folder(spark, name)
        build.extract(table(spark, sf_dir, file).select(*[F.col(c).alias(n) for c, n in named.items()]), path)
        specs.append(readers.SourceSpec(name, path))
    rows = runs.together(spark, specs).groupBy(F.col("_source").alias("kind"))
    return rows.agg(F.count("*").alias("rows"), F.sum(casts.to_int(F.col("key"))).alias("keys"), F.round(F.sum(casts.to_float(F.col("balance"))), 2).alias("balance"))


@query("""SELECT p_partkey AS id, p_name || chr(10) || chr(10) || '"' || p_brand || '", ' || chr(10) AS note FROM part""")
def records_across_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a title, a comment and cells that hold blank lines, quotes and line breaks: lines are joined into records."""
    path = scratch.folder(spark, "records")
    note = F.concat(F.lit('"'), "p_name", F.lit('\n\n""'), "p_brand", F.lit('"", \n"'))
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), note)
    table(spark, sf_dir, "part").repartition(4, "p_partkey").select(line.alias("value")).mapInArrow(headed("The \"parts", "id,note", "# a comment with \""), "value string").write.text(path)
    rows = readers.read(spark, readers.SourceSpec("parts", path, header_lines=(1,), start_line=2, comment="#"))
    return rows.select(casts.to_int(F.col("id")).alias("id"), "note")


def headed(*lines: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines on top of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_pydict({"value": list(lines)}, batch.schema)
                first = False
            yield batch

    return run


@query("""SELECT p_partkey AS id, p_brand AS "Part brand", p_size AS "Part size" FROM part""")
def classified_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a title, two header rows, a comment and a last line that is no data."""
    path = scratch.folder(spark, "classified")
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), "p_brand", F.lit('"')), F.col("p_size").cast("string"))

    table(spark, sf_dir, "part").repartition(4, "p_partkey").select(line.alias("value")).mapInArrow(headed("The parts,,", ",Part,", "id,brand,size", "# not data"), "value string").write.text(path)
    rows = readers.read(spark, readers.SourceSpec("parts", path, header_lines=(1, 2), start_line=3, comment="#"))
    return rows.select(casts.to_int(F.col("id")).alias("id"), "Part brand", casts.to_int(F.col("Part size")).cast("int").alias("Part size"))


@query("""SELECT kind, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey AS VARCHAR) || ',P,more' ELSE 'read' END AS kept, o_orderstatus <> 'P' AS "left" FROM orders, (VALUES ('plain'), ('classified'), ('zipped')) k(kind)""")
def rows_of_the_wrong_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, classified and zipped text some of whose rows have a cell too many: kept with their text under one policy, left out under another."""
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.when(F.col("o_orderstatus") == "P", "more"))
    orders = table(spark, sf_dir, "orders")
    plain, messy = scratch.folder(spark, "plain"), scratch.folder(spark, "messy")
    lines = orders.select(line.alias("value"))
    lines.mapInArrow(headed("key,name"), "value string").write.text(plain)
    lines.mapInArrow(headed("Orders", "key,name"), "value string").write.text(messy)
    zipped = archived(spark, orders.select(F.lit(0).alias("nation"), F.floor(F.col("o_orderkey") / ROWS_AN_ARCHIVE).alias("nth"), line.alias("line")), "widths")
    s = readers.SourceSpec
    kinds = {"plain": s("o", plain), "classified": s("o", messy, header_lines=(1,), start_line=2), "zipped": s("o", zipped, "zip", member="csv$")}
    made = []
    for kind, spec in kinds.items():
        kept, left = (readers.read(spark, replace(spec, bad_rows=policy)) for policy in ("keep", "drop"))
        key = casts.to_int(F.coalesce(F.split("_corrupt", ",")[0], "key"))
        told = kept.select(F.lit(kind).alias("kind"), key.alias("o_orderkey"), F.coalesce("_corrupt", F.lit("read")).alias("kept"))
        found = left.select(casts.to_int(F.col("key")).alias("o_orderkey"), F.lit(True).alias("left"))
        made.append(told.join(found, "o_orderkey", "left").select("kind", "o_orderkey", "kept", F.coalesce("left", F.lit(False)).alias("left")))
    return made[0].union(made[1]).union(made[2])


@query("""SELECT n_name AS name, 'people' AS dest_table, CAST(n_regionkey + 1 AS INTEGER) AS stage FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def pending_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that a manifest does not have yet: here each nation is a source, and those of rich customers were read by an earlier run."""
    nations = table(spark, sf_dir, "nation")
    specs = [readers.SourceSpec(r.n_name, dest_table="people", stage=r.n_regionkey + 1) for r in nations.collect()]  # a listed source each
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9900").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return runs.pending(spark, [*specs, readers.SourceSpec("never", kind="ref")], rich.select(F.col("n_name").alias("name")))


@query("""SELECT n_name, CAST(count(*) AS BIGINT) AS rows, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def staged_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages: the second reads the partitions that the first built, found by name."""
    path = scratch.folder(spark, "stages")
    specs = [readers.SourceSpec("sums", f"{path}/customers", "partition", stage=2), readers.SourceSpec("customers", f"{sf_dir}/customer.parquet", "partition", stage=1)]
    by_name = {s.name: s for s in specs}

    def built(spark: SparkSession, name: str) -> None:
        rows = runs.together(spark, [by_name[name]])
        if name == "customers":
            rows.select("c_nationkey", "c_acctbal").write.parquet(f"{path}/customers")
        else:
            rows.groupBy("c_nationkey").agg(F.count("*").alias("rows"), F.sum("c_acctbal").alias("balance")).write.parquet(f"{path}/sums")

    build.in_stages(spark, [[s.name for s in stage] for stage in runs.by_stage(specs)], built)
    sums = spark.read.parquet(f"{path}/sums")
    joined = sums.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("n_name", "rows", F.round("balance", 2).alias("balance"))
