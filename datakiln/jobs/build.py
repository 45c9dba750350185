"""Partitioned builds: choosing partitions, writing, coalescing segments, looking up, extracting."""

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datakiln.functions import values
from datakiln.functions.values import name_from_parts
from datakiln.jobs import scratch
from datakiln.operators import coverage, stats
from datakiln.operators.headers import unused
from datakiln.operators.row_index import with_row_number

#: The parts of a partition's name, in order; also its directory levels.
PARTS = ("time", "space", "grain", "variant", "segment")
#: Rows of one output file at most.
ROWS_A_FILE = 2_000_000
#: Bytes of a partition's rows that one task sorts and writes, about; several slices may meet in a task.
TASK_BYTES = 64 << 20
ANY = object()


def with_partition(df: DataFrame, table: str, **parts: Column | str) -> DataFrame:
    """``df`` with its partition columns and their joined name; parts left out are blank."""
    made = {p: (F.lit(parts[p]) if isinstance(parts.get(p), str) else parts[p].cast("string")) if p in parts else F.lit("") for p in PARTS}
    marked = df.withColumns({f"p_{p}": F.coalesce(c, F.lit("")) for p, c in made.items()})
    return marked.withColumn("partition", name_from_parts(F.lit(table), *[F.col(f"p_{p}") for p in PARTS]))


def source_partition(df: DataFrame, covers: DataFrame, table: str, segmented: bool = True) -> DataFrame:
    """Partitions from what the source of each row covers; ``covers`` has one small row for each source."""
    names = {p: unused(f"_{p}", df.columns) for p in ("time", "space", "grain", "segment")}
    joined = df.join(covers.select("_source", *[F.col(p).alias(n) for p, n in names.items()]), "_source", "left")
    parts = {p: F.col(n) for p, n in names.items() if p != "segment" or segmented}
    return with_partition(joined, table, **parts).drop(*names.values())


def directory(part: Column) -> Column:
    """A part as the name of a directory: a stroke for a blank one, and one more in front of what starts with a stroke."""
    return F.when(F.coalesce(part, F.lit("")) == "", "-").when(part.startswith("-"), F.concat(F.lit("-"), part)).otherwise(part)


def part_of(name: Column) -> Column:
    """The reverse of `directory`."""
    return F.when(name.startswith("-"), F.substring(name, 2, 1 << 30)).otherwise(name)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory: its texts, lists as text, and 16 for each column."""
    long = [f.name for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    nested = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    each = [F.octet_length(quoted(c)) for c in long] + [F.octet_length(F.to_json(F.struct(quoted(c)))) for c in nested]
    return sum((F.coalesce(x, F.lit(0)).cast("long") for x in each), F.lit(16 * len(df.columns)).cast("long"))


def write_partitions(df: DataFrame, path: str, overwrite: bool = True, rows_a_file: int = ROWS_A_FILE, task_bytes: int = TASK_BYTES) -> None:
    """Rows into partition directories; only the partitions that ``df`` has are overwritten.

    A task sorts its rows by partition.  Shuffled bytes do not tell how many rows those are,
    as equal texts are compressed away, so the bytes of each partition are summed first, and
    a partition of more than ``task_bytes`` is dealt over several tasks by a hash of its rows.
    """
    levels = [f"p_{p}" for p in PARTS]
    blank_safe = df.withColumns({c: directory(F.col(c)) for c in levels})
    held, slices, nth = (unused(n, blank_safe.columns) for n in ("_bytes", "_slices", "_nth"))
    sizes = scratch.save(blank_safe.select(*levels, row_bytes(blank_safe).alias(held)).groupBy(*levels).agg(F.sum(held).alias(held)), "partition_sizes")
    tasks = df.sparkSession.sparkContext.defaultParallelism + 2 * (sizes.agg(F.sum(held)).first()[0] or 0) // task_bytes
    # as many rows as all bytes hold task_bytes, at most
    large = sizes.filter(F.col(held) > task_bytes).select(*levels, F.ceil(F.col(held) / task_bytes).alias(slices))
    hashed = F.xxhash64(*[quoted(f.name) for f in blank_safe.schema if "map<" not in f.dataType.simpleString()])
    dealt = blank_safe.join(F.broadcast(large), levels, "left").withColumn(nth, F.pmod(hashed, F.coalesce(slices, F.lit(1))))
    mode = "overwrite" if overwrite else "append"
    writer = dealt.repartition(tasks, *levels, nth).select(*map(quoted, blank_safe.columns)).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.option("maxRecordsPerFile", rows_a_file).partitionBy(*levels).parquet(path)


def read_partitions(spark: SparkSession, path: str, **wanted: object) -> DataFrame:
    """Rows of the partitions that match: a text for a part, or ANY; filters prune directories.

    Parts are read as the texts that were written, so a segment 007 stays 007 and a blank one blank.
    """
    levels = {f"p_{p}" for p in PARTS}
    found = spark.read.option("basePath", path).parquet(path).schema
    texts = T.StructType([T.StructField(f.name, T.StringType()) if f.name in levels else f for f in found])
    rows = spark.read.option("basePath", path).schema(texts).parquet(path)
    for part, value in wanted.items():
        if part not in PARTS:
            raise KeyError(f"no partition part {part!r}")
        if value is not ANY:
            rows = rows.filter(F.col(f"p_{part}") == directory(F.lit(value)))
    return rows.withColumns({level: part_of(F.col(level)) for level in levels})


def coalesce_segments(df: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """Segments as one partition: rows by segment name (byte order), then in order, with ids from 1 without gaps."""
    return with_row_number(df, ["p_segment", *order], key).withColumn("p_segment", F.lit(""))


def numbered_in_partitions(df: DataFrame, keys: list[str], order: list[str], key: str = "id") -> DataFrame:
    """Ids from 1 in each partition, without a window over a whole partition.

    Global numbers along (keys, order), less the least number of the partition.
    """
    n, first = unused("_n", df.columns), unused("_first", df.columns)
    numbered = with_row_number(df, [*keys, *order], n, 0)
    names = {k: unused(f"_k_{k}", [*df.columns, n, first]) for k in keys}
    least = numbered.groupBy(*keys).agg(F.min(n).alias(first)).select(*[F.col(k).alias(names[k]) for k in keys], first)
    joined = numbered.join(least, reduce(and_, [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]))
    return joined.select((F.col(n) - F.col(first) + 1).alias(key), *[c for c in df.columns if c != key])


def finalized(df: DataFrame, key: str = "id", years: list[str] = (), gvid: str | None = None) -> DataFrame:
    """(partition, rows, min_id, max_id, years, places, grains, title) of each partition.

    ``years`` names year and date columns, ``gvid`` a column of places; what is not asked
    for is an empty list.  The title is the time covered and the number of rows.
    """
    none = {"years": F.array().cast("array<int>"), "places": F.array().cast("array<string>"), "grains": F.array().cast("array<string>")}
    kinds = dict(df.dtypes)
    listed = {"years": F.array_sort(F.array_distinct(F.flatten(F.array(*[F.collect_set(coverage.year_of(F.col(c), kinds[c])) for c in years])))) if years else none["years"]}
    listed["places"] = F.array_sort(F.collect_set(coverage.place_of(F.col(gvid)))) if gvid else none["places"]
    listed["grains"] = F.array_sort(F.collect_set(values.summary_grain(F.col(gvid)))) if gvid else none["grains"]
    # one scan; the lists hold a partition's years, places and levels, which are what is asked for
    held = df.groupBy("partition").agg(F.count("*").alias("rows"), F.min(key).alias("min_id"), F.max(key).alias("max_id"), *[c.alias(n) for n, c in listed.items()])
    return held.withColumn("title", coverage.short_description(F.col("years"), F.col("rows")))


def store_statistics(df: DataFrame, path: str, columns: list[str]) -> None:
    """The mergeable statistics of the partitions that ``df`` has, beside those of others that are there."""
    made = stats.partial_stats(df.select("partition", *columns), ["partition"])
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition").parquet(path)


def stored_statistics(spark: SparkSession, path: str, by_partition: bool = False) -> DataFrame:
    """The statistics of a table (or of each partition) from what was stored, without its rows."""
    held = spark.read.schema(f"column string, {stats.PARTIAL}, partition string").parquet(path)
    return stats.merged_stats(held, ["partition"] if by_partition else [])


def finalized_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(partition, column, count, nuniques, …): the statistics of the columns of each partition, in one pass."""
    return stats.column_stats(df.select("partition", *columns), ["partition"])


def extract(df: DataFrame, path: str, limit: int | None = None, order: list[str] | None = None) -> None:
    """A partition as CSV with a header; the first rows in a stated order where there is a limit."""
    rows = df if limit is None else df.orderBy(*(order or df.columns[:1])).limit(limit)
    rows.write.mode("overwrite").option("header", True).csv(path)


def failed_checks(df: DataFrame, columns: list[str] | None = None, rows: int | None = None, sums: dict[str, float] | None = None, rules: dict[str, Column] | None = None) -> DataFrame:
    """(check, expected, found) of the checks that do not hold; empty if all do. One pass over the rows."""
    spark = df.sparkSession
    made = [F.count("*").alias("rows")] + [F.sum(c).cast("double").alias(f"sum:{c}") for c in sums or {}] + [F.count_if(~F.coalesce(test, F.lit(False))).alias(f"rule:{n}") for n, test in (rules or {}).items()]
    seen = df.agg(*made).first()
    wanted: list[tuple[str, str, str]] = []
    if columns is not None and columns != df.columns:
        wanted.append(("columns", ",".join(columns), ",".join(df.columns)))
    if rows is not None and seen["rows"] != rows:
        wanted.append(("rows", str(rows), str(seen["rows"])))
    for c, total in (sums or {}).items():
        if seen[f"sum:{c}"] is None or abs(seen[f"sum:{c}"] - total) > 1e-6 * max(1.0, abs(total)):
            wanted.append((f"sum:{c}", str(float(total)), str(seen[f"sum:{c}"])))
    for n in rules or {}:
        if seen[f"rule:{n}"]:
            wanted.append((f"rule:{n}", "0", str(seen[f"rule:{n}"])))
    return spark.createDataFrame(wanted, T.StructType([T.StructField(n, T.StringType()) for n in ("check", "expected", "found")]))


def in_stages(spark: SparkSession, stages: list[list[str]], build: Callable[[SparkSession, str], None]) -> None:
    """Each stage's builds before the next, as later stages read what earlier ones wrote."""
    for stage in stages:
        for name in stage:
            build(spark, name)
