"""Which sources a run takes, in what order, and many sources as one table."""

import re
from collections.abc import Callable
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.sources.readers import SourceSpec, is_plain, plain_table, read

LIMITED_ROWS = 500
NEVER_READ = ("ref", "template")


def pending(spark: SparkSession, sources: list[SourceSpec], manifest: DataFrame, force: bool = False) -> DataFrame:
    """(name, dest_table, stage) of the sources that the manifest (name) does not have yet, or of all."""
    listed = spark.createDataFrame([(s.name, s.dest_table, s.stage) for s in sources if s.kind not in NEVER_READ], "name string, dest_table string, stage int")
    return listed if force else still_pending(listed, manifest)


def still_pending(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed sources (name, …) that the manifest (name) does not have; both may be tables of any size."""
    return listed.join(manifest.select("name").distinct(), "name", "left_anti")


def only(sources: list[SourceSpec], names: set[str] | None = None, tables: set[str] | None = None) -> list[SourceSpec]:
    """The named sources, or those of the named destination tables."""
    return [s for s in sources if (names is None or s.name in names) and (tables is None or s.dest_table in tables)]


def by_stage(sources: list[SourceSpec]) -> list[list[SourceSpec]]:
    """Sources in stages: what a stage builds, the next may read."""
    ordered = sorted(sources, key=lambda s: (s.stage, s.name))
    return [list(group) for _, group in groupby(ordered, key=lambda s: s.stage)]


def together(spark: SparkSession, sources: list[SourceSpec], limited: bool = False, reader: Callable[[SparkSession, SourceSpec], DataFrame] = read) -> DataFrame:
    """All sources by column name, missing columns null, with ``_source``.

    Plain delimited files that are read alike (kind, encoding, policy, options) take one job for
    their headers and one scan for each distinct header, not one for each source.
    """
    parts, alike = [], {}
    for s in sources:
        if limited or reader is not read or not is_plain(s):
            rows = reader(spark, s)
            parts.append((rows.limit(LIMITED_ROWS) if limited else rows).withColumn("_source", F.lit(s.name)))
        else:
            alike.setdefault((s.kind, s.encoding.upper(), s.bad_rows, tuple(sorted(s.options.items()))), []).append(s)
    parts += [one_scan(spark, group) for group in alike.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def one_scan(spark: SparkSession, sources: list[SourceSpec]) -> DataFrame:
    """Plain delimited sources that are read alike, each row with the source whose file or folder it comes from."""
    # a path without a host is written with one stroke or three
    files = [(re.sub(r"^(\w+):///", r"\1:/", file), s.name) for s in sources for file in spark.read.text(s.reference).inputFiles()]
    if len({file for file, _ in files}) < len(files):
        raise ValueError("two sources name the same file")
    rows = plain_table(spark, sources)
    named = spark.createDataFrame(files, "_named string, _source string")
    found = F.coalesce("_source", F.raise_error(F.concat(F.lit("no source names the file "), F.col("_file"))))
    return rows.join(named, F.col("_file") == F.col("_named"), "left").withColumn("_source", found).drop("_file", "_named")


def source_table(spark: SparkSession, sources: list[SourceSpec]) -> DataFrame:
    """(name, time, space, grain, segment): what each source covers, to be joined to its rows."""
    rows = [(s.name, s.dest_table, s.time, s.space, s.grain, s.segment or s.name) for s in sources]
    return spark.createDataFrame(rows, "_source string, table string, time string, space string, grain string, segment string")
