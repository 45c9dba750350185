"""Reading delimited, fixed-width and zipped text, tables, SQL, generated and local rows.

Text sources come as strings under the names of their header; casting is a later step.
Every file has its own header, and rows of another width than theirs meet the policy of the
source, whether the text is plain, classified or zipped.
"""

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from datakiln.functions.casts import nullify
from datakiln.jobs import scratch
from datakiln.operators.headers import unique_names
from datakiln.sources.records import cells_of, joined_lines, layouts_of, records

#: Lines of an archive member that travel in one batch.
LINES_A_BATCH = 5000


@dataclass(frozen=True)
class SourceSpec:
    """One input: where it is, how it is read, which rows are header and data, and what it covers."""

    name: str
    reference: str = ""
    kind: str = "csv"
    encoding: str = "UTF-8"
    header_lines: tuple[int, ...] = (0,)
    start_line: int = 1
    end_line: int | None = None
    comment: str | None = None
    widths: tuple[tuple[str, int, int], ...] = ()
    member: str = ""
    dest_table: str = ""
    stage: int = 1
    time: str = ""
    space: str = ""
    grain: str = ""
    segment: str = ""
    #: What becomes of rows of the wrong width: "fail" (an error), "keep" (with the text in ``_corrupt``) or "drop".
    bad_rows: str = "fail"
    #: More options of the reader, such as multiLine for line breaks inside quotes.
    options: dict[str, str] = field(default_factory=dict)


def delimited(spark: SparkSession, path: str | list[str], separator: str = ",", encoding: str = "UTF-8", header: bool = True, strict: bool = False, options: dict[str, str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Delimited text of one layout, all columns as strings; rows of the wrong width are an error where ``strict``, else in ``_corrupt``.

    Every row's width is checked, also where a query needs few columns.  ``names`` are those of
    the header if they are known.
    """
    reader = spark.read.options(**{"multiLine": False, "escape": '"', "columnPruning": False, **(options or {})})
    reader = reader.option("sep", separator).option("encoding", encoding).option("header", header)
    fields = [T.StructField(n, T.StringType()) for n in names] if names else list(reader.csv(path).schema)
    if strict:
        return reader.option("mode", "FAILFAST").schema(T.StructType(fields)).csv(path)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(T.StructType([*fields, T.StructField("_corrupt", T.StringType())])).csv(path)


def by_policy(spark: SparkSession, path: str | list[str], spec: SourceSpec, separator: str, names: list[str] | None = None) -> DataFrame:
    """Plain delimited files of one layout with their rows of the wrong width as the spec says."""
    if spec.bad_rows == "fail":
        return delimited(spark, path, separator, spec.encoding, strict=True, options=spec.options, names=names)
    rows = delimited(spark, path, separator, spec.encoding, options=spec.options, names=names)
    if spec.bad_rows == "keep":
        return rows
    if spec.bad_rows == "drop":
        return rows.filter("_corrupt is null").drop("_corrupt")
    raise ValueError(f"bad_rows is {spec.bad_rows!r}, not fail, keep or drop")


def path_of(uri: str) -> str:
    """The path that Spark's readers take for a file that they named: decoded, and no pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(uri))


def file_layouts(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8", separator: str = ",") -> list[tuple[list[str], list[str]]]:
    """(names, files) of each distinct header among delimited files, from one job over all of them.

    The first line of a file is the first of its first split; one line for each file is
    gathered, as Spark's own list of the files is.
    """
    text = text_lines(spark, paths, encoding).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    heads = scratch.save(text.filter("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("header")), "headers")
    known, layouts = layouts_of(heads, separator, joined=False)
    files: dict[int, list[str]] = {}
    for row in known.orderBy("file").collect():
        files.setdefault(row.layout, []).append(path_of(row.file))
    return [(layouts[nth], mine) for nth, mine in files.items()]


def plain_table(spark: SparkSession, specs: list[SourceSpec]) -> DataFrame:
    """Plain delimited sources that are read alike: one scan for each distinct header, columns by name, missing ones null, and ``_file``."""
    first = specs[0]
    separator, paths = "\t" if first.kind == "tsv" else ",", [s.reference for s in specs]
    found = file_layouts(spark, paths, first.encoding, separator)
    if not found:  # no file has a line
        return delimited(spark, paths, separator, first.encoding).withColumn("_file", F.lit(None).cast("string")).drop("_corrupt")
    parts = [by_policy(spark, files, first, separator, names).withColumn("_file", F.col("_metadata.file_path")) for names, files in found]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    last = [c for c in ("_corrupt", "_file") if c in rows.columns]
    return rows.select(*[c for c in rows.columns if c not in last], *last)


def corrupt_rows(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """The rows of a delimited source, plain, classified or zipped, that do not have their header's width, with their text in ``_corrupt``."""
    return read(spark, replace(spec, bad_rows="keep")).filter("_corrupt is not null")


def text_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The lines of text files, of any encoding that ends lines with the bytes of ASCII."""
    lines = spark.read.text(path)
    return lines if encoding.upper() in ("UTF-8", "UTF8") else lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))


def fixed_width(spark: SparkSession, path: str, widths: Iterable[tuple[str, int, int]], encoding: str = "UTF-8") -> DataFrame:
    """Lines cut at (name, start from 1, width), stripped; a missing width is an error before anything is read."""
    parts = list(widths)
    if bad := [n for n, start, width in parts if not start or not width]:
        raise ValueError(f"fixed-width columns without start or width: {', '.join(bad)}")
    return text_lines(spark, path, encoding).select(*[nullify(F.substring("value", start, width)).alias(n) for n, start, width in parts])


def zip_records(spark: SparkSession, path: str, member: str = "", encoding: str = "utf-8") -> DataFrame:
    """The records of the archives at a path; see `unpacked`."""
    return unpacked(spark.read.format("binaryFile").load(path), member, encoding)


def unpacked(files: DataFrame, member: str = "", encoding: str = "utf-8") -> DataFrame:
    """``files`` (path, content) to (archive, member, line_no, value) of the members whose name matches; archives unpack in parallel.

    An archive cannot be split, so one task streams it; lines inside quotes are joined as
    they pass, and records leave in batches of fixed size.
    """
    wanted = re.compile(member)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in sorted(n for n in archive.namelist() if not n.endswith("/") and wanted.search(n)):
                        with archive.open(name) as raw:
                            held: list[tuple[int, str]] = []
                            for row in joined_lines(line.rstrip("\n") for line in io.TextIOWrapper(raw, encoding=encoding, newline=None)):
                                held.append(row)
                                if len(held) >= LINES_A_BATCH:
                                    yield some(path_, name, held)
                                    held = []
                            yield some(path_, name, held)

    def some(archive: str, name: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_pydict({"archive": [archive] * n, "member": [name] * n, "line_no": pa.array([i for i, _ in held], pa.int64()), "value": pa.array([t for _, t in held], pa.string())})

    return files.select("path", "content").mapInArrow(unpack, "archive string, member string, line_no long, value string")


def zipped_table(found: DataFrame, spec: SourceSpec, keep: list[str] = ()) -> DataFrame:
    """Unpacked records as columns, each member by its own first line, and ``keep`` (archive, member); unpacked once."""
    keys = ["archive", "member"]
    lines = scratch.save(found, "unpacked")
    known, layouts = layouts_of(scratch.save(lines.filter("line_no = 0").select(*keys, F.col("value").alias("header")), "headers"), ",", joined=False)
    rows = lines.filter("line_no > 0").filter(F.length(F.trim("value")) > 0).join(known, keys, "left")
    return cells_of(rows, layouts, spec.bad_rows, keep=list(keep))


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, line_no, value): the lines of text files, numbered from 0 by their place in the file.

    Lines keep their order inside a split, so a number is the place in the split and the
    lines of the splits before: the file is read twice and nothing is sorted or shuffled but
    one row for each split, which is what is broadcast (8,000 for each TB).
    """
    at = F.monotonically_increasing_id().alias("_at")
    text = text_lines(spark, path, encoding).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), at)
    splits = text.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")
    known = splits.select("file", "_block", "_first", before.alias("_before"))
    return text.join(F.broadcast(known), ["file", "_block"]).select("file", (F.col("_at") - F.col("_first") + F.col("_before")).alias("line_no"), "value")


def classified(lines: DataFrame, spec: SourceSpec) -> DataFrame:
    """``lines`` (line_no, value) with row_class: header, comment, data, blank or other, from the places in the spec."""
    at = F.col("line_no")
    inside = (at >= spec.start_line) & (F.lit(True) if spec.end_line is None else at <= spec.end_line)
    comment = F.col("value").startswith(spec.comment) if spec.comment else F.lit(False)
    blank = F.length(F.trim("value")) == 0
    kind = F.when(at.isin(list(spec.header_lines)), "header").when(comment, "comment").when(~inside, "other").when(blank, "blank").otherwise("data")
    return lines.withColumn("row_class", kind)


def text_table(lines: DataFrame, keys: list[str], spec: SourceSpec, separator: str, joined: bool) -> DataFrame:
    """Numbered lines (keys, line_no, value) of delimited text as columns, each file by its own header.

    Comments are taken out before lines are joined into records; a record has the place of
    its first line.
    """
    lines = classified(lines, spec)
    heads = lines.filter("row_class = 'header'").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n").alias("header"))
    known, layouts = layouts_of(scratch.save(heads, "headers"), separator, joined)  # one row for each file
    inside = lines.filter(F.col("row_class").isin("data", "blank")).select(*keys, "line_no", "value")
    whole = records(inside, keys).filter(F.length(F.trim("value")) > 0)
    return cells_of(whole.join(known, keys, "left"), layouts, spec.bad_rows, separator)


def generated(spark: SparkSession, rows: int, columns: dict[str, Column]) -> DataFrame:
    """``rows`` rows made by expressions over ``id`` (0, 1, …), in parallel."""
    return spark.range(rows).select(*[made.alias(name) for name, made in columns.items()])


def random_normal(mean: float, deviation: float, seed: int) -> Column:
    return F.randn(seed) * deviation + mean


def random_exponential(rate: float, seed: int) -> Column:
    return -F.log(1 - F.rand(seed)) / rate


def random_triangular(low: float, high: float, mode: float, seed: int) -> Column:
    at = (mode - low) / (high - low)

    def inverse(u: Column) -> Column:
        return F.when(u < at, low + F.sqrt(u * (high - low) * (mode - low))).otherwise(high - F.sqrt((1 - u) * (high - low) * (high - mode)))

    return F.transform(F.array(F.rand(seed)), inverse)[0]  # one draw for both sides


def from_rows(spark: SparkSession, rows: Iterable[tuple], names: list[str] | None = None) -> DataFrame:
    """Local rows; without names the columns are called after the types of the first row."""
    held = list(rows)
    return spark.createDataFrame(held, unique_names(names or [type(x).__name__ for x in held[0]]))


def is_plain(spec: SourceSpec) -> bool:
    """Whether a source is delimited text with one header line on top and nothing else but data."""
    return spec.kind in ("csv", "tsv") and spec.header_lines == (0,) and spec.start_line == 1 and spec.end_line is None and not spec.comment


def read(spark: SparkSession, spec: SourceSpec, made: dict[str, Callable[[SparkSession], DataFrame]] | None = None) -> DataFrame:
    """The rows of a source by its kind.

    A generator names a function in ``made`` that gives a DataFrame; a frame names a
    temporary view.
    """
    separator = "\t" if spec.kind == "tsv" else ","
    if is_plain(spec):
        return plain_table(spark, [spec]).drop("_file")
    if spec.kind in ("csv", "tsv"):
        return text_table(numbered_lines(spark, spec.reference, spec.encoding), ["file"], spec, separator, joined=True)
    if spec.kind == "fixed":
        return fixed_width(spark, spec.reference, spec.widths, spec.encoding)
    if spec.kind == "zip":
        return zipped_table(zip_records(spark, spec.reference, spec.member, spec.encoding), spec)
    if spec.kind == "partition":
        return spark.read.parquet(spec.reference)
    if spec.kind == "sql":
        return spark.sql(spec.reference)
    if spec.kind == "frame":
        return spark.table(spec.reference)
    if spec.kind == "generator":
        return made[spec.reference](spark)
    raise ValueError(f"no source kind {spec.kind!r}")
