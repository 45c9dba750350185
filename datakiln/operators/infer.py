"""Types of text columns, from one aggregation over all values.

Each value counts for the first type that its text fits.  A column of one type has it;
integers and floats together are floats; a column that is at least `MOSTLY` numeric and
otherwise text is numeric with codes; anything else is text; no values at all: unknown.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datakiln.functions import casts
from datakiln.operators.headers import ColumnSpec

KINDS = ("int", "float", "date", "datetime", "time", "str")
MOSTLY = 0.95


def type_counts(df: DataFrame) -> DataFrame:
    """(column, position, total, nulls, int, float, date, datetime, time, str): one row for each column, one pass."""
    raw = F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"`{c}`").cast("string").alias("raw")) for i, c in enumerate(df.columns)])
    # cells, not columns, are rows here: one expression for all columns compiles once, and counts are combined before the shuffle
    each = df.select(F.explode(raw).alias("x")).select("x.position", kind_of(casts.nullify(F.col("x.raw"))).alias("kind"))
    counts = [F.count("*").alias("total"), F.count_if(F.col("kind") == "null").alias("nulls"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS]]
    return each.groupBy("position").agg(*counts).withColumn("column", F.array(*map(F.lit, df.columns))[F.col("position")])


def kind_of(text: Column) -> Column:
    """The first kind that a text fits, "null" for none."""
    date = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$|^\d{1,2}/\d{1,2}/(\d{4}|\d{2})$") & casts.to_date(text).isNotNull()
    stamp = text.rlike(r"^\d{4}-?\d{2}-?\d{2}[T ]\d{2}") & casts.to_timestamp(text).isNotNull()
    time = text.rlike(r"^\d{1,2}:\d{2}") & casts.to_time(text).isNotNull()
    return F.when(text.isNull(), "null").when(text.rlike(casts.INT_TEXT), "int").when(text.rlike(casts.FLOAT_TEXT), "float").when(date, "date").when(stamp, "datetime").when(time, "time").otherwise("str")


def resolved(counts: DataFrame) -> DataFrame:
    """`type_counts` with datatype and has_codes."""
    held = F.col("total") - F.col("nulls")
    numeric = F.col("int") + F.col("float")
    widest = F.when(F.col("float") > 0, "float").otherwise("int")
    only = F.coalesce(*[F.when(F.col(k) == held, k) for k in KINDS])
    codes = (F.col("str") > 0) & (numeric + F.col("str") == held) & (numeric >= MOSTLY * held)
    kind = F.when(held == 0, "unknown").when(only.isNotNull(), only).when(numeric == held, "float").when(codes, widest).otherwise("str")
    return counts.withColumns({"datatype": kind, "has_codes": F.coalesce(codes & only.isNull(), F.lit(False))})


def inferred(df: DataFrame) -> list[ColumnSpec]:
    """The columns of ``df`` with their inferred types; one row for each column comes to the driver."""
    rows = resolved(type_counts(df)).orderBy("position").collect()
    return [ColumnSpec(r.position + 1, r.column, r.datatype, has_codes=r.has_codes) for r in rows]
