"""Rows with an identity of their own, whatever their keys say."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datakiln.jobs import scratch
from datakiln.operators.headers import unused


def identified(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with a column that tells its rows apart, and that column's name (unused in ``df``).

    Rows read from Parquet are named by their file and their place in it, which is the same in
    every pass however the files are cut into tasks, and nothing is written: for tables as
    they are read, since what was computed from them would be computed in every pass.  Other
    rows are saved with a number.
    """
    row = unused(name, df.columns)
    try:
        read = df.metadataColumn("_metadata")
        return df.withColumn(row, F.struct(F.xxhash64(read["file_path"]).alias("file"), read["row_index"].alias("at"))), row
    except AnalysisException:
        return numbered(df, name)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` saved with a column that numbers its rows, and that column's name (unused in ``df``)."""
    row = unused(name, df.columns)
    return scratch.save(df.withColumn(row, F.monotonically_increasing_id()), name.strip("_")), row
