"""Intermediate tables in the folder that the driver and all executors share.

A saved table cuts the lineage: a lost executor costs the tasks it ran, not the
stages before the table.  The folder is ``spark.checkpoint.dir`` of the session;
only where that is unset and all runs in one process (tests) a folder of our own is
made: on a cluster each machine would write to its own disk, so that is an error.
"""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None
_scopes: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the session, or one of our own where one process is the whole cluster."""
    global _own_root
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="spark-datakiln-")
    return _own_root


def folder(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A path of its own in the shared folder, never given twice.

    It is removed with the `cleared` block that it is taken in, or with the one around that
    if it is to outlive its block.
    """
    path = f"{shared_root(spark)}/datakiln/{name}-{uuid.uuid4().hex}"
    if scopes := _scopes[:-1] if outlives else _scopes:
        scopes[-1].append(path)
    return path


def save(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return it read from there.

    Each call takes a new folder, so reruns never see old rows.  The returned frame is lazy,
    so the files stay until the shared folder is cleared, or until a `cleared` block ends
    (for one that ``outlives`` its block, the block around it).
    """
    return written(df, folder(df.sparkSession, name, outlives))


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a path of the shared folder and read from there."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, for files that tasks write or read themselves; any scheme that pyarrow knows."""
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a:") else path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)  # noqa: SLF001


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """A block whose saved tables are removed when it ends: use what it computes, or write it elsewhere, inside."""
    held: list[str] = []
    _scopes.append(held)
    try:
        yield
    finally:
        _scopes.pop()
        for path in held:
            remove(spark, path)
