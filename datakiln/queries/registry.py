"""How a module registers its queries."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registrar(queries: dict[str, tuple[Query, str | None]]) -> Callable:
    """A decorator that files a query under its function's name, with its SQL."""

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def file(f: Query) -> Query:
            queries[f.__name__] = (f, sql)
            return f

        return file

    return query


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
