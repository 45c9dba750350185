"""Nested JSON text as (path, value) pairs of any depth."""

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))


def pairs_of(value: object, separator: str, path: str = "") -> Iterator[dict[str, str | None]]:
    """Leaves with the keys and list places that lead to them; empty objects and lists have none."""
    waiting = [(path, value)]
    while waiting:
        at, here = waiting.pop()
        if isinstance(here, dict):
            inner = list(here.items())
        elif isinstance(here, list):
            inner = list(enumerate(here))
        else:
            yield {"path": at, "value": here if here is None or isinstance(here, str) else json.dumps(here)}
            continue
        waiting += [(f"{at}{separator}{key}" if at else str(key), x) for key, x in reversed(inner)]


def flattened(text: Column, separator: str = ".") -> Column:
    """``array<struct<path, value>>`` of a JSON column; null for null or broken text.  One level needs no helper: see ``from_json`` as a map."""

    @F.arrow_udf("array<struct<path:string,value:string>>")
    def flat(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for item in batch:
                try:
                    rows.append(list(pairs_of(json.loads(item.as_py()), separator)) if item.is_valid else None)
                except ValueError:
                    rows.append(None)
            yield pa.array(rows, PAIRS)

    return flat(text)


def flattened_rows(df: DataFrame, column: str, separator: str = ".") -> DataFrame:
    """A row for each leaf, with path and value in place of the column."""
    return df.withColumn(column, F.explode(flattened(F.col(column), separator))).select(*[c for c in df.columns if c != column], f"{column}.path", f"{column}.value")
