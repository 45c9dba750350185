"""What the vector searches share: valid rows, blocks of rows, and the last ranking.

Rows with a null vector, or a null or non-finite component take no part.  Vectors are
compared only with vectors of the same length; vectors of length 0 have score 0 with each
other in the exact search and, having no direction, take no part in the cosine search.

Rows are told apart by a number of their own (``row``), not by their id: rows that repeat
an id are candidates and queries each, so a query's id has as many rankings as rows.  A
row is never its own candidate.  A row with a null id is a candidate, last among ties, and
never a query.  Other columns of the table take no part, whatever their names.  An empty
table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datakiln.operators.headers import unused

#: Bytes of vectors that a block holds at most on each side, and the pairs that are compared at once.
BLOCK_BYTES = 8 << 20
PAIRS_AT_ONCE = 1 << 20


def valid(rows: DataFrame, key: str, vector: str, nonzero: bool = False, others: tuple[Column, ...] = ()) -> DataFrame:
    """(row, vec_id, v: array<double>, dim, others) of the rows that take part; to be saved once, so that the numbers stay."""
    v = F.col(vector).cast("array<double>")
    kept = rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"), *others).filter(F.col("v").isNotNull())
    kept = kept.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if nonzero:
        kept = kept.filter(F.exists("v", lambda x: x != 0))
    return kept.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("v")})


def sampled(rows: DataFrame, n: int, most: int, number: str) -> DataFrame:
    """At most ``most`` of ``n`` rows, taken by a hash of their number.

    A bound on the hash leaves about 1.2 times as many first, so that no task gathers more.
    """
    h, keep = F.pmod(F.xxhash64(number), F.lit(1 << 31)), min(1.0, (1.2 * most + 100) / max(n, 1))
    at = unused("at", rows.columns)
    return rows.withColumn(at, h).filter(F.col(at) < int(keep * (1 << 31))).orderBy(at, number).limit(most).drop(at)


def rows_a_block(dim: int) -> int:
    """Rows of a length that fit a block."""
    return max(64, BLOCK_BYTES // (8 * max(dim, 1)))


def matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles or longs."""
    flat = table.column(column).combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(table.num_rows, len(values) // max(table.num_rows, 1))


def slices(n: int, rows: int, pairs: int = PAIRS_AT_ONCE) -> list[slice]:
    """Cuts of ``n`` queries so that each cut makes a bounded number of pairs with ``rows`` rows."""
    step = max(1, pairs // max(rows, 1))
    return [slice(at, at + step) for at in range(0, n, step)]


def best(found: DataFrame, k: int) -> DataFrame:
    """(asked, query_id, vec_id, score) to each asking row's k highest scores with rank; ties to the smaller vec_id."""
    order = Window.partitionBy("asked").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row of a score matrix the columns of its k best, ties to the earlier column."""
    n = scores.shape[1]
    if n > k:
        bar = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero(scores >= bar[:, None])
    else:
        rows, cols = np.divmod(np.arange(scores.size), n) if n else (np.empty(0, int), np.empty(0, int))
    return first_of_each(rows, cols, scores[rows, cols], k)


def first_of_each(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k best (row, column) pairs of each row by score, ties to the earlier column."""
    order = np.lexsort((cols, -scores, rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return np.stack([rows[place < k], cols[place < k]])
