"""Exact top-k inner products by a three-phase uniform threshold.

The components are cut into ``lists`` column lists; a score is the sum of its partial
scores in the lists.

1. Local score lists: every query meets some blocks of rows (the square root of their
   number).  There each column list is ranked by its partial products alone, and only the
   entries that lead a list are resolved to scores.  The k-th best of these is a safe cutoff:
   at least k rows reach it.  They give the cutoff and nothing else, since a row that leads no
   list may have a higher score than those that do.
2. The cutoff goes to all blocks, the first ones too, with the queries.  A row that reaches it
   has at least cutoff / lists in some list, so the entries at or above that are sufficient; a list
   whose longest row cannot bring a query's product so far is not multiplied at all.
3. Only the sufficient entries are resolved, exactly; of those that reach the cutoff each
   block returns its k best, which are ranked together.

Rows stay in one block each and queries stream past it (`meeting`), so rows are shuffled
once whatever the number of queries.  Neither side is broadcast, and no pair
becomes a Spark row unless it reaches the cutoff.  A query with fewer than k candidates in
its first blocks has a null cutoff and keeps everything.  Scores must fit a long.  See
`vectors` for nulls, repeated ids, lengths, empty tables and other columns.
"""

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datakiln.jobs import scratch
from datakiln.llm import meeting, vectors

LISTS = 4
#: Up to here sums of products are exact in doubles.
EXACT = 2.0**53
FOUND = "asked long, query_id long, vec_id long, score long"


def largest(v: np.ndarray) -> float:
    """The largest size of a component."""
    return float(max(v.max(initial=0), -float(v.min(initial=0))))


def exact_kind(one: float, other: float, dim: int) -> type:
    """Doubles where all sums of products of components up to these sizes are exact in them, else longs."""
    return np.float64 if one * other * dim < EXACT else np.int64


def column_lists(dim: int, lists: int) -> list[slice]:
    cuts = np.linspace(0, dim, max(1, min(lists, dim)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def resolved(queries: np.ndarray, rows: np.ndarray, asked: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Exact scores of some pairs, a bounded number at a time."""
    out, step = np.empty(len(asked), queries.dtype), max(1, vectors.PAIRS_AT_ONCE // max(queries.shape[1], 1))
    for at in range(0, len(asked), step):
        out[at : at + step] = (queries[asked[at : at + step]] * rows[row[at : at + step]]).sum(axis=1)
    return out


def leaders(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, lists: list[slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1 on a slice: the k best scores among the entries that lead a column list, and their pairs."""
    led = np.zeros(own.shape, bool)
    for part in lists:
        partial = queries[:, part] @ rows[:, part].T
        partial[own] = partial.min(initial=0) - 1
        led[tuple(vectors.top_rows(partial, k))] = True
    asked, row = np.nonzero(led & ~own)
    scores = resolved(queries, rows, asked, row)
    kept = vectors.first_of_each(asked, row, scores, k)
    lookup = np.searchsorted(asked * own.shape[1] + row, kept[0] * own.shape[1] + kept[1])
    return kept[0], kept[1], scores[lookup]


def sufficient(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, lists: list[slice], cutoff: np.ndarray, bounded: np.ndarray, longest: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 on a slice: the k best of the entries above the uniform threshold that reach the cutoff.

    ``longest`` holds the length of the longest row in each list.
    """
    enough = np.repeat(~bounded[:, None], own.shape[1], axis=1)
    threshold = cutoff // len(lists)
    whole, total = np.ones(len(queries), bool), np.zeros(own.shape, queries.dtype)
    for part, length in zip(lists, longest, strict=True):
        reach = np.linalg.norm(queries[:, part].astype(float), axis=1) * length
        asks = ~bounded | (reach * (1 + 1e-9) >= threshold.astype(float))
        partial = queries[asks][:, part] @ rows[:, part].T
        enough[asks] |= partial >= threshold[asks, None]
        total[asks] += partial
        whole &= asks
    asked, row = np.nonzero(enough & ~own)
    scores = total[asked, row]
    short = np.flatnonzero(~whole[asked])  # of queries that left out a list
    scores[short] = resolved(queries, rows, asked[short], row[short])
    reach = ~bounded[asked] | (scores >= cutoff[asked])
    asked, row, scores = asked[reach], row[reach], scores[reach]
    kept = vectors.first_of_each(asked, row, scores, k)
    lookup = np.searchsorted(asked * own.shape[1] + row, kept[0] * own.shape[1] + kept[1])
    return kept[0], kept[1], scores[lookup]


class Block:
    """The rows of a block in the order of vec_id, nulls last, so ties go to the smaller id."""

    def __init__(self, table: pa.Table, lists: int) -> None:
        table = table.sort_by("vec_id")
        self.v, self.row = vectors.matrix(table), table.column("row").to_numpy()
        self.vec_id = table.column("vec_id").combine_chunks()
        self.cuts = column_lists(self.v.shape[1], lists)
        self.longest = [float(np.linalg.norm(self.v[:, part].astype(float), axis=1).max(initial=0)) for part in self.cuts]
        self.largest, self.exact = largest(self.v), {}

    def rows(self, kind: type) -> np.ndarray:
        if kind not in self.exact:
            self.exact = {kind: self.v.astype(kind)}
        return self.exact[kind]


def in_blocks(k: int, with_cutoff: bool):
    """For `meeting.meet`: phase 1, or phases 2 and 3, for one block of rows and a batch of queries."""

    def ask(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([batch])
        queries, askers = vectors.matrix(table), table.column("row").to_numpy()
        kind = exact_kind(largest(queries), block.largest, queries.shape[1])
        rows, queries = block.rows(kind), queries.astype(kind)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in vectors.slices(len(askers), len(rows)):
            own = askers[at, None] == block.row[None, :]
            if with_cutoff:
                cutoff = table.column("cutoff")[at.start : at.stop]
                low, bounded = cutoff.fill_null(0).to_numpy(), cutoff.is_valid().to_numpy()
                asked, row, scores = sufficient(queries[at], rows, own, k, block.cuts, low, bounded, block.longest)
            else:
                asked, row, scores = leaders(queries[at], rows, own, k, block.cuts)
            pairs.append((asked + at.start, row, scores.astype(np.int64)))
        if pairs:
            asked, row, scores = (np.concatenate(x) for x in zip(*pairs, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(askers[asked]), table.column("vec_id").combine_chunks().take(pa.array(asked, pa.int64())), block.vec_id.take(pa.array(row, pa.int64())), pa.array(scores)], ["asked", "query_id", "vec_id", "score"])

    return ask


def top_k(rows: DataFrame, is_query: str, k: int = 5, key: str = "vec_id", vector: str = "embedding", lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each row for which ``is_query`` (SQL over vec_id) holds.

    Components are floor(256 * x).  All candidates are returned where there are fewer than k.
    """
    spark = rows.sparkSession
    kept = vectors.valid(rows, key, vector)
    whole = scratch.save(kept.withColumn("v", F.transform("v", lambda x: F.floor(x * 256.0))), "vectors")
    n, dim, largest = whole.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1)), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    slim = whole.withColumn("v", F.col("v").cast(meeting.smallest_ints(largest or 0)))
    parts = meeting.blocks_for(n, dim, spark.sparkContext.defaultParallelism)
    early = isqrt(parts - 1) + 1
    dealt = slim.withColumn("nth", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    queries = slim.filter(is_query).filter("vec_id is not null")

    def met(asking: DataFrame, until: int, with_cutoff: bool) -> DataFrame:
        sent = asking.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(until - 1))))
        held = dealt.filter(F.col("nth") < until)
        blocks = [df.withColumn("block", F.xxhash64("nth", "dim")).drop("nth", "dim") for df in (held, sent)]
        return meeting.meet(*blocks, lambda table: Block(table, lists), in_blocks(k, with_cutoff), FOUND)

    gathered = scratch.save(met(queries, early, with_cutoff=False), "gathered")
    bar = Window.partitionBy("asked").orderBy(F.desc("score"))
    led = gathered.withColumn("place", F.row_number().over(bar)).filter(F.col("place") == k)
    cut = led.select(F.col("asked").alias("row"), F.col("score").alias("cutoff"))
    known = scratch.save(queries.join(cut, "row", "left"), "cutoffs")
    return vectors.best(met(known, parts, with_cutoff=True), k)
