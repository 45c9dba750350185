"""Hard negatives: rows of other labels whose score comes close below a positive's.

An anchor's positives are the other rows of its label with the highest scores; for each of
them the negatives are the highest scores of other labels within a band below the
positive's.  Both are the same search, for the k highest scores inside bands of scores
(one open band for positives).

Segment summaries filter it.  A vector is cut into segments; of each its mean and its
deviation are stored beside it in its block.  Over a segment of m components an inner
product is m times the product of the means, plus or minus m times the product of the deviations; the
sums over the segments bound the score.  Pairs whose bounds miss all bands of an anchor are
dropped at one segment, the rest at four segments and then at sixteen (`SEGMENTS`), and only
what is left is scored, exactly.

One part of the blocks (the square root of their number) is searched first; an anchor's
k-th best in a band there is a floor for the band in all other blocks.  Rows and anchors
meet as in `meeting`: for positives in blocks of one label each, as many as the label's rows
need, for negatives in blocks of any labels.  No candidates are capped: a band gives k rows
of each block.

Rows with a null label or vector, or a null or non-finite component, take no part.  Rows are
told apart by a number of their own (see `vectors`): rows that repeat an id are anchors,
positives and negatives each; a row without id is never an anchor and last among ties.  Only
vectors of one length are compared.  Scores must fit a long.  Other columns take no part,
whatever their names.  An empty table, or one of a single label, gives an empty result.
"""

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datakiln.jobs import scratch
from datakiln.llm import meeting, vectors
from datakiln.llm.top_k import exact_kind, largest

SEGMENTS = (1, 4, 16)
#: The share of pairs above which a level is multiplied as a whole instead of pair by pair.
DENSE = 0.125
LEAST, MOST = -(2**63), 2**63 - 1
FOUND = "anchor long, anchor_id long, band int, row long, vec_id long, score long"


def summaries(v: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment of each row the mean and the deviation, both times the root of its length."""
    cuts = np.linspace(0, v.shape[1], max(1, min(segments, v.shape[1])) + 1).astype(int)
    size = np.diff(cuts)
    mean = np.add.reduceat(v, cuts[:-1], axis=1) / size if v.shape[1] else np.zeros((len(v), 1))
    rest = v - np.repeat(mean, size, axis=1) if v.shape[1] else v
    deviation = np.sqrt(np.add.reduceat(rest * rest, cuts[:-1], axis=1)) if v.shape[1] else np.zeros((len(v), 1))
    return mean * np.sqrt(size), deviation


class Block:
    """The rows of a block with their segment summaries, in the order of vec_id, nulls last."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by("vec_id")
        self.v = vectors.matrix(table, "v")
        self.floats, self.largest = self.v.astype(float), largest(self.v)
        self.row, self.label = table.column("row").to_numpy(), table.column("label").to_numpy()
        self.vec_id = table.column("vec_id").combine_chunks()
        self.levels = [summaries(self.floats, s) for s in SEGMENTS]


def narrowed(open_: np.ndarray, asked: tuple, held: tuple, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The open pairs whose bounds at one level meet the anchor's scores from low to high."""
    (mean_a, dev_a), (mean_b, dev_b) = asked, held
    if open_.mean() > DENSE:
        middle, reach = mean_a @ mean_b.T, dev_a @ dev_b.T
        reach += 1e-9 * (np.abs(middle) + reach) + 1e-6
        return open_ & (middle + reach >= low[:, None]) & (middle - reach <= high[:, None])
    a, b = np.nonzero(open_)
    step = max(1, vectors.PAIRS_AT_ONCE // mean_a.shape[1])
    for at in range(0, len(a), step):
        i, j = a[at : at + step], b[at : at + step]
        middle, reach = (mean_a[i] * mean_b[j]).sum(axis=1), (dev_a[i] * dev_b[j]).sum(axis=1)
        reach += 1e-9 * (np.abs(middle) + reach) + 1e-6
        open_[i, j] = (middle + reach >= low[i]) & (middle - reach <= high[i])
    return open_


def exact_scores(a: np.ndarray, block: Block, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the open pairs, by anchor and row."""
    kind = exact_kind(largest(a), block.largest, a.shape[1])
    a, b = a.astype(kind), block.floats if kind is np.float64 else block.v.astype(kind)
    i, j = np.nonzero(open_)
    if open_.mean() > DENSE:
        return i, j, (a @ b.T)[i, j].astype(np.int64)
    out, step = np.empty(len(i), np.int64), max(1, vectors.PAIRS_AT_ONCE // max(a.shape[1], 1))
    for at in range(0, len(i), step):
        out[at : at + step] = (a[i[at : at + step]] * b[j[at : at + step]]).sum(axis=1)
    return i, j, out


def search(k: int, same_label: bool):
    """For `meeting.meet`: each band's k highest scores among the block's rows of the anchor's label, or of others."""

    def ask(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([batch])
        v, label, row = vectors.matrix(table, "v"), table.column("label").to_numpy(), table.column("row").to_numpy()
        floors, ceilings = bands_of(table, "low", LEAST), bands_of(table, "high", LEAST)
        asked = [summaries(v.astype(float), s) for s in SEGMENTS]
        found: list[list[np.ndarray]] = []
        for at in vectors.slices(len(v), len(block.row)):
            open_ = (label[at, None] == block.label[None, :]) == same_label
            open_ &= row[at, None] != block.row[None, :]
            some = ceilings[at] > LEAST
            low, high = np.where(some, floors[at], MOST).min(axis=1).astype(float), ceilings[at].max(axis=1).astype(float)
            for mine, theirs in zip(asked, block.levels, strict=True):
                open_ = narrowed(open_, (mine[0][at], mine[1][at]), theirs, low, high)
            i, j, score = exact_scores(v[at], block, open_)
            for band in range(floors.shape[1]):
                inside = np.flatnonzero((score >= floors[at][i, band]) & (score <= ceilings[at][i, band]) & some[i, band])
                kept = vectors.first_of_each(i[inside], j[inside], score[inside], k)
                place = np.searchsorted(i[inside] * len(block.row) + j[inside], kept[0] * len(block.row) + kept[1])
                found.append([kept[0] + at.start, np.full(kept.shape[1], band), kept[1], score[inside][place]])
        if found:
            i, band, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(row[i]), table.column("vec_id").combine_chunks().take(pa.array(i)), pa.array(band.astype(np.int32)), pa.array(block.row[j]), block.vec_id.take(pa.array(j)), pa.array(score)], ["anchor", "anchor_id", "band", "row", "vec_id", "score"])

    return ask


def bands_of(table: pa.Table, name: str, missing: int) -> np.ndarray:
    """A list column as a matrix, short lists filled up."""
    lists = table.column(name).to_pylist()
    width = max(map(len, lists), default=0)
    return np.array([[*x, *[missing] * (width - len(x))] for x in lists], np.int64).reshape(len(lists), width)


def best_in_bands(rows: DataFrame, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(anchor, anchor_id, band, row, vec_id, score, rank) of the k highest scores in each band of each anchor.

    ``rows`` have block and nth (the number of the block among ``blocks``), ``anchors`` blocks
    and a function of nth to block in ``block_of``; first some blocks are asked, then the rest
    with the floors that these gave.
    """
    ranked = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")

    def asked(first: Column, some: DataFrame) -> DataFrame:
        early = F.ceil(F.sqrt(F.col("blocks"))).cast("int")
        until = F.when(first, early).otherwise(F.col("blocks"))
        since = F.when(first, F.lit(0)).otherwise(early)
        sent = some.withColumn("nth", F.explode(F.when(since < until, F.sequence(since, until - 1))))
        held = rows.filter((F.col("nth") < F.ceil(F.sqrt(F.col("blocks")))) == first)
        slim = ["block", "row", "vec_id", "label", "v"]
        sent = sent.withColumn("block", block_of("dim", F.col("label") if same_label else F.lit(None).cast("long"), "nth"))
        return meeting.meet(held.select(*slim), sent.select(*slim, "low", "high"), Block, search(k, same_label), FOUND)

    early = scratch.save(asked(F.lit(True), anchors), "early")
    if anchors.filter("blocks > ceil(sqrt(blocks))").isEmpty():
        found = early
    else:
        kth = early.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k)
        floors = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("floors"))  # one for each band
        known = anchors.join(floors.withColumnRenamed("anchor", "row"), "row", "left")
        raised = F.transform("low", lambda x, i: F.coalesce(F.col("floors")[i], x))
        found = early.unionByName(asked(F.lit(False), known.withColumn("low", raised)))
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def block_of(dim: str, label: Column, nth: str) -> Column:
    """The number of a block by the length, the label (null for any) and its place among the blocks of these."""
    return F.xxhash64(F.col(dim), F.coalesce(label, F.lit(0)), label.isNull(), F.col(nth))


def placed(rows: DataFrame, by: list[str], cores: int) -> DataFrame:
    """``rows`` with blocks, how many blocks the rows of the same ``by`` need, and nth, the one that a row is in."""
    held = rows.groupBy(*by).agg(F.count("*").alias("held"))
    room = F.greatest(F.lit(1), F.floor(F.lit(meeting.BLOCK_BYTES) / (8 * F.greatest(F.col("dim"), F.lit(1)))))
    needed = F.greatest(F.ceil(F.col("held") / room), F.least(F.ceil(F.col("held") / 64), F.lit(2 * cores)))
    plan = held.select(*by, needed.cast("int").alias("blocks"))
    return rows.join(plan, by).withColumn("nth", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))


def hard_negatives(rows: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 5, low: int = 80, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are floor(256 * x), a score is an inner product, anchors are the rows for which
    ``is_anchor`` (SQL over vec_id) holds.  A negative's score is at most the positive's and at
    least ``low`` hundredths of it.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    tag = (F.col(label) if isinstance(label, str) else label).cast("long").alias("label")
    kept = vectors.valid(rows, key, vector, others=(tag,)).filter("label is not null")
    whole = scratch.save(kept.withColumn("v", F.transform("v", lambda x: F.floor(x * 256.0))), "vectors")
    largest = whole.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0
    slim = whole.withColumn("v", F.col("v").cast(meeting.smallest_ints(largest)))
    anchors = slim.filter(is_anchor).filter("vec_id is not null")

    alike = placed(slim, ["dim", "label"], cores)
    mine = alike.withColumn("block", block_of("dim", F.col("label"), "nth"))
    open_band = {"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))}
    asking = alike.filter(is_anchor).filter("vec_id is not null").withColumns(open_band).drop("nth")
    first = scratch.save(best_in_bands(mine, asking, positives, same_label=True), "positives")

    least = F.expr(f"cast((cast(score as decimal(38, 0)) * {int(low)} + 99) div 100 as long)")
    wanted = first.filter("score >= 0").select("anchor", (F.col("rank") - 1).alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), least.alias("low"))
    ordered = F.array_sort(F.collect_list(F.struct("band", "low", F.col("positive_score").alias("high"))))
    bands = wanted.groupBy(F.col("anchor").alias("row")).agg(ordered.alias("bands"))  # at most one for each positive
    lows = {"low": F.col("bands.low"), "high": F.col("bands.high")}
    any_label = placed(slim, ["dim"], cores)
    blocks = any_label.select("dim", "blocks").distinct()
    seeking = scratch.save(anchors.join(bands, "row").join(blocks, "dim").withColumns(lows).drop("bands"), "seeking")
    theirs = any_label.withColumn("block", block_of("dim", F.lit(None).cast("long"), "nth"))
    found = best_in_bands(theirs, seeking, negatives, same_label=False)
    return found.join(wanted.drop("low"), ["anchor", "band"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
