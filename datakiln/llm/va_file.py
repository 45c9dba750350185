"""Exact k-means over a vector-approximation file.

Vectors are whole numbers.  Each is compressed once to cells of `CELL_BITS` bits a
component; cuts between cells are quantiles of at most `FIT_ROWS` rows taken by hash, which
decide how tight the bounds are and never what they say: the outer cells reach to the
least and largest number of all rows.  The cells stand beside the vectors as a column of
their own in one saved table.

A round knows its centroids and, for every component and cell, the least and largest that
the cell can add to the distance from each of them.  Summed over a vector's cells these
look-ups give an interval for every centroid, less what all centroids share (the vector's
length and its part along their middle), so that intervals are as narrow as centroids are
near to each other.  Where only one centroid can be nearest, cells decide; the vectors of
the others are fetched, and compared with the centroids whose intervals overlap.  Sums of
clusters are kept on from round to round: a vector is fetched for them only when it
changes its cluster.  A round is one scan with nothing shuffled but a row for each cluster and task,
so a lost executor costs the tasks it ran.  What is broadcast is bounded by centroids,
components and cells.

Vectors of another length, null ones and those with a null or non-finite component take no
part.  Rows that repeat an id, or have none, are clustered each on its own; rows without
id start a centroid only where too few others are there, and equal hashes are ordered by
the vector.  Fewer rows than centroids give as many centroids as rows.  Squared distances
and their sums must fit a long; numbers too large for that are a ValueError.  Other columns
take no part, whatever their names.  An empty table gives an empty result.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datakiln.jobs import scratch
from datakiln.llm import bitpack, vectors

CELL_BITS, FIT_ROWS = 6, 20_000
#: Vectors whose intervals are summed at once, and differences of components held at once.
ROWS_AT_ONCE, DIFFERENCES_AT_ONCE = 4096, 1 << 20
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(rows: DataFrame, dim: int, key: str, vector: str) -> DataFrame:
    """(vec_id, x: array<double>) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    kept = rows.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).filter((F.col("x").isNotNull()) & (F.size("x") == dim))
    return kept.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def floored(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def cuts_of(sample: np.ndarray, bits: int) -> np.ndarray:
    """The largest number of each cell but the last, (cells - 1, dim)."""
    return np.quantile(sample, np.arange(1, 1 << bits) / (1 << bits), axis=0, method="lower").astype(np.int64)


def cells_of(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The cell of each component of (n, dim) numbers."""
    return np.stack([np.searchsorted(cuts[:, d], v[:, d], side="left") for d in range(v.shape[1])], axis=1)


def lookup_tables(centroids: np.ndarray, cuts: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(dim, cells, 2 centroids): the least, then the largest that a cell adds to each centroid's reduced distance.

    With m the middle of the centroids, (c - m)² - 2 (x - m)(c - m) differs from (x - c)² by
    (x - m)², which all centroids share.
    """
    middle = centroids.sum(axis=0) // len(centroids)
    low = np.vstack([least, cuts + 1]) - middle
    high = np.vstack([cuts, most]) - middle
    c = (centroids - middle).T[:, None, :]
    one, other = c * c - 2 * c * low.T[:, :, None], c * c - 2 * c * high.T[:, :, None]
    made = np.concatenate([np.minimum(one, other), np.maximum(one, other)], axis=2)
    small = np.abs(made).max(axis=(1, 2), initial=0).sum() < 2**31
    return made.astype(np.int32) if small else made


def overlapping(cells: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(n, centroids): whether a centroid's interval reaches below the least upper end."""
    total = np.zeros((len(cells), tables.shape[2]), tables.dtype)
    for d in range(cells.shape[1]):
        total += tables[d][cells[:, d]]
    k = tables.shape[2] // 2
    return total[:, :k] <= total[:, k:].min(axis=1)[:, None]


def exact_nearest(v: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of each row's open centroids and its squared distance; ties to the smaller number."""
    row, cluster = np.nonzero(open_)
    far, step = np.empty(len(row), np.int64), max(1, DIFFERENCES_AT_ONCE // v.shape[1])
    for at in range(0, len(row), step):
        far[at : at + step] = ((v[row[at : at + step]] - centroids[cluster[at : at + step]]) ** 2).sum(axis=1)
    order = np.lexsort((cluster, far, row))
    first = order[np.unique(row[order], return_index=True)[1]]
    return cluster[first], far[first]


def unmasked(column: pa.Array, k: int, sets: int) -> list[np.ndarray]:
    """Rows of packed bits as ``sets`` matrices of k columns each."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    bits = np.unpackbits(data, axis=1, count=k * sets).astype(bool)
    return [bits[:, k * i : k * i + k] for i in range(sets)]


def as_binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


class Clustering:
    """The saved approximations, and what each round broadcasts."""

    def __init__(self, rows: DataFrame, dim: int, key: str, vector: str, scale: float) -> None:
        self.spark, self.dim = rows.sparkSession, dim
        found = whole_vectors(rows, dim, key, vector)
        ends = [f(F.element_at("x", d + 1)) for f in (F.min, F.max) for d in range(dim)]
        self.n, *held = found.agg(F.count("*"), *ends).first()
        if not self.n:
            return
        outer = floored(np.array(held, float).reshape(2, dim), scale)
        if dim * (2 * np.abs(outer).max()) ** 2 >= 2.0**63:
            raise ValueError("squared distances of these vectors do not fit a long")
        self.least, self.most = outer.astype(np.int64)
        sample = vectors.sampled(found.select(F.monotonically_increasing_id().alias("row"), F.col("x").alias("v")), self.n, FIT_ROWS, "row").select("v").toArrow()
        self.cuts = cuts_of(floored(vectors.matrix(sample), scale).astype(np.int64), CELL_BITS)
        numbers = found.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))
        self.table = scratch.save(numbers.withColumn("cells", self.compressed(F.col("v"))), "cells")

    def compressed(self, v: Column) -> Column:
        cuts = self.spark.sparkContext.broadcast(self.cuts)

        @F.arrow_udf("binary")
        def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                numbers = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                yield as_binary(bitpack.pack(cells_of(numbers, cuts.value), CELL_BITS)) if len(batch) else pa.array([], pa.binary())

        return made(v)

    def starts(self, k: int, seed: str) -> np.ndarray:
        """The k vectors of least hash; every task sends k rows at most."""
        h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        found = self.table.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").toArrow()
        return vectors.matrix(found).astype(np.int64)

    def open_centroids(self, *rounds: np.ndarray) -> Column:
        """(masks: the centroids of each round that a row's cells leave open, fetch: whether cells say too little)."""
        tables = self.spark.sparkContext.broadcast([lookup_tables(c, self.cuts, self.least, self.most) for c in rounds])
        dim = self.dim

        @F.arrow_udf("struct<masks:binary,fetch:boolean>")
        def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                masks, fetch = [], []
                packed = np.frombuffer(b"".join(batch.to_pylist()), np.uint8).reshape(len(batch), -1)
                for at in range(0, len(packed), ROWS_AT_ONCE):
                    cells = bitpack.unpack(packed[at : at + ROWS_AT_ONCE], dim, CELL_BITS)
                    found = [overlapping(cells, t) for t in tables.value]
                    sure = np.all([f.sum(axis=1) == 1 for f in found], axis=0)
                    fetch.append(~(sure & np.all([f == found[0] for f in found], axis=(0, 2))) if len(found) > 1 else ~sure)
                    masks.append(np.packbits(np.concatenate(found, axis=1), axis=1))
                flat = np.concatenate(fetch) if fetch else np.empty(0, bool)
                yield pa.StructArray.from_arrays([as_binary(np.concatenate(masks)) if masks else pa.array([], pa.binary()), pa.array(flat)], ["masks", "fetch"])

        return made.asNondeterministic()(F.col("cells"))  # so that a filter on it does not compute it twice

    def moved_sums(self, now: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """What enters each cluster less what leaves it since the round before: counts, and sums by component."""
        rounds = [now] if before is None else [before, now]
        near = self.table.select("v", self.open_centroids(*rounds).alias("near"))
        fetched = (near if before is None else near.filter("near.fetch")).select("near.masks", "v")
        k, dim = len(now), self.dim

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
            for batch in batches:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
                owners = [exact_nearest(v, open_, c)[0] for open_, c in zip(unmasked(batch.column("masks"), k, len(rounds)), rounds, strict=True)]
                for sign, owner in zip((1,) if before is None else (-1, 1), owners, strict=True):
                    counts += sign * np.bincount(owner, minlength=k)
                    np.add.at(sums, owner, sign * v)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(k), pa.int32()), "n": counts, "sums": pa.array(sums.tolist(), pa.list_(pa.int64()))})

        parts = fetched.mapInArrow(partial, "cluster int, n long, sums array<long>")
        total = parts.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.element_at("sums", d + 1)) for d in range(dim)]).orderBy("cluster").collect()
        held = np.array([tuple(r)[1:] for r in total], np.int64)  # one row for each cluster
        return held[:, 0], held[:, 1:]

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """(vec_id, cluster, distance) of every vector; distances are those of the vectors themselves."""
        k, shipped = len(centroids), self.spark.sparkContext.broadcast(centroids)

        @F.arrow_udf("struct<cluster:int,distance:long>")
        def made(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for masks, v in pairs:
                numbers = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.int64)
                cluster, far = exact_nearest(numbers, unmasked(masks, k, 1)[0], shipped.value) if len(v) else (np.empty(0), np.empty(0))
                yield pa.StructArray.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(far.astype(np.int64))], ["cluster", "distance"])

        near = self.table.select("vec_id", "v", self.open_centroids(centroids).alias("near"))
        return near.select("vec_id", made(F.col("near.masks"), F.col("v")).alias("a")).select("vec_id", "a.cluster", "a.distance")


def cluster(rows: DataFrame, k: int, rounds: int, dim: int = 64, seed: str = "2", key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row for each vector of ``dim`` components.

    Components become floor(scale * x).  Centroids start as the vectors of least sha256 of
    "seed:vec_id"; each round assigns every vector to the nearest and floors the means.
    """
    spark = rows.sparkSession
    held = Clustering(rows, dim, key, vector, scale)
    if not held.n:
        return spark.createDataFrame([], RESULT)
    now, before = held.starts(k, seed), None
    counts, sums = np.zeros(len(now), np.int64), np.zeros((len(now), dim), np.int64)
    for _ in range(rounds):
        n, moved = held.moved_sums(now, before)
        counts, sums = counts + n, sums + moved
        means = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], now)
        if (means == now).all():
            break  # every further round would say the same
        before, now = now, means
    found = scratch.save(held.assigned(now), "assigned")
    inertia = {r["cluster"]: r["far"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("far")).collect()}  # one row for each cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    named = [(i, far, sum(inertia.values()), digests[i]) for i, far in inertia.items()]
    known = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
