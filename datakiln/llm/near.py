"""Approximate nearest neighbours by an adaptive dimension scan of probed lists.

Vectors are scaled to length one and rotated by one random orthogonal matrix, so that any
leading part of their components is a fair sample of a distance.  Every row belongs to the
list of its nearest centre (centres are fitted on at most `FIT_ROWS` rows, taken by hash);
a query scans the lists of its nearest centres.  Within a list the distance grows by
column blocks: after each block a hypothesis test abandons the candidates whose partial
distance, scaled up and widened by `WIDTH` and by `ROUNDING`, cannot reach the current
k-th best; those that set this bound always survive.  Survivors get the exact cosine of the
original vectors in doubles.

The number of lists to probe is measured on the sample so that `RECALL` of true
neighbours lie in probed lists; a query whose lists hold too few rows probes more.  Lists
grow in number with the square root of the rows; what is broadcast are their centres,
bounded by `CENTRE_BYTES`, and beyond that bound lists grow longer instead.  A list is cut
into blocks of bounded bytes by hash, so a list with very many copies is scanned in many
tasks, and a block is scanned in slices of `PAIRS_AT_ONCE` pairs.  A row of another length
than the most common one is compared by the same scan with its own rotation, in one list.

Zero vectors take no part; see `vectors` for the other cases.
"""

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datakiln.jobs import scratch
from datakiln.llm import vectors

#: The sample that centres are fitted on, the queries asked of it, and the rows of it that a list needs at least.
FIT_ROWS, FIT_QUERIES, FIT_ROWS_A_LIST = 20_000, 400, 16
#: Bytes of centres that are broadcast at most, and rows whose nearest centres are sought at once.
CENTRE_BYTES, ROWS_AT_ONCE = 16 << 20, 1024
RECALL = 0.97
COLUMNS_A_BLOCK = 16
WIDTH = 2.1
#: Added to every bound on a squared distance of unit vectors: far above the rounding of doubles, so copies are not lost.
ROUNDING = 1e-9
#: Pairs whose distances grow together: 16 columns of both sides of so many pairs take 32 MB.
PAIRS_AT_ONCE = 1 << 17
SEED = 7


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, also where squares would overflow or vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def owners(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each unit row, some rows at a time."""
    return np.concatenate([(rows[at : at + ROWS_AT_ONCE] @ centres.T).argmax(axis=1) for at in range(0, len(rows), ROWS_AT_ONCE)] or [np.empty(0, int)])


def lists_for(rows: int, sample: int, dim: int) -> int:
    """How many lists: the square root of the rows, within what the sample can fit and what may be broadcast."""
    return max(1, min(isqrt(rows), sample // FIT_ROWS_A_LIST, CENTRE_BYTES // (8 * dim)))


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        owner = owners(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        empty = ~sums.any(axis=1)
        sums[empty] = centres[empty]
        centres = unit(sums)
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The least number of lists that hold ``recall`` of the true neighbours of sampled queries."""
    asked = sample[:FIT_QUERIES]
    scores = asked @ sample.T
    np.fill_diagonal(scores, -np.inf)
    near = np.argpartition(-scores, min(k, len(sample) - 1) - 1, axis=1)[:, :k]
    owner = owners(sample, centres)
    order = np.argsort(-(asked @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(asked), axis=0), axis=1)
    depth = np.sort(np.take_along_axis(place, owner[near], axis=1).ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1


def cosine(a: np.ndarray, b: np.ndarray, unit_a: np.ndarray, unit_b: np.ndarray) -> np.ndarray:
    """Cosine of the original vectors, row by row; by way of the scaled ones where squares overflow or vanish."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore", under="ignore"):
        direct = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    return np.where(np.isfinite(direct), direct, (unit_a * unit_b).sum(axis=1))


def scan(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs of rotated unit vectors that no hypothesis test has abandoned."""
    n, dim = rows.shape
    first = min(n, max(4 * k, 64))
    exact = 2 - 2 * queries @ rows[:first].T
    exact[own[:, :first]] = np.inf
    radius = np.maximum(np.partition(exact, min(k, first) - 1, axis=1)[:, min(k, first) - 1], 0)
    sure = np.zeros_like(own)
    sure[:, :first] = exact <= radius[:, None]
    asked, row = np.nonzero(~own)
    partial = np.zeros(len(asked))
    for start in range(0, dim, COLUMNS_A_BLOCK):
        end = min(dim, start + COLUMNS_A_BLOCK)
        if start == 0:
            head = (queries[:, :end] ** 2).sum(axis=1)[:, None] + (rows[:, :end] ** 2).sum(axis=1)[None, :] - 2 * queries[:, :end] @ rows[:, :end].T
            partial = head[asked, row]
        else:
            partial = partial + ((queries[asked, start:end] - rows[row, start:end]) ** 2).sum(axis=1)
        slack = (1 + WIDTH / np.sqrt(end)) ** 2 if end < dim else 1 + 1e-9
        alive = (partial * (dim / end) <= radius[asked] * slack + ROUNDING) | sure[asked, row]
        asked, row, partial = asked[alive], row[alive], partial[alive]
    return asked, row


def search_block(k: int):
    """For one block of a list and one block of queries: the best k candidates of each query."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("vec_id")  # nulls last, so ties go to the smaller id
        numbers, askers = left.column("row").to_numpy(), right.column("row").to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(numbers) and len(askers):
            rows, queries = vectors.matrix(left), vectors.matrix(right)
            turn = rotation(rows.shape[1])
            unit_rows, unit_queries = unit(rows), unit(queries)
            turned_rows, turned_queries = unit_rows @ turn, unit_queries @ turn
            for at in vectors.slices(len(askers), len(numbers), PAIRS_AT_ONCE):
                asked, row = scan(turned_queries[at], turned_rows, askers[at, None] == numbers[None, :], k)
                score = np.empty(len(asked))
                step = max(1, COLUMNS_A_BLOCK * PAIRS_AT_ONCE // 4 // rows.shape[1])
                for a in range(0, len(asked), step):
                    some = slice(a, a + step)
                    q = asked[some] + at.start
                    score[some] = cosine(queries[q], rows[row[some]], unit_queries[q], unit_rows[row[some]])
                order = np.lexsort((row, -score, asked))
                asked, row, score = asked[order] + at.start, row[order], score[order]
                first = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
                found.append((asked[first], row[first], score[first]))
        asked, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"asked": askers[asked], "query_id": right.column("vec_id").take(pa.array(asked, pa.int64())), "vec_id": left.column("vec_id").take(pa.array(row, pa.int64())), "score": score})

    return run


def assign(rows: DataFrame, centres: np.ndarray, probes: int, sizes: dict[int, int] | None = None, least: int = 0) -> DataFrame:
    """``rows`` with ``list``: one row for each of the ``probes`` nearest centres.

    With ``sizes`` (rows of each list) as many more as it takes to meet ``least`` rows.
    """
    held = np.array([(sizes or {}).get(i, 0) for i in range(len(centres))])
    shipped = rows.sparkSession.sparkContext.broadcast((centres, held))

    @F.arrow_udf("array<int>")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c, held = shipped.value
        for batch in batches:
            lengths = batch.value_lengths().to_numpy(zero_copy_only=False)
            lists = [[0]] * len(batch)
            fit = np.flatnonzero(lengths == c.shape[1])
            for some in np.array_split(fit, -(-len(fit) // ROWS_AT_ONCE)) if len(fit) else []:
                v = unit(batch.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1))
                if probes == 1 and not least:
                    chosen = owners(v, c)[:, None]
                    depth = np.ones(len(some), int)
                else:
                    chosen = np.argsort(-(v @ c.T), axis=1, kind="stable")
                    depth = np.maximum(probes, (held[chosen].cumsum(axis=1) < least).sum(axis=1) + 1)
                for i, mine, n in zip(some.tolist(), chosen.tolist(), depth.tolist(), strict=True):
                    lists[i] = mine[:n]
            yield pa.array(lists, pa.list_(pa.int32()))

    return rows.withColumn("lists", nearest("v")).withColumn("list", F.explode("lists")).drop("lists")


def nearest_neighbours(rows: DataFrame, is_query: str, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query`` (SQL over vec_id) holds."""
    whole = scratch.save(vectors.valid(rows, key, vector, nonzero=True), "vectors")
    common = whole.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    n, dim = (common["count"], common["dim"]) if common else (0, 1)
    taken = vectors.sampled(whole.filter(F.col("dim") == dim), n, FIT_ROWS, "row").select("v").toArrow()
    if taken.num_rows > k:
        sample = unit(vectors.matrix(taken))
        centres = fit_centres(sample, lists_for(n, len(sample), dim))
        probes = probes_needed(sample, centres, k)
    else:
        centres, probes = np.eye(1, dim), 1
    owned = scratch.save(assign(whole, centres, 1), "lists")
    held = owned.filter(F.col("dim") == dim).groupBy("list").count()  # as many rows as centres
    queries = whole.filter(is_query).filter("vec_id is not null")
    asked = assign(queries, centres, probes, {r["list"]: r["count"] for r in held.collect()}, k + 1)
    h = F.xxhash64("row")
    room = F.greatest(F.lit(64), F.floor(vectors.BLOCK_BYTES / (8 * F.col("dim"))))  # rows of a block
    sizes = owned.groupBy("list", "dim").agg(F.ceil(F.count("*") / room).cast("int").alias("parts"))
    askers = scratch.save(asked, "askers")
    loads = askers.groupBy("list", "dim").agg(F.ceil(F.count("*") / room).cast("int").alias("blocks"))
    plan = sizes.join(loads, ["list", "dim"])  # one row for each list and length
    left = owned.join(plan, ["list", "dim"]).withColumns({"part": F.pmod(h, F.col("parts")).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    right = askers.join(plan, ["list", "dim"]).withColumns({"block": F.pmod(h, F.col("blocks")).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    keys = ["list", "dim", "part", "block"]
    columns = [*keys, "row", "vec_id", "v"]
    found = left.select(*columns).groupBy(*keys).cogroup(right.select(*columns).groupBy(*keys)).applyInArrow(search_block(k), "asked long, query_id long, vec_id long, score double")
    return vectors.best(found, k)
