"""Gap-free row numbers without gathering rows in one task.

Rows are sorted by range, each range counts its own rows, and the counts before a range
are added to the numbers inside it.  The sorted rows are saved once, so both passes see
the same ranges whatever executor is lost in between.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datakiln.jobs import scratch
from datakiln.operators.headers import unused


def with_row_number(df: DataFrame, order: list[str | Column] | None = None, name: str = "id", start: int = 1) -> DataFrame:
    """``df`` with ``name``: start, start + 1, … in the total order ``order``, or as its rows come.

    The order must be total, else rows that tie share an undefined order.  Without one nothing
    is sorted: rows keep the order in which they are saved.  A column of that name in ``df`` is
    replaced; other columns may have any names.
    """
    kept = df.drop(name)
    part, place, n, first, before = helpers = [unused(h, [*kept.columns, name]) for h in ("_range", "_place", "_n", "_first", "_before")]
    if len({h.lower() for h in helpers}) < len(helpers):
        raise ValueError(f"no distinct names beside {', '.join(kept.columns)}")
    dealt = kept
    if order is not None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = kept.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    marked = scratch.save(dealt.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}), "numbered")
    counts = marked.groupBy(part).agg(F.count("*").alias(n), F.min(place).alias(first))
    earlier = F.sum(n).over(Window.orderBy(part)) - F.col(n)  # one row for each range
    offsets = counts.select(F.col(part).alias(n), first, earlier.alias(before))
    joined = marked.join(F.broadcast(offsets), F.col(part) == F.col(n))  # as many rows as shuffle or input partitions
    number = F.col(place) - F.col(first) + F.col(before) + start
    return joined.select(number.alias(name), *kept.columns)


def _latest(c: Column, order: Column) -> Column:
    return F.max_by(c, F.when(c.isNotNull(), order))


#: Scans by name: how a range folds its own rows (given their order), and how a window goes on from what came before.
SCANS: dict[str, tuple[Callable[[Column, Column], Column], Callable[[Column], Column]]] = {
    "sum": (lambda c, order: F.sum(c), F.sum), "least": (lambda c, order: F.min(c), F.min), "greatest": (lambda c, order: F.max(c), F.max),
    "every": (lambda c, order: F.bool_and(c), F.bool_and), "some": (lambda c, order: F.bool_or(c), F.bool_or), "last": (_latest, lambda c: F.last(c, ignorenulls=True)),
}


def prefix_scan(df: DataFrame, keys: list[str], order: list[str], made: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with, for each name in ``made``, what a scan (`SCANS`) of its column gives over the rows of the same keys up to this one.

    A key with very many rows is cut over several sorted ranges: each range folds its own
    rows and starts from what the key's earlier ranges gave, so no task gathers a key.  That
    takes an associative function; its arguments keep their order.  Nulls are passed over
    (where nothing else came yet the result is null; sums start from 0).  Null keys are a
    key of their own.  ``order`` (columns of ``df``) must be total within a key.
    """
    part, late = unused("_range", [*df.columns, *made]), unused("_late", [*df.columns, *made])
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({n: c for n, (_, c) in made.items()}).repartitionByRange(ranges, *keys, *order)
    marked = scratch.save(dealt.withColumn(part, F.spark_partition_id()), "ranges")
    place = F.struct(*order)
    held = marked.groupBy(part, *keys).agg(*[SCANS[kind][0](F.col(n), place).alias(n) for n, (kind, _) in made.items()])
    # a key has at most one row for each range here, so this window is small however hot the key
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = {n: SCANS[kind][1](F.col(n)).over(earlier) for n, (kind, _) in made.items()}
    zero = {n: F.coalesce(c, F.lit(0)) if made[n][0] == "sum" else c for n, c in carried.items()}
    before = held.select(part, *keys, *[c.alias(n) for n, c in zero.items()], F.lit(0).alias(late))
    inside = Window.partitionBy(part, *keys).orderBy(late, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = before.unionByName(marked.withColumn(late, F.lit(1)), allowMissingColumns=True)
    scanned = both.withColumns({n: SCANS[kind][1](F.col(n)).over(inside) for n, (kind, _) in made.items()})
    return scanned.filter(F.col(late) == 1).select(*[c for c in df.columns if c not in made], *made)


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of its value over the rows of the same keys up to this one."""
    return prefix_scan(df, keys, order, {n: ("sum", c) for n, c in sums.items()})


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "running") -> DataFrame:
    """An accumulator along the rows of each key, in a stated order; null values add nothing."""
    return prefix_sums(df, keys, order, {name: F.coalesce(F.col(value), F.lit(0))})


def scan_with(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, f: Callable[[object, object], object], kind: str) -> DataFrame:
    """As `prefix_scan`, with a function of the user over plain values, of SQL type ``kind``.

    ``f`` must be associative; it need not commute.  Nulls are passed over.  Each range is read in
    its order, once to fold each key's rows and once to go on from what the key's earlier
    ranges gave; a task holds one state and a batch of rows.
    """
    columns = [c for c in df.columns if c != name]
    names = [*columns, name]
    part, late, state = (unused(n, names) for n in ("_range", "_late", "_state"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(state, F.col(value).cast(kind)).repartitionByRange(ranges, *keys, *order)
    marked = scratch.save(dealt.withColumn(part, F.spark_partition_id()), "ranges")
    schema = lambda of: ", ".join(f"`{c}` {marked.schema[c].dataType.simpleString()}" for c in of)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list[bool]]]:
        """Each batch with the state after each of its rows, and whether a row ends a run of the same range and keys."""
        at, held = None, None
        for batch in batches:
            runs = list(zip(*(batch.column(c).to_pylist() for c in (part, *keys)), strict=True))
            states = []
            for run, x in zip(runs, batch.column(state).to_pylist(), strict=True):
                held = x if run != at or held is None else held if x is None else f(held, x)
                at = run
                states.append(held)
            yield batch, states, runs

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch, states, runs in running(batches):
            ends = [i for i, run in enumerate(runs[:-1]) if run != runs[i + 1]]
            found = ([last] if last and runs and runs[0] != last[0] else []) + [(runs[i], states[i]) for i in ends]
            if runs:
                last = (runs[-1], states[-1])
            if found:
                yield rows_of(batch, found)
        if last:
            yield rows_of(batch, [last])

    def rows_of(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        kinds = [batch.schema.field(c) for c in (part, *keys, state)]
        columns = list(zip(*((*run, held) for run, held in found), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

    def carried(group: pa.Table) -> pa.Table:
        group = group.select([part, *keys, state]).sort_by(part)
        out, held = [], None
        for x in group.column(state).to_pylist():
            out.append(held)
            held = x if held is None else held if x is None else f(held, x)
        return group.set_column(group.schema.get_field_index(state), group.schema.field(state), pa.array(out, group.schema.field(state).type))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, states, _ in running(batches):
            mine = pa.array([x == 1 for x in batch.column(late).to_pylist()])
            made = {c: batch.column(c) for c in columns} | {name: pa.array(states, batch.schema.field(state).type)}
            yield pa.RecordBatch.from_pydict(made).filter(mine)

    slim = marked.select(part, *keys, *[c for c in order if c not in keys], state)
    parts = slim.repartition(part).sortWithinPartitions(part, *keys, *order).mapInArrow(folded, schema([part, *keys, state]))
    # a key has at most one row for each range here
    by = parts.groupBy(*keys) if keys else parts.withColumn(late, F.lit(0)).groupBy(late)
    before = by.applyInArrow(carried, schema([part, *keys, state]))
    both = before.withColumn(late, F.lit(0)).unionByName(marked.withColumn(late, F.lit(1)), allowMissingColumns=True)
    out = ", ".join(filter(None, [schema(columns), f"`{name}` {marked.schema[state].dataType.simpleString()}"]))
    return both.repartition(part).sortWithinPartitions(part, *keys, late, *order).mapInArrow(finished, out)
