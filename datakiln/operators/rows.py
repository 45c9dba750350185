"""Selecting, editing and sampling rows.

Predicates are columns.  The rules treat null as "not true" on both sides: `select_rows`
keeps what is true, `skip_rows` drops only what is true.
"""

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datakiln.functions.casts import nullify
from datakiln.jobs import scratch
from datakiln.operators.headers import unused
from datakiln.operators.row_index import with_row_number


def select_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true."""
    return df.filter(predicate)


def skip_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """All rows but those for which the predicate is true; null keeps a row."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def skip_counted(df: DataFrame, predicate: Column, name: str = "skip", table: str | None = None, only: str | None = None) -> tuple[DataFrame, Observation]:
    """`skip_rows`, with an observation of the rows ``skipped`` and ``passed``, free of a second pass.

    A step that is meant for ``only`` one destination lets all rows of another ``table`` pass.
    """
    if only is not None and table != only:
        predicate = F.lit(False)
    seen, hit = Observation(name), F.coalesce(predicate, F.lit(False))
    counted = df.observe(seen, F.count_if(hit).alias("skipped"), F.count_if(~hit).alias("passed"))
    return counted.filter(~hit), seen


def split_matching(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """All rows, and beside them those that match."""
    return df, df.filter(predicate)


def not_equal(a: Column, b: Column) -> Column:
    """Inequality in which null differs from every value and equals null."""
    return ~a.eqNullSafe(b)


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, in the order of ``df``."""
    return df.select(*[c for c in df.columns if c in set(names)])


def delete_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def add_columns(df: DataFrame, new: dict[str, Column] | list[str]) -> DataFrame:
    """New columns at the end; a list adds columns of nulls."""
    made = new if isinstance(new, dict) else {name: F.lit(None).cast("string") for name in new}
    return df.withColumns(made)


def expand(df: DataFrame, names: tuple[str, ...], made: Column) -> DataFrame:
    """One array or struct expression spread over several new columns."""
    kind = df.select(made.alias("x")).schema["x"].dataType
    if isinstance(kind, T.StructType):
        parts = [made[f] for f in kind.fieldNames()]
    else:
        parts = [F.get(made, F.lit(i)) for i in range(len(names))]
    return df.withColumns(dict(zip(names, parts, strict=True)))


def edit(df: DataFrame, edits: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Columns replaced by a function of themselves; all edits see the input values."""
    if missing := set(edits) - set(df.columns):
        raise KeyError(f"no columns {sorted(missing)}")
    return df.withColumns({name: f(F.col(name)) for name, f in edits.items()})


def add_delete_expand(
    df: DataFrame,
    delete: list[str] = (),
    edits: dict[str, Callable[[Column], Column]] | None = None,
    add: dict[str, Column] | None = None,
    spread: dict[tuple[str, ...], Column] | None = None,
) -> DataFrame:
    """Edits, additions and expansions, all from the input values, and deletions, in one projection."""
    edits = edits or {}
    kept = [edits[c](F.col(c)).alias(c) if c in edits else F.col(c) for c in df.columns if c not in set(delete)]
    new = [made.alias(name) for name, made in (add or {}).items()]
    for names, made in (spread or {}).items():
        new += [F.get(made, F.lit(i)).alias(n) for i, n in enumerate(names)]
    return df.select(*kept, *new)


def slice_positions(spec: str, width: int) -> list[int]:
    """Positions named by ranges and single places such as ``2:3,7,10:12,-1``; they may repeat."""
    found: list[int] = []
    for part in spec.replace(" ", "").split(","):
        if ":" in part:
            start, end, *step = (int(x) if x else None for x in part.split(":"))
            found += list(range(width))[slice(start, end, *step)]
        else:
            at = int(part)
            if not -width <= at < width:
                raise IndexError(f"no column at {at} among {width}")
            found.append(at % width)
    return found


def slice_columns(df: DataFrame, spec: str) -> DataFrame:
    """Columns by position; the second and later use of a column gets its new position in its name."""
    used: set[str] = set()
    out = []
    for place, at in enumerate(slice_positions(spec, len(df.columns)), 1):
        name = df.columns[at]
        out.append(F.col(name).alias(f"{name}_{place}" if name in used else name))
        used.add(name)
    return df.select(*out)


def nullify_blanks(df: DataFrame) -> DataFrame:
    """Text columns stripped, blanks as nulls."""
    return df.withColumns({f.name: nullify(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)})


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def sample_positions(count: int = 20, skip: int = 5, est_length: int = 10_000) -> list[int]:
    """``count`` row places that grow apart exponentially, so that the last lies near the estimated length.

    After each place the step grows by one factor; the next place is the next multiple of
    the whole part of the step.
    """
    if count < 1:
        return []
    factor = math.exp(math.log(est_length / skip) / max(count - 1, 1))
    places, step = [0], float(skip)
    while len(places) < count:
        step *= factor
        every = max(1, int(step))
        places.append((places[-1] // every + 1) * every)
    return places


def sample(df: DataFrame, order: list[str], count: int = 20, skip: int = 5, est_length: int = 10_000) -> DataFrame:
    """The rows at `sample_positions` of a total order.

    Only the first rows can be taken, up to the last place.  Where the first column of the order
    is a number or a time, a quantile of it leaves about twice as many before they are sorted,
    so no task gathers that many of every partition.
    """
    places, at = sample_positions(count, skip, est_length), unused("_at", df.columns)
    wanted = max(places, default=-1) + 1
    first = first_rows(df, order, wanted)
    return with_row_number(first, order, at, 0).filter(F.col(at).isin(places)).drop(at)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in a total order."""
    lead, whole = F.col(order[0]), df.count()
    if whole > 20 * n and isinstance(df.schema[order[0]].dataType, T.NumericType | T.DateType | T.TimestampType):
        bound = df.agg(F.percentile_approx(lead, F.lit(2 * n / whole), 100 * whole // n)).first()[0]
        few = df.filter(lead.isNull() | (lead <= F.lit(bound)))
        if bound is not None and few.limit(n).count() == n:
            df = few
    return df.orderBy(*order).limit(n)


def systematic_sample(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Every (count / n)-th id, at most n rows; the first n of a table of 100 rows or less."""
    count = df.count()
    chosen = df if count <= 100 else df.filter(F.col(key) % (count // n) == 0)
    return chosen.orderBy(key).limit(n)


def where_equal(df: DataFrame, filters: dict[str, object], columns: list[str] | None = None) -> DataFrame:
    """Equality filters joined by "and", then the named columns."""
    tests = [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in filters.items()]
    kept = df.filter(reduce(and_, tests)) if tests else df
    return kept.select(*columns) if columns else kept


def fold(df: DataFrame, sums: list[str] = (), least: list[str] = (), most: list[str] = ()) -> DataFrame:
    """Sums, minima and maxima over all rows in one row: folds that are associative."""
    made = [F.sum(c).alias(f"sum_{c}") for c in sums] + [F.min(c).alias(f"min_{c}") for c in least] + [F.max(c).alias(f"max_{c}") for c in most]
    return df.agg(*made)


#: States that are merged into one at a time, and keys that a task holds before it passes their states on.
FAN_IN, KEYS_HELD = 64, 10_000


def tree_fold(df: DataFrame, keys: list[str], value: str, start: Callable[[], object], add: Callable[[object, object], object], merge: Callable[[object, object], object], kind: str, name: str = "state") -> DataFrame:
    """(keys…, state): the values of each key folded by functions of the user, into a state of SQL type ``kind``.

    ``add`` takes a state and a value, ``merge`` two states.  Each task folds its rows as they
    come, batch by batch; then states are merged `FAN_IN` at a time, round by round, so a key
    however hot takes a number of rounds that grows with the logarithm of the tasks and no
    task holds more than that many states of it.  The order of rows is not kept: it must not
    matter how values are dealt to states nor in which order states are merged
    (``merge`` associative and commutative, ``add(merge(a, b), x) = merge(a, add(b, x))``,
    ``start()`` neutral).  A state must fit a task.  Null values are values; an empty table
    without keys gives no row.
    """
    import pyarrow as pa

    kept = df.select(*keys, F.col(value).alias(unused(value, keys)))
    made = T.StructType([*[df.schema[k] for k in keys], T.StructField(name, T._parse_datatype_string(kind))])
    arrow = pa.schema(list(zip(made.fieldNames(), _arrow_types(made), strict=True)))

    def states(held: dict[tuple, object]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(made.fieldNames(), (*k, s), strict=True)) for k, s in held.items()], arrow)

    def partial(batches):
        held: dict[tuple, object] = {}
        for batch in batches:
            for *key, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = tuple(key)
                held[k] = add(held[k] if k in held else start(), x)
                if len(held) > KEYS_HELD:
                    yield states(held)
                    held = {}
        yield states(held)

    def merged(group):
        state = reduce(merge, [_plain(x, arrow.field(name).type) for x in group.column(name).to_pylist()])
        return pa.Table.from_batches([states({tuple(group.column(k)[0].as_py() for k in keys): state})])

    now = scratch.save(kept.mapInArrow(partial, made), "states")
    nth, parts = unused("_nth", made.fieldNames()), unused("_parts", made.fieldNames())
    while True:
        counted = now.groupBy(*keys).agg(F.count("*").alias(parts))
        most = counted.agg(F.max(parts)).first()[0] or 0
        if most <= 1:
            return now
        numbered = scratch.save(now.withColumn(nth, F.monotonically_increasing_id()), "numbered")
        named = counted.select(*[F.col(k).alias(f"{k}_of_state") for k in keys], F.ceil(F.col(parts) / FAN_IN).alias(parts))
        met = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_of_state")) for k in keys]) if keys else F.lit(True)
        dealt = numbered.join(named if keys else F.broadcast(named), met).withColumn(nth, F.pmod(F.xxhash64(nth), F.col(parts))).select(*made.fieldNames(), nth)
        now = scratch.save(dealt.groupBy(*keys, nth).applyInArrow(merged, made), "states")


def _plain(state: object, kind: object) -> object:
    """A map that comes from Arrow as pairs, as a dict."""
    import pyarrow as pa

    return dict(state) if pa.types.is_map(kind) and not isinstance(state, dict) and state is not None else state


Step = Callable[[DataFrame], DataFrame]


def edited_steps(steps: dict[str, Step], changes: dict[str, Step | None]) -> dict[str, Step]:
    """A pipeline of named steps with changes: ``+name`` appends, ``-name`` prepends, ``!name`` replaces or (None) removes."""
    made = dict(steps)
    for key, step in changes.items():
        mark, name = key[0], key[1:]
        if mark == "+":
            made[name] = step
        elif mark == "-":
            made = {name: step} | made
        elif mark == "!":
            if name not in made:
                raise KeyError(f"no step {name}")
            made = {k: (step if k == name else v) for k, v in made.items() if k != name or step is not None}
        else:
            raise ValueError(f"{key!r} starts with none of + - !")
    return made


def steps_for(changes: dict[str, dict[str, Step | None]], phase: str, source_table: str = "", table: str = "", source: str = "") -> dict[str, Step | None]:
    """The changes that a configuration names for a phase: those of its source table, else its table, else its source, else the phase alone."""
    for key in (f"{phase}-{source_table}", f"{phase}-{table}", f"{phase}-{source}", phase):
        if key in changes:
            return changes[key]
    return {}


def configured(phases: dict[str, dict[str, Step]], changes: dict[str, dict[str, Step | None]], source_table: str = "", table: str = "", source: str = "") -> dict[str, dict[str, Step]]:
    """Each phase's steps with the changes that the configuration has for the source at hand."""
    return {phase: edited_steps(steps, steps_for(changes, phase, source_table, table, source)) for phase, steps in phases.items()}


def run_steps(df: DataFrame, steps: dict[str, Step]) -> DataFrame:
    for step in steps.values():
        df = df.transform(step)
    return df


def modify(df: DataFrame, f: Callable[[dict], dict | None], schema: T.StructType) -> DataFrame:
    """Rows as dicts through a user's function (None drops a row), in Arrow batches.

    For code that no column expression says; everything else should be one.
    """
    import pyarrow as pa

    arrow = pa.schema([(name, kind) for name, kind in zip(schema.fieldNames(), _arrow_types(schema), strict=True)])

    def run(batches):
        for batch in batches:
            made = [r for r in map(f, batch.to_pylist()) if r is not None]
            yield pa.RecordBatch.from_pylist(made, arrow)

    return df.mapInArrow(run, schema)


def _arrow_types(schema: T.StructType) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


def observed(df: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """``df`` with an observation of its ``rows``, known once an action has run; divided by its seconds it is the rate."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows")), seen


@dataclass
class Run:
    """The rows of a run and the seconds that it took."""

    rows: int = 0
    seconds: float = 0.0

    @property
    def rate(self) -> float:
        """Rows a second; 0 for a run that took no time."""
        return self.rows / self.seconds if self.seconds else 0.0


def measured_run(df: DataFrame, action: Callable[[DataFrame], object], name: str = "run") -> Run:
    """What an action on ``df`` (a write, say) took: its rows are counted on the way, not by a pass of their own."""
    counted, seen = observed(df, name)
    start = time.perf_counter()
    action(counted)
    return Run(seen.get["rows"], time.perf_counter() - start)
