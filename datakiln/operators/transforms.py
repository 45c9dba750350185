"""Staged, declarative column transforms: from source rows to a declared table.

A transform string has stages between semicolons and pipes between strokes.  ``^name`` is
an initialiser (once, first stage), ``!name`` handles what a stage could not compute (once
each stage).  Stages run over all columns at once: stage k of a column sees stage k - 1 of
every other one.  In the first stage the order is initialiser, parse to the data type,
pipes.  What cannot be parsed stays failed through later pipes; the raw value is at hand as
``row.column.failed_value`` and is reported at the end unless it was cleared.

A column with a value type is read by that type (a share above one, say, fails), and later
stages may ask for attributes of its value: ``row.rate.percent``, ``row.margin.se`` or,
where a table of the value's attributes is linked, ``row.state.name``.  A pipe in braces is
a SQL expression over the value ``v`` and the columns of the stage: ``{v * 3}``,
``{upper(row.name)}``; it may hold no semicolon or stroke.

A stage is one projection of built-in expressions; Catalyst folds them into few.
"""

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datakiln.functions import casts, values, valuetypes
from datakiln.operators.headers import TYPES, ColumnSpec, TableSpec, unused
from datakiln.operators.row_index import prefix_scan, with_row_number

ARGUMENTS = ("v", "row", "row_n", "header_s", "header_d", "i_s", "i_d", "source", "bundle", "scratch", "errors", "accumulator")

#: Attributes that a stage may ask of another column's value, whatever its type.
ATTRIBUTES: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "start": lambda c: values.range_years(c)["y1"], "end": lambda c: values.range_years(c)["y2"], "dotted": values.tract_dotted, "rate": values.percent_rate,
}



def _standard_error(c: Column, parameters: tuple[str, ...]) -> Column:
    """The standard error that a margin of so many percent (90, if none is named) stands for."""
    return values.margin_to_se(c, int(parameters[-1]) if parameters else 90)


#: Attributes by the value type, given the value and the type's parameters.
TYPED: dict[str, dict[str, Callable[[Column, tuple[str, ...]], Column]]] = {
    "margin": {"se": _standard_error} | {f"m{n}": (lambda c, p, n=n: values.se_to_margin(_standard_error(c, p), n)) for n in (90, 95, 99)},
    "se": {f"m{n}": (lambda c, p, n=n: values.se_to_margin(c, n)) for n in (90, 95, 99)},
    "rate": {"percent": lambda c, p: c * 100}, "proportion": {"percent": lambda c, p: c * 100},
    "pct": {"rate": lambda c, p: c / 100}, "percent": {"rate": lambda c, p: c / 100}, "pctl": {"rate": lambda c, p: c / 100}, "percentile": {"rate": lambda c, p: c / 100},
    **{code: {part: (lambda c, p, part=part: values.geo_parts(c)[part]) for part in ("state", "county", "tract")} for code in valuetypes.REGISTRY if code.startswith("geoid")},
    "year": {"start": lambda c, p: c, "end": lambda c, p: c + 1},
}

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "upper": F.upper, "lower": F.lower, "title": values.title, "strip": casts.stripped, "nullify": casts.nullify, "dequote": values.dequote, "parse_int": casts.parse_int, "parse_float": casts.parse_float, "clean_int": casts.clean_int, "clean_float": casts.clean_float, "int_cut": casts.int_cut, "nan_is_null": casts.nan_is_null, "excel_date": casts.excel_date, "percent": values.percent, "share": values.share, "range_text": values.range_text, "row_number": lambda row_n: row_n,
}


@dataclass
class Stage:
    """One stage of one column."""

    init: str | None = None
    pipes: list[str] = field(default_factory=list)
    handler: str | None = None


def parsed(transform: str) -> list[Stage]:
    """The stages of a transform string; a second initialiser, a late one or a second handler is an error."""
    stages = []
    for place, text in enumerate(transform.split(";")):
        stage = Stage()
        for part in filter(None, (p.strip() for p in text.split("|"))):
            if part[0] == "^":
                if place or stage.init:
                    raise ValueError(f"only one initialiser, and only in the first stage: {transform!r}")
                stage.init = part[1:]
            elif part[0] == "!":
                if stage.handler:
                    raise ValueError(f"more than one handler in a stage: {transform!r}")
                stage.handler = part[1:]
            else:
                stage.pipes.append(part)
        stages.append(stage)
    return stages


def normal_form(transform: str) -> str:
    """Initialiser, pipes, handler in each stage; empty stages stay."""
    return ";".join("|".join([*([f"^{s.init}"] if s.init else []), *s.pipes, *([f"!{s.handler}"] if s.handler else [])]) for s in parsed(transform))


class RowView:
    """Columns of the stage before by name, for functions that ask for ``row``."""

    def __init__(self, columns: dict[str, Column]) -> None:
        self._columns = columns

    def __getitem__(self, name: str) -> Column:
        if name not in self._columns:
            raise KeyError(f"no column {name!r} at this stage; there are {', '.join(self._columns)}")
        return self._columns[name]

    __getattr__ = __getitem__


def called(name: str, known: dict[str, Callable[..., Column]], context: dict[str, object], failed: dict[str, Column]) -> Column:
    """The column that a pipe makes: ``row.column[.attribute]`` or a function given the arguments it names."""
    if m := re.fullmatch(r"row\.(\w+)(?:\.(\w+))?", name):
        other, attribute = m.groups()
        if attribute == "failed_value":
            return failed[other]
        value = context["row"][other]
        if attribute is None:
            return value
        linked, kind = context["linked"].get(other), context["kinds"].get(other)
        if linked is not None:
            return F.col(linked)[attribute]
        typed = TYPED.get(kind.registered, {}) if kind else {}
        if attribute in typed:
            return typed[attribute](value, kind.parameters)
        if attribute not in ATTRIBUTES:
            raise KeyError(f"no attribute {attribute!r}; known are {', '.join([*typed, *ATTRIBUTES])}")
        return ATTRIBUTES[attribute](value)
    if name not in known:
        raise KeyError(f"no transform {name!r}")
    wanted = list(inspect.signature(known[name]).parameters.values())
    given, taken = [], 0
    for p in wanted:
        if p.name in ARGUMENTS:
            given.append(context[p.name])
        elif taken == 0 and not given:
            given.append(context["v"])
            taken = 1
        elif p.default is inspect.Parameter.empty and p.kind is not inspect.Parameter.VAR_KEYWORD:
            raise TypeError(f"transform {name!r} asks for unknown argument {p.name!r}")
    return known[name](*given)


def asks_for_row(stage: Stage, known: dict[str, Callable[..., Column]]) -> bool:
    """Whether a function of the stage takes the row number or an accumulator along the rows."""
    named = [n for n in (stage.init, *stage.pipes, stage.handler) if n in known]
    return any(p in ("row_n", "accumulator") for n in named for p in inspect.signature(known[n]).parameters)


def expressed(text: str, value: str) -> Column:
    """A SQL expression in which ``v`` is the column ``value`` and ``row.name`` a column of the stage; quoted text is left alone."""
    parts = re.split(r"('(?:[^']|'')*')", text)
    named = [p if i % 2 else re.sub(r"\brow\.(\w+)", r"`\1`", re.sub(r"(?<![\w.])v(?!\w)", f"`{value}`", p)) for i, p in enumerate(parts)]
    return F.expr("".join(named))


def cast_columns(
    df: DataFrame, table: TableSpec, functions: dict[str, Callable[..., Column]] | None = None, order: list[str] | None = None,
    source: object = "", bundle: object = None, linked: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """The rows of ``df`` as rows of ``table``, with ``_errors``: array<struct<column, value>> of failed values.

    A column that the source lacks is null, but for a key in the first column without a
    transform: it gets the row number.  Row numbers follow ``order``, a total order of ``df``,
    or else the order in which its rows come.  Columns of ``df`` may have any names.  Functions may ask for ``source`` and ``bundle`` as
    they are given here, for ``scratch``, a dict that all calls share while the plan is made,
    for ``errors``, the raw text that failed so far, and for ``accumulator``, which carries a
    value along the rows in the order of their numbers.  ``linked`` maps a value type to a
    table whose first column is the value and whose others are its attributes.
    """
    known = FUNCTIONS | (functions or {})
    specs = sorted(table.columns.values(), key=lambda c: c.position)
    texts = {c.name: c.transform or "" for c in specs}
    first = specs[0]
    if first.role == "k" and not texts[first.name] and first.name not in df.columns:
        texts[first.name] = "^row_number"
    plans = {name: parsed(text) for name, text in texts.items()}
    names, last = [c.name for c in specs], max(map(len, plans.values()))
    numbered = any("row_number" in (s.init or "") or "row_number" in s.pipes or asks_for_row(s, known) for plan in plans.values() for s in plan)
    at = unused("_row_n", [*df.columns, *names])
    if numbered:
        df = with_row_number(df, order, at)
    row_n = F.col(at) if numbered else F.lit(None).cast("bigint")
    failed_names = {n: unused(f"_failed_{n}", [*df.columns, *names]) for n in names}
    failed_name = failed_names.__getitem__
    shared = {"row_n": row_n, "at": at, "source": source, "bundle": bundle, "scratch": {}, "kinds": {c.name: valuetypes.resolved(c.valuetype) for c in specs if c.valuetype}}
    joined: dict[str, str] = {}
    for k in range(last):
        source_stage = k == 0
        stage_columns = df.columns if source_stage else names
        here = {c: F.col(c) for c in stage_columns}
        failed_here = {} if source_stage else {n: F.col(failed_name(n)) for n in names}
        holder = _Rows(df)
        out = []
        for i, spec in enumerate(specs):
            value, failed = _stage(spec, plans[spec.name], k, here, failed_here, known, shared | {"linked": joined}, i, df.schema, holder)
            out += [value.alias(spec.name), failed.alias(failed_name(spec.name))]
        df = holder.df.select(*out, *([at] if numbered else []), *joined.values())
        if source_stage and last > 1:
            for spec in specs:
                if (rows := (linked or {}).get(spec.valuetype)) is not None:
                    key, *attributes = rows.columns
                    joined[spec.name], of = unused(f"_linked_{spec.name}", df.columns), unused("_linked_key", df.columns)
                    # a key that repeats names its least row, so it never multiplies rows
                    named = rows.groupBy(F.col(key).alias(of)).agg(F.min(F.struct(*attributes)).alias(joined[spec.name]))
                    df = df.join(named, F.col(spec.name) == F.col(of), "left").drop(of)
    each = F.array(*[F.struct(F.lit(n).alias("column"), F.col(failed_name(n)).alias("value")) for n in names])
    any_failed = F.coalesce(*[F.col(failed_name(n)) for n in names]).isNotNull()  # most rows have none and skip the rest
    errors = F.filter(F.when(any_failed, each).otherwise(F.slice(each, 1, 0)), lambda e: e["value"].isNotNull())
    final = [F.col(c.name).try_cast(TYPES[c.datatype]).alias(c.name, metadata=c.field().metadata) for c in specs]
    return df.select(*final, errors.alias("_errors"))


class Accumulator:
    """What a transform may carry along the rows in their order: ``accumulator("greatest", v)``, or another scan of `row_index.SCANS`."""

    def __init__(self, rows: "_Rows", at: str) -> None:
        self.rows, self.at = rows, at

    def __call__(self, scan: str, value: Column) -> Column:
        name = unused("_scanned", self.rows.df.columns)
        self.rows.df = prefix_scan(self.rows.df, [], [self.at], {name: (scan, value)})
        return F.col(name)


class _Rows:
    """The rows of a stage, to which a pipe may add its value under a name that SQL text can say."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def named(self, value: Column) -> str:
        name = unused("_value", self.df.columns)
        self.df = self.df.withColumn(name, value)
        return name


def _stage(spec: ColumnSpec, plan: list[Stage], k: int, here: dict, failed_here: dict, known: dict, shared: dict, i_d: int, found: T.StructType, rows: _Rows) -> tuple[Column, Column]:
    """Value and failed raw text of one column after stage k."""
    null_text = F.lit(None).cast("string")
    stage = plan[k] if k < len(plan) else Stage()
    source_names = found.fieldNames()
    raw = here.get(spec.name, F.lit(None).cast("string"))
    context = shared | {"v": raw, "row": RowView(here), "header_s": spec.name if spec.name in source_names else None, "header_d": spec.name, "i_s": source_names.index(spec.name) if spec.name in source_names else None, "i_d": i_d, "accumulator": Accumulator(rows, shared["at"])}
    failed, value = failed_here.get(spec.name, null_text), raw

    def made_by(pipe: str, value: Column, failed: Column) -> Column:
        if m := re.fullmatch(r"\{(.*)\}", pipe, re.DOTALL):
            return expressed(m.group(1), rows.named(value))
        return called(pipe, known, context | {"v": value, "errors": failed}, failed_here)

    if k == 0:
        if stage.init:
            value = made_by(stage.init, value, failed)
        before, kind = value, shared["kinds"].get(spec.name)
        if kind and kind.read:
            value = kind.read(value.cast("string"))
            failed = casts.failed_value(before, value)
        elif spec.datatype not in ("str", "text", "unknown"):
            typed = found[spec.name].dataType if spec.name in source_names and not stage.init else T.StringType()
            value = casts.cast_typed(value, spec.datatype, typed)
            failed = casts.failed_value(before, value)
        elif spec.datatype != "unknown":
            value = casts.to_text(value)
    start = raw
    for pipe in stage.pipes:
        if pipe == "clear_error":
            failed = null_text
            continue
        made = made_by(pipe, value, failed)
        value = made if pipe.startswith("row.") else F.when(failed.isNull(), made)
    if stage.handler:
        handled = F.lit(None) if stage.handler == "ignore" else called(stage.handler, known, context | {"v": start, "errors": failed}, failed_here)
        value, failed = F.coalesce(value, handled), null_text
    return value, failed


def error_report(cast: DataFrame) -> DataFrame:
    """(column, value, rows): what failed to cast and how often."""
    # not explode: the size test that Spark infers from it would repeat all casts in a filter
    each = cast.select(F.explode_outer("_errors").alias("e")).filter("e is not null").select("e.*")
    return each.groupBy("column", "value").agg(F.count("*").alias("rows"))


def checked(cast: DataFrame, most_distinct: int = 0) -> DataFrame:
    """``cast`` without ``_errors``; an error if any column has more distinct failed values than allowed."""
    found = error_report(cast).groupBy("column").agg(F.count("*").alias("n")).filter(F.col("n") > most_distinct).orderBy("column").limit(20).collect()
    if found:
        raise ValueError("values that failed to cast: " + ", ".join(f"{r.column} ({r.n})" for r in found))
    return cast.drop("_errors")
