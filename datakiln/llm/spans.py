"""Spans in texts: struct<kind, start, end> in code points, end exclusive, ordered by start, then kind."""

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datakiln.llm.identity import numbered
from datakiln.operators.headers import unused

SPANS = "array<struct<kind:string,start:int,end:int>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def in_order(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """By start, then by the place of the kind in ``kinds``."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def merged(base: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the base spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in base:  # ordered by start; overlapping ones grow together
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def outside(places: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The places that overlap no base span, found by bisection so that long texts stay cheap."""
    starts, ends = merged(base)
    kept = []
    for kind, a, b in places:
        i = bisect_left(starts, b) - 1  # the last base span that starts before the end
        if i < 0 or ends[i] <= a:
            kept.append((kind, a, b))
    return kept


def left_over(places: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The pieces of each place that no base span covers."""
    starts, ends = merged(base)
    pieces = []
    for kind, a, b in places:
        i = bisect_right(ends, a)  # the first base span that ends after the start
        while i < len(starts) and starts[i] < b:
            if a < starts[i]:
                pieces.append((kind, a, starts[i]))
            a = max(a, ends[i])
            i += 1
        if a < b:
            pieces.append((kind, a, b))
    return pieces


def as_rows(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def ordered(spans: Column, kinds: tuple[str, ...]) -> Column:
    """An array of spans in order."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one stands, extended."""

    @F.arrow_udf("string")
    def replace(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, row in zip(texts, found, strict=True):
            value, spans_here = text.as_py(), row.as_py()
            if value is None or not spans_here:
                out.append(value)
                continue
            parts, at = [], 0
            for s in spans_here:
                if s["start"] >= at:
                    parts += [value[at : s["start"]], f"[{s['kind'].upper()}]"]
                at = max(at, s["end"])
            out.append("".join([*parts, value[at:]]))
        return pa.array(out, pa.string())

    return replace(text, spans)


def noted(docs: DataFrame, keep: list[str] | None, scanned: Column, base: str, spans: str, name: str) -> tuple[DataFrame, str, str]:
    """The rows of ``docs`` saved with a number, their base spans and what else a scan noted; the names of number and notes.

    ``scanned`` is a struct<base, noted>.  Of ``docs`` the columns ``keep`` (all, if None)
    are carried, but for those named as ``base`` and ``spans``, which the result replaces.
    """
    carried = [c for c in (docs.columns if keep is None else keep) if c not in (base, spans)]
    note = unused("_noted", [*carried, base, spans])
    made = docs.select(*carried, scanned.alias(note)).withColumns({base: F.col(f"{note}.base"), note: F.col(f"{note}.noted")})
    rows, row = numbered(made.select(*carried, base, note), f"_{name}")
    return rows, row, note


def add_spans(rows: DataFrame, row: str, extra: DataFrame, waiting: Column, kinds: tuple[str, ...], base: str, spans: str) -> DataFrame:
    """``rows`` (row, base, …) with ``spans``: the base spans and those of ``extra`` (row, kind, start, end).

    Only rows for which ``waiting`` holds can have extra spans; the others take no part in
    the join, so their texts are not shuffled.
    """
    more, of = unused("_more", rows.columns), unused("_of", rows.columns)
    here = extra.groupBy(F.col("row").alias(of)).agg(F.collect_set(F.struct("kind", "start", "end")).alias(more))
    joined = rows.filter(waiting).join(here, F.col(row) == F.col(of), "left")
    both = F.when(F.col(more).isNull(), F.col(base)).otherwise(ordered(F.concat(base, more), kinds))
    found = joined.withColumn(spans, both).drop(more, of)
    return rows.filter(~waiting).withColumn(spans, F.col(base)).unionByName(found)


def batches_of(batches: Iterator[pa.Array]) -> Iterator[list[str]]:
    """Each Arrow batch as texts, nulls as empty ones."""
    for batch in batches:
        yield [text.as_py() or "" for text in batch]
