"""Records of delimited text: lines that belong together, and cells by the layout of each file.

A line with an odd number of quotes opens or closes a cell that holds a line break.  How many
such lines a file has before a line says whether that lies inside a cell, so running counts
over sorted ranges (`row_index.prefix_sums`) tell which lines make one record, and no task
reads a whole file.  Only the lines of such records are gathered.

Each file has its own header.  The distinct headers, of which there are few, become the
branches of one expression, and each row takes the branch of its file: one scan, cells by
name whatever their order in the file.
"""

import csv
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datakiln.operators.headers import ascii_name, unique_names
from datakiln.operators.row_index import prefix_sums

#: Lines of one record at most; an open quote that swallows more is a fault of the file, and its lines are rows of the wrong width.
MOST_LINES = 1000
#: Distinct headers of one source at most.
MOST_LAYOUTS = 200
#: What is put before a line that no record can be made of: no layout's cells fit it.
BROKEN = "\x00"


def quotes(line: str | Column) -> Column:
    """The quotes of a line."""
    c = F.col(line) if isinstance(line, str) else line
    return F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))


def records(lines: DataFrame, keys: list[str], number: str = "line_no", value: str = "value") -> DataFrame:
    """``lines`` (keys, number, value, …) with the lines of each record as one, under the number of its first line.

    Other columns are those of the first line.  Lines of a quote that is never closed, or only
    after more than `MOST_LINES`, are marked as `BROKEN`.
    """
    odd = quotes(value) % 2
    if lines.filter(odd == 1).isEmpty():
        return lines
    counted = prefix_sums(lines, keys, [number], {"_upto": odd.cast("long")}).withColumn("_odd", odd)
    before = F.col("_upto") - F.col("_odd")
    inside = (before % 2 == 1) | (F.col("_odd") == 1)
    alone = counted.filter(~inside).select(*lines.columns)
    parts = counted.filter(inside).withColumn("_nth", F.floor(before / 2))
    held = parts.groupBy(*keys, "_nth").agg(F.count("*").alias("_n"), F.sum("_odd").alias("_ends"))
    known = held.select(*keys, "_nth", ((F.col("_n") <= MOST_LINES) & (F.col("_ends") == 2)).alias("_whole"))
    sided = parts.join(known, [*keys, "_nth"])
    others = [c for c in lines.columns if c not in (*keys, value)]
    ordered = F.array_sort(F.collect_list(F.struct(number, *[c for c in others if c != number], value)))
    joined = sided.filter("_whole").groupBy(*keys, "_nth").agg(ordered.alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda x: x[value]), "\n")
    whole = joined.select(*keys, *[F.col("_lines")[0][c].alias(c) for c in others], text.alias(value)).select(*lines.columns)
    broken = sided.filter(~F.col("_whole")).withColumn(value, F.concat(F.lit(BROKEN), F.col(value))).select(*lines.columns)
    return alone.unionByName(whole).unionByName(broken)


def joined_lines(lines: Iterator[str]) -> Iterator[tuple[int, str]]:
    """As `records`, for the lines of a stream that one task reads in order: (number of the first line, record)."""
    held: list[str] = []
    for number, line in enumerate(lines):
        odd = line.count('"') % 2
        if not held and not odd:
            yield number, line
            continue
        held.append(line)
        if len(held) > 1 and odd:
            yield number - len(held) + 1, "\n".join(held)
            held = []
        elif len(held) > MOST_LINES:
            yield from ((number - len(held) + 1 + i, BROKEN + text) for i, text in enumerate(held))
            held = []
    yield from ((number - len(held) + 1 + i, BROKEN + text) for i, text in enumerate(held))


def split_lines(lines: list[str], separator: str = ",") -> list[list[str]]:
    """A handful of header lines as cells, on the driver."""
    return list(csv.reader(lines, delimiter=separator))


def joined_header(rows: list[list[str]]) -> list[str]:
    """Several header rows as one: gaps of all but the last row filled from the left, rows joined by a blank."""
    width = max(map(len, rows), default=0)
    filled = []
    for place, row in enumerate(rows):
        row = [*row, *[""] * (width - len(row))]
        if place < len(rows) - 1:
            last = ""
            row = [last := (c.strip() or last) for c in row]
        filled.append(row)
    return unique_names([ascii_name(" ".join(filter(None, (r[i].strip() for r in filled)))) for i in range(width)])


def layouts_of(headers: DataFrame, separator: str, joined: bool) -> tuple[DataFrame, list[list[str]]]:
    """``headers`` (keys, header: its lines as one text) with layout instead, a number among the distinct headers, and the names that each gives.

    ``joined``: several rows become one and keep ASCII alone; else the first row's cells are the names.
    """
    found = [r.header for r in headers.select("header").distinct().orderBy("header").limit(MOST_LAYOUTS + 1).collect()]
    if len(found) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} distinct headers in one source")
    rows = [split_lines(text.split("\n"), separator) for text in found]
    names = [joined_header(cells) if joined else unique_names([c or f"_c{i}" for i, c in enumerate(cells[0])]) for cells in rows]
    known = headers.withColumn("layout", F.array_position(F.array(*map(F.lit, found)), F.col("header")).cast("int") - 1)
    return known.drop("header"), names


def cells_of(rows: DataFrame, layouts: list[list[str]], bad_rows: str, separator: str = ",", keep: list[str] = (), value: str = "value") -> DataFrame:
    """``rows`` (layout, value) as text columns by the names of their layout, and ``keep``; empty cells are null.

    A row with more or fewer cells than its header, or without a header, is an error
    ("fail"), kept with its text in ``_corrupt`` ("keep") or left out ("drop").  Columns that
    a layout lacks are null.
    """
    if bad_rows not in ("fail", "keep", "drop"):
        raise ValueError(f"bad_rows is {bad_rows!r}, not fail, keep or drop")
    names = list(dict.fromkeys(name for mine in layouts for name in mine))
    parsed = []
    for nth, mine in enumerate(layouts):
        schema = ", ".join(f"_{i} string" for i in range(len(mine) + 1))
        options = {"sep": separator, "escape": '"', "columnNameOfCorruptRecord": f"_{len(mine)}", "mode": "PERMISSIVE", "maxColumns": str(len(mine) + 20_480)}
        parsed.append(F.when(F.col("layout") == nth, F.from_csv(F.col(value), schema, options)).alias(f"_parsed_{nth}"))
    held = rows.select(*[F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)], *parsed, "layout", F.col(value).alias("_text"))
    places = [{name: i for i, name in enumerate(mine)} for mine in layouts]
    cells = [F.coalesce(*[F.col(f"_parsed_{nth}._{place[n]}") for nth, place in enumerate(places) if n in place]) for n in names]
    fit = [F.when(F.col("layout") == nth, F.col(f"_parsed_{nth}._{len(mine)}").isNull()) for nth, mine in enumerate(layouts)]
    fits = F.coalesce(*fit, F.lit(False)) & ~F.col("_text").startswith(BROKEN)
    bad, text = ~fits, F.replace("_text", F.lit(BROKEN), F.lit(""))
    if bad_rows == "fail":
        shown = F.concat(F.lit("a malformed row, of another width than its header: "), F.substring(text, 1, 200))
        held = held.filter(F.when(bad, F.raise_error(shown).cast("boolean")).otherwise(True))
    elif bad_rows == "drop":
        held = held.filter(~bad)
    out = [F.when(fits, c).alias(n) for c, n in zip(cells, names, strict=True)] if bad_rows == "keep" else [c.alias(n) for c, n in zip(cells, names, strict=True)]
    kept = [F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep)]
    return held.select(*kept, *out, *([F.when(bad, text).alias("_corrupt")] if bad_rows == "keep" else []))
