"""Casting expressions: a value that does not fit becomes null, never an error.

Spark's own casts accept more text than the rules here (``1.0d``), so text is matched
against a number pattern first.  All functions take and return columns and stay built-in.
"""

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that is stripped from text before it is judged.
BLANKS = " \t\n\r\x0b\x0c"
FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INT_TEXT = r"^[+-]?[0-9]+$"
SPECIAL_TEXT = r"^[+-]?(?i:nan|inf|infinity)$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd HH:mm", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy h:mm:ss a")
TIME_FORMATS = ("HH:mm:ss", "HH:mm", "h:mm:ss a", "h:mm a", "HHmmss")
#: Two-digit years from this one on belong to the 1900s, those below to the 2000s.
CENTURY_PIVOT = 70


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(c: Column) -> Column:
    """Text without white space at either end."""
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def nullify(c: Column) -> Column:
    """Stripped text; blank becomes null."""
    return F.nullif(stripped(c), F.lit(""))


def to_float(c: Column) -> Column:
    """A double from text in number form (nan and inf too), else null."""
    text = stripped(c)
    return F.when(text.rlike(FLOAT_TEXT) | text.rlike(SPECIAL_TEXT), text.try_cast("double"))


def to_int(c: Column, truncate: bool = False) -> Column:
    """A long from integral text, else null; ``truncate`` for numeric input, whose fraction is cut."""
    if truncate:
        whole = c.cast("double")
        return F.when(F.abs(whole) < 2.0**63, whole.try_cast("bigint"))
    text = stripped(c)
    return F.when(text.rlike(INT_TEXT), text.try_cast("bigint"))


def to_text(c: Column) -> Column:
    """Text; only the empty text becomes null, blanks stay."""
    return F.nullif(c.cast("string"), F.lit(""))


#: The text that each part of a format stands for.
SHAPES = {"yyyy": r"\d{4}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "M": r"\d{1,2}", "dd": r"\d{2}", "d": r"\d{1,2}", "HH": r"\d{2}", "h": r"\d{1,2}", "mm": r"\d{2}", "ss": r"\d{2}", "a": "[AaPp][Mm]"}


def shape_of(fmt: str) -> str:
    """A pattern for the texts of a date format."""
    parts = re.findall(r"'[^']*'|[A-Za-z]+|.", fmt)
    return "^" + "".join(SHAPES.get(p) or re.escape(p.strip("'")) for part in parts for p in _runs(part)) + "$"


def _runs(part: str) -> list[str]:
    return [part] if part.startswith("'") or not part.isalpha() else [m.group() for m in re.finditer(r"(.)\1*", part)]


def read_as(text: Column, fmt: str, head: str = "") -> Column:
    """A timestamp from text of the format's shape; other text is not even tried, as failures are slow."""
    whole = F.concat(F.lit("1970-01-01 "), text) if head else text
    return F.when(text.rlike(shape_of(fmt)), F.try_to_timestamp(whole, F.lit(head + fmt)))


def short_year_date(c: Column, pivot: int = CENTURY_PIVOT) -> Column:
    """Month/day/two-digit year with a fixed pivot between the centuries."""
    parts = [F.try_to_number(F.regexp_extract(c, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})$", i), F.lit("99")).cast("int") for i in (1, 2, 3)]
    year = parts[2] + F.when(parts[2] >= pivot, 1900).otherwise(2000)
    text = F.format_string("%04d-%02d-%02d", year, parts[0], parts[1])
    return F.when(c.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"), text.try_cast("date"))


def to_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """A date from the first format that fits; a date with a time is cut to its day."""

    def first(text: Column) -> Column:
        return F.coalesce(short_year_date(text), *[F.to_date(read_as(text, f)) for f in (*formats, *TIMESTAMP_FORMATS)])

    return bound(nullify(c), first)


def to_timestamp(c: Column, formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> Column:
    """A timestamp without zone in whole seconds; a bare date is its midnight."""
    first = bound(nullify(c), lambda text: F.coalesce(*[read_as(text, f) for f in formats]))
    return F.date_trunc("second", F.coalesce(first, to_date(c).cast("timestamp"))).cast("timestamp_ntz")


def to_time(c: Column, formats: tuple[str, ...] = TIME_FORMATS) -> Column:
    """A time of day as HH:mm:ss text."""
    first = bound(F.upper(nullify(c)), lambda text: F.coalesce(*[read_as(text, f, "yyyy-MM-dd ") for f in formats]))
    return F.date_format(first, "HH:mm:ss")


CASTS: dict[str, Callable[[Column], Column]] = {
    "int": to_int, "long": to_int, "float": to_float, "double": to_float, "str": to_text, "text": to_text, "date": to_date, "datetime": to_timestamp, "timestamp": to_timestamp, "time": to_time,
}


def cast_to(c: Column, datatype: str) -> Column:
    """The cast of a named type; an unknown name is an error on the driver."""
    if datatype not in CASTS:
        raise ValueError(f"no cast to {datatype!r}; known are {', '.join(sorted(CASTS))}")
    return CASTS[datatype](c)


def cast_typed(c: Column, datatype: str, source: T.DataType) -> Column:
    """The cast of a column that has a type already: numbers are cut to integers, not read as text."""
    if isinstance(source, T.IntegralType) and datatype in ("int", "long"):
        return c.cast("bigint")
    if isinstance(source, T.NumericType) and datatype in ("int", "long"):
        return to_int(c, truncate=True)
    if isinstance(source, T.NumericType) and datatype in ("float", "double"):
        return c.cast("double")
    if isinstance(source, T.DateType | T.TimestampType | T.TimestampNTZType) and datatype == "date":
        return c.cast("date")
    return cast_to(c, datatype)


def failed_value(raw: Column, value: Column) -> Column:
    """The raw text where it holds something and the cast gave nothing, else null: the code beside a value."""
    return F.when(nullify(raw).isNotNull() & value.isNull(), raw.cast("string"))


def parse_int(c: Column) -> Column:
    """Rounded half away from zero; blank and junk become null."""
    return F.round(to_float(c)).try_cast("bigint")


def parse_float(c: Column) -> Column:
    return to_float(nullify(c))


def parse_text(c: Column) -> Column:
    return nullify(c)


def int_or(c: Column, default: int | None = None) -> Column:
    """An integer, or the default where the text is none."""
    return F.coalesce(to_int(c), F.lit(default).cast("bigint"))


def float_or(c: Column, default: float | None = None) -> Column:
    return F.coalesce(to_float(c), F.lit(default).cast("double"))


def int_cut(c: Column) -> Column:
    """An integer from any number text, its fraction cut; else null."""
    return to_int(to_float(c), truncate=True)


def without_commas(c: Column) -> Column:
    return F.replace(c.cast("string"), F.lit(","), F.lit(""))


def clean_int(c: Column, strict: bool = False) -> Column:
    """An integer with thousands commas; junk is null, or an error at run time where ``strict``."""
    value = to_int(without_commas(c))
    if not strict:
        return value
    junk = failed_value(c, value)
    return F.when(junk.isNotNull(), F.raise_error(F.concat(F.lit("not an integer: "), junk)).cast("bigint")).otherwise(value)


def clean_float(c: Column) -> Column:
    return to_float(without_commas(c))


def nan_is_null(c: Column) -> Column:
    return F.when(~F.isnan(c.cast("double")), c)


def finite(c: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def excel_date(c: Column, base: int = 1900) -> Column:
    """A spreadsheet's serial day number as a timestamp, for the 1900 or the 1904 calendar.

    In the 1900 calendar serials from 60 on are counted with a leap day that never was.
    """
    serial = to_float(c)
    if base == 1904:
        day_one, shift = "1904-01-01", F.lit(0.0)
    elif base == 1900:
        day_one, shift = "1899-12-30", F.when(serial < 60, 1.0).otherwise(0.0)
    else:
        raise ValueError("the calendars start in 1900 or 1904")
    seconds = F.round((serial + shift) * 86400).cast("bigint")
    return F.timestamp_seconds(F.unix_timestamp(F.lit(day_one).cast("timestamp")) + seconds).cast("timestamp_ntz")


def keep_or_cast(c: Column, datatype: str) -> Column:
    """The cast value as text where the cast succeeds, else the raw text."""
    return F.coalesce(cast_to(c, datatype).cast("string"), c.cast("string"))


def first_that_works(tried: Column, otherwise: Column) -> Column:
    """The first expression where it gives a value, else the second."""
    return F.coalesce(tried, otherwise)
