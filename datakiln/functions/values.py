"""Expressions on semantic values: text forms, years and intervals, rates, errors, ages, geography.

Everything is built from built-in functions; a value outside its form becomes null.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from datakiln.functions.casts import bound, nullify, stripped, to_float, to_int

# ---- text


def title(c: Column) -> Column:
    """Capitals at the start of each run of letters."""
    marked = F.regexp_replace(F.lower(c), r"(^|[^\p{L}])(\p{L})", "$1\u0001$2")
    parts = F.split(marked, "\u0001")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def dequote(c: Column) -> Column:
    """Without one matching pair of quotes."""
    return F.regexp_replace(c, r"^(['\"])([\s\S]*)\1$", "$2")


def cut(c: Column, length: int = 200) -> Column:
    return F.substring(c, 1, length)


def name_from_parts(*parts: Column, separator: str = "-") -> Column:
    """A partition's name: its parts joined, blanks skipped."""
    return F.concat_ws(separator, *[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def source_keywords(c: Column) -> Column:
    """All leading and trailing parts of a dotted name, each once, sorted."""
    parts = F.split(c, r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.array_sort(F.array_union(heads, tails))


# ---- years, dates and intervals


def year_start(c: Column) -> Column:
    return to_int(c).cast("int")


def year_end(c: Column) -> Column:
    """The year after: ends are open."""
    return year_start(c) + 1


SINGLE_YEAR, YEAR_RANGE = r"^([0-9]{4})$", r"^([0-9]{4})(?:--|-|/)([0-9]{4})"


def range_years(c: Column) -> Column:
    """A year or a range of years as struct<y1, y2>; a single year ends in the next one."""

    def made(text: Column) -> Column:
        single = F.regexp_extract(text, SINGLE_YEAR, 1).try_cast("int")
        first, last = (F.regexp_extract(text, YEAR_RANGE, i).try_cast("int") for i in (1, 2))
        one = F.when(text.rlike(SINGLE_YEAR), F.struct(single.alias("y1"), (single + 1).alias("y2")))
        return F.coalesce(one, F.when(text.rlike(YEAR_RANGE), F.struct(first.alias("y1"), last.alias("y2"))))

    return bound(stripped(c), made)


def range_text(c: Column) -> Column:
    return bound(range_years(c), lambda y: F.when(y.isNotNull(), F.concat_ws("/", y["y1"].cast("string"), y["y2"].cast("string"))))


PERIOD = r"^P(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)W)?(?:([0-9]+)D)?$"


def _moved(day: Column, period: Column, sign: int) -> Column:
    n = [F.coalesce(F.regexp_extract(period, PERIOD, i).try_cast("int"), F.lit(0)) for i in (1, 2, 3, 4)]
    return F.date_add(F.add_months(day, sign * (12 * n[0] + n[1])), sign * (7 * n[2] + n[3]))


def _day(part: Column) -> Column:
    """A date or a year (its first day)."""
    return F.when(part.rlike(r"^[0-9]{4}$"), F.concat(part, F.lit("-01-01")).try_cast("date")).when(part.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), part.try_cast("date"))


def interval(c: Column) -> Column:
    """A year, a range of years or an ISO interval as struct<start, stop, kind>; null if none of these.

    Years run from their first day to the first day of the year after the last; ISO intervals
    are date/date, date/duration or duration/date, also with E for the stroke.
    """

    def made(start: Column, stop: Column, kind: str) -> Column:
        return F.struct(start.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"))

    def read(text: Column) -> Column:
        a, b = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
        two, day = F.size(F.split(text, "/")) == 2, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
        years = r"^[0-9]{4}(--|-|/)[0-9]{4}$"
        january = lambda y: F.make_date(y, F.lit(1), F.lit(1))
        several = bound(range_years(text), lambda y: made(january(y["y1"]), january(y["y2"]), "years"))
        return (
            F.when(text.rlike(SINGLE_YEAR), bound(_day(text), lambda d: made(d, F.add_months(d, 12), "year")))
            .when(text.rlike(years), several)
            .when(two & a.rlike(day) & b.rlike(day), made(_day(a), _day(b), "dates"))
            .when(two & b.rlike(PERIOD), bound(_day(a), lambda d: made(d, _moved(d, b, 1), "duration")))
            .when(two & a.rlike(PERIOD), bound(_day(b), lambda d: made(_moved(d, a, -1), d, "duration")))
        )

    def whole(found: Column) -> Column:
        return F.when(found["start"].isNotNull() & found["stop"].isNotNull(), found)

    return bound(bound(F.translate(nullify(c), "E", "/"), read), whole)


def interval_text(c: Column) -> Column:
    return bound(interval(c), lambda i: F.when(i.isNotNull(), F.concat_ws("/", i["start"].cast("string"), i["stop"].cast("string"))))


def expand_to_years(c: Column) -> Column:
    """The years that a year, date or interval covers, sorted; two dates include both ends, a duration excludes its end."""
    day = bound(nullify(c), lambda t: F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.array(F.year(t.try_cast("date")))))

    def covered(i: Column) -> Column:
        last = F.year(F.when(i["kind"].isin("year", "duration"), F.date_sub(i["stop"], 1)).otherwise(i["stop"]))
        return F.when(i.isNotNull() & (F.year(i["start"]) <= last), F.sequence(F.year(i["start"]), last))

    return F.coalesce(day, bound(interval(c), covered))


def compress_years(years: Column) -> Column:
    """An array of years as first/last."""
    return F.when(F.size(years) > 0, F.concat_ws("/", F.array_min(years).cast("string"), F.array_max(years).cast("string")))


def time_description(years: Column) -> Column:
    """Blank, one year, or "a to b"."""
    low, high = F.array_min(years).cast("string"), F.array_max(years).cast("string")
    return F.when(F.coalesce(F.size(years), F.lit(0)) <= 0, "").when(low == high, low).otherwise(F.concat(low, F.lit(" to "), high))


# ---- shares and errors


def share(c: Column) -> Column:
    """A proportion or rate; above 1 it fails."""
    value = to_float(c)
    return F.when(value <= 1, value)


def share_percent(c: Column) -> Column:
    return share(c) * 100


def percent(c: Column) -> Column:
    """A percentage, with or without its sign."""
    return to_float(F.regexp_replace(stripped(c), r"^%+|%+$", ""))


def percent_rate(c: Column) -> Column:
    return percent(c) / 100


#: Standard errors in the margin of each confidence level.
Z = {90: 1.645, 95: 1.96, 99: 2.575}


def _z(level: int) -> float:
    if level not in Z:
        raise ValueError(f"no confidence level {level}; known are {', '.join(map(str, Z))}")
    return Z[level]


def margin_to_se(margin: Column, level: int) -> Column:
    """The standard error of a margin of error."""
    return margin / _z(level)


def se_to_margin(se: Column, level: int) -> Column:
    return se * _z(level)


def convert_margin(margin: Column, level: int, to: int) -> Column:
    return se_to_margin(margin_to_se(margin, level), to)


def confidence(value: Column, se: Column, level: int) -> Column:
    """The interval around a value as struct<lower, upper>."""
    m = se_to_margin(se, level)
    return F.struct((value - m).alias("lower"), (value + m).alias("upper"))


def relative_error(se: Column, denominator: Column) -> Column:
    return F.try_divide(se, denominator)


# ---- people


#: Own number, short name, letter of the census tables, name and number of the health indicators.
RACE_ETHNICITY = (
    (1, "aian", "C", "AIAN", 1),
    (2, "asian", "D", "Asian", 2),
    (3, "black", "B", "AfricanAm", 3),
    (4, "hisp", "I", "Latino", 4),
    (5, "nhopi", "E", "NHOPI", 5),
    (6, "white", "A", "White", 6),
    (61, "whitenh", "H", None, None),
    (7, "other", None, "Other", 7),
    (8, "multiple", None, "Multiple", 8),
    (9, "all", None, "Total", 9),
)


def looked_up(key: Column, pairs: list[tuple]) -> Column:
    """A small fixed table as a map look-up; null where it has no such key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), key)


def race_number(indicator_number: Column) -> Column:
    """The own number of a health-indicator number."""
    return looked_up(to_int(indicator_number).cast("int"), [(r[4], r[0]) for r in RACE_ETHNICITY if r[4] is not None])


def race_name(number: Column) -> Column:
    """The short name of an own number."""
    return looked_up(number.cast("int"), [(r[0], r[1]) for r in RACE_ETHNICITY])


def age_range(c: Column) -> Column:
    """"a-b" as struct<low, high>, half open."""
    parts = F.split(stripped(c), "-")
    low, high = to_int(F.get(parts, F.lit(0))).cast("int"), to_int(F.get(parts, F.lit(1))).cast("int")
    return F.when(low.isNotNull() & high.isNotNull(), F.struct(low.alias("low"), high.alias("high")))


OLDEST = 120


def census_age(c: Column) -> Column:
    """An age group in words as struct<low, high>; the first form that fits counts."""
    text = stripped(c)
    n = lambda pattern, i: F.regexp_extract(text, pattern, i).try_cast("int")
    made = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    under, over, to, both, one = r"(?i)under ([0-9]+)", r"(?i)([0-9]+) years and over", r"(?i)([0-9]+) to ([0-9]+) years", r"(?i)([0-9]+) and ([0-9]+) years", r"(?i)([0-9]+) years"
    return (
        F.when(text.rlike(under), made(F.lit(0), n(under, 1)))
        .when(text.rlike(over), made(n(over, 1), F.lit(OLDEST)))
        .when(text.rlike(to), made(n(to, 1), n(to, 2) + 1))
        .when(text.rlike(both), made(n(both, 1), n(both, 2) + 1))
        .when(text.rlike(one), made(n(one, 1), n(one, 1)))
    )


def age_text(age: Column) -> Column:
    return F.when(age.isNotNull(), F.format_string("%02d-%02d", age["low"], age["high"]))


# ---- geography


def geo_parts(c: Column) -> Column:
    """A census code as struct<state, county, tract, block_group> by fixed widths 2, 3, 6, 1; missing parts are null."""
    text = F.regexp_replace(stripped(c), r"^[0-9]*US", "")
    part = lambda at, width: F.when(F.length(text) >= at + width - 1, F.substring(text, at, width)).try_cast("int")
    return F.when(text.rlike(r"^[0-9]{2,12}$"), F.struct(part(1, 2).alias("state"), part(3, 3).alias("county"), part(6, 6).alias("tract"), part(12, 1).alias("block_group")))


def tract_dotted(tract: Column) -> Column:
    """A tract number with its point; null for none."""
    text = F.lpad(tract.cast("string"), 6, "0")
    return F.concat(F.substring(text, 1, 4), F.lit("."), F.substring(text, 5, 2))


def county_census(state: Column, county: Column) -> Column:
    """State and county numbers as the five-digit census code."""
    return F.format_string("%02d%03d", state.cast("int"), county.cast("int"))


def county_long(state: Column, county: Column) -> Column:
    """The long census form of a county."""
    return F.concat(F.lit("05000US"), county_census(state, county))


DIGITS62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Own rule: base-62 widths of the parts, and the summary level of each depth.
WIDTHS, LEVELS = (2, 2, 4, 1), (40, 50, 140, 150)


def base62(n: Column, width: int) -> Column:
    """A number in ``width`` base-62 digits."""
    digit = lambda i: F.substr(F.lit(DIGITS62), (F.floor(n / 62**i) % 62 + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(i) for i in reversed(range(width))])


def base62_number(text: Column) -> Column:
    """The number that base-62 digits stand for."""
    chars = F.split(text, "")
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: acc * 62 + F.instr(F.lit(DIGITS62), c) - 1)


def gvid(*parts: Column) -> Column:
    """The own id of a state, county, tract or block group: its level, then its parts."""
    level = F.lit(LEVELS[len(parts) - 1])
    return F.concat(base62(level, 2), *[base62(p.cast("long"), w) for p, w in zip(parts, WIDTHS, strict=False)])


def county_of_gvid(c: Column) -> Column:
    """An id below county level rolled up to its county; states and counties stay."""
    level = base62_number(F.substring(c, 1, 2))
    return F.when(level.isin(140, 150), F.concat(base62(F.lit(50), 2), F.substring(c, 3, 4))).otherwise(c)


def summary_grain(c: Column) -> Column:
    """The same level with every part at its top value."""
    return F.concat(F.substring(c, 1, 2), F.repeat(F.lit("Z"), F.length(c) - 2))


def all_in_upper(c: Column) -> Column:
    """The id of all places of its level in the place above: the last part at its top value."""
    ends = [2 + sum(WIDTHS[:depth]) for depth in range(len(WIDTHS) + 1)]
    made = F.lit(None).cast("string")
    for start, end in zip(ends, ends[1:], strict=False):
        made = F.when(F.length(c) == end, F.concat(F.substring(c, 1, start), F.lit("Z" * (end - start)))).otherwise(made)
    return made


def county_name_parts(c: Column) -> Column:
    """"Los Angeles County, California" as struct<state, name, division, short>."""
    parts = F.split(c, r",\s*")
    name, state = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    kinds = r"\s+(County|Parish|Borough|Census Area|Municipality|Municipio|city|City)$"
    division = F.lower(F.regexp_extract(name, kinds, 1))
    return F.struct(state.alias("state"), name.alias("name"), F.nullif(division, F.lit("")).alias("division"), F.regexp_replace(name, kinds, "").alias("short"))
