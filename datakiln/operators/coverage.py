"""Time, space and grain that partitions cover."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datakiln.functions import values


def year_of(c: Column, kind: str) -> Column:
    return F.year(c) if kind in ("date", "timestamp", "timestamp_ntz") else c.cast("int")


def time_coverage(df: DataFrame, keys: list[str], columns: list[str], declared: list[str] = ()) -> DataFrame:
    """(keys…, years): the sorted years of the year and date columns and of declared intervals."""
    kinds, none = dict(df.dtypes), F.array().cast("array<int>")
    narrow = df.select(*keys, F.array(*[year_of(F.col(c), kinds[c]) for c in columns]).alias("_own"), F.array(*[F.col(c).cast("string") for c in declared]).alias("_declared")).distinct()
    named = F.flatten(F.transform("_declared", lambda d: F.coalesce(values.expand_to_years(d), none))) if declared else none
    years = narrow.select(*keys, F.explode(F.array_union("_own", named)).alias("year")).filter("year is not null").distinct()
    return years.groupBy(*keys).agg(F.array_sort(F.collect_list("year")).alias("years"))


#: Levels of places that coverage lists: state, county division, county, subdivision, place, urban area.
LEVELS = (10, 40, 50, 60, 160, 400)


def level_code(level: int) -> str:
    """A level as the two digits (base 62) that ids start with."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return digits[level // 62] + digits[level % 62]


def place_of(gvid: Column, levels: tuple[int, ...] = LEVELS) -> Column:
    """An id of one of the levels, those below county level as their county; null for another level."""
    rolled = values.county_of_gvid(gvid)
    return F.when(F.substring(rolled, 1, 2).isin([level_code(n) for n in levels]), rolled)


def space_coverage(df: DataFrame, keys: list[str], gvid: str, levels: tuple[int, ...] = LEVELS, declared: list[str] = ()) -> DataFrame:
    """(keys…, places): distinct ids of the levels, those below county level rolled up first, and declared places (of sources, partitions)."""
    own = place_of(F.col(gvid), levels)
    narrow = df.select(*keys, F.explode(F.array(own, *[F.nullif(F.col(c), F.lit("")) for c in declared])).alias("place"))
    return narrow.filter("place is not null").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("place")).alias("places"))


def grain_coverage(df: DataFrame, keys: list[str], gvid: str, declared: list[str] = ()) -> DataFrame:
    """(keys…, grains): the summary form of every level that occurs, and declared grains."""
    narrow = df.select(*keys, F.explode(F.array(values.summary_grain(F.col(gvid)), *[F.nullif(F.col(c), F.lit("")) for c in declared])).alias("grain"))
    return narrow.filter("grain is not null").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("grain")).alias("grains"))


def joint_coverage(parts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The union of a coverage list over partitions."""
    each = parts.select(*keys, F.explode(column).alias("x")).distinct()
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias(column))


def partition_summary(df: DataFrame, keys: list[str], key: str, years: Column, shown: int = 5) -> DataFrame:
    """(keys…, rows, min_id, max_id, years, first_years): the rows, id bounds and time of each partition."""
    held = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(key).alias("min_id"), F.max(key).alias("max_id"), F.collect_set(years).alias("_years"))
    sorted_years = F.array_sort("_years")
    return held.select(*keys, "rows", "min_id", "max_id", F.size("_years").alias("years"), F.array_join(F.slice(sorted_years, 1, shown).cast("array<string>"), ",").alias("first_years"))


def short_description(years: Column, rows: Column) -> Column:
    """The time of a partition and its number of rows."""
    return F.concat_ws(" ", F.nullif(values.time_description(years), F.lit("")), F.format_string("%d Rows.", rows))
