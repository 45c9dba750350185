"""Measures by dimensions: means and counts over one, two or all sets of dimensions."""

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datakiln.operators.headers import by_role
from datakiln.operators.rows import where_equal

#: Pivots refuse more output columns than this.
MOST_PIVOTED = 500


def joined_values(c: str) -> Column:
    """The distinct values of a text column, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), ", ")


def chosen_filters(filters: dict[str, object]) -> dict[str, object]:
    """A filter given as all its options stands for the first of them in order."""
    return {k: sorted(v)[0] if isinstance(v, list | tuple | set) else v for k, v in filters.items()}


def measure_by(df: DataFrame, measure: str, dimensions: list[str], filters: dict[str, object] | None = None, labels: list[str] = (), extra: list[str] = ()) -> DataFrame:
    """(dimensions…, labels…, measure, count): the mean of the measure and the rows of each group.

    Filters come first, rows with a null dimension are left out, nulls of the measure are
    skipped by the mean but counted as rows; ``extra`` text columns become joined values.
    """
    kept = where_equal(df, chosen_filters(filters or {})).dropna(subset=list(dimensions))
    made = [F.avg(measure).alias(measure), F.count("*").alias("count"), *[joined_values(c).alias(c) for c in extra]]
    return kept.groupBy(*dimensions, *labels).agg(*made)


def unstacked(df: DataFrame, measure: str, rows: str, across: str, values: list, filters: dict[str, object] | None = None) -> DataFrame:
    """The mean of the measure with the second dimension spread over columns; its values are given, so no extra job."""
    if len(values) > MOST_PIVOTED:
        raise ValueError(f"{len(values)} values of {across} are too many columns")
    kept = where_equal(df, chosen_filters(filters or {})).dropna(subset=[rows, across])
    return kept.groupBy(rows).pivot(across, values).agg(F.avg(measure))


def all_sets(df: DataFrame, measure: str, sets: list[tuple[str, ...]]) -> DataFrame:
    """(set, dimensions…, measure, count) of every dimension set in one scan.

    Rows are first added up at the finest grain, sums and counts rather than means, so the
    expansion over sets works on groups instead of rows.
    """
    dims = list(dict.fromkeys(d for s in sets for d in s))
    fine = df.groupBy(*dims).agg(F.sum(measure).alias("_sum"), F.count(measure).alias("_held"), F.count("*").alias("_rows"))
    level = F.grouping_id()
    rolled = fine.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dims])
    added = rolled.agg(level.alias("_level"), F.sum("_sum").alias("_sum"), F.sum("_held").alias("_held"), F.sum("_rows").alias("count"))
    bits = {sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s): ",".join(s) for s in sets}
    named = F.create_map(*[F.lit(x) for b, n in bits.items() for x in (b, n)])[F.col("_level").cast("int")]
    present = [F.col(d).isNotNull() | (F.col("_level").bitwiseAND(1 << (len(dims) - 1 - i)) != 0) for i, d in enumerate(dims)]
    kept = added.filter(present[0] if len(present) == 1 else _both(present))
    return kept.select(named.alias("set"), *dims, F.try_divide("_sum", "_held").alias(measure), "count")


def _both(tests: Iterable[Column]) -> Column:
    made = F.lit(True)
    for test in tests:
        made = made & test
    return made


def primary_dimensions(schema: T.StructType, distinct: dict[str, int]) -> list[str]:
    """Dimensions that hang on no other column and have more than one value."""
    return [c for c in by_role(schema, "d") if distinct.get(c, 0) > 1]


def floating_dimensions(primary: list[str], filters: dict[str, object], axes: list[str]) -> list[str]:
    return [d for d in primary if d not in filters and d not in axes]


def check_axes(primary: list[str], filters: dict[str, object], axes: list[str]) -> None:
    """All primary dimensions must be filtered or on an axis."""
    if loose := floating_dimensions(primary, filters, axes):
        raise ValueError(f"dimensions neither filtered nor on an axis: {', '.join(loose)}")


def dimension_sets(distinct: dict[str, int], geo: set[str] = frozenset(), time: set[str] = frozenset()) -> list[dict]:
    """Every single dimension and every pair, the larger one first and a geographic one never second."""
    out = []
    for p in sorted(distinct):
        out.append({"axes": (p,), "chart": "map" if p in geo else "line" if p in time else "bar"})
    for a, b in combinations(sorted(distinct), 2):
        first, second = (a, b) if (distinct[a], b) >= (distinct[b], a) else (b, a)
        if second in geo and first not in geo:
            first, second = second, first
        if not (first in geo and second in geo):
            out.append({"axes": (first, second), "chart": "map" if first in geo else "line" if first in time else "bar"})
    for s in out:
        s["filters"] = sorted(set(distinct) - set(s["axes"]))
        s["key"] = "/".join(s["axes"])
    return out


def value_labels(df: DataFrame, code: str, label: str | None = None, most: int = 75) -> DataFrame:
    """(code, label): the distinct pairs; without a label column each code is its own label where they are few."""
    if label is None:
        own = df.select(F.col(code).cast("string").alias("code")).distinct().filter("code is not null")
        few = own.limit(most).count() < most
        return own.withColumn("label", F.col("code")).filter(F.lit(few))
    return df.select(F.col(code).alias("code"), F.col(label).alias("label")).distinct().filter("code is not null")


def ambiguous_labels(labels: DataFrame) -> DataFrame:
    """(code, labels) of codes with more than one label: none may be left."""
    return labels.groupBy("code").agg(F.count_distinct("label").alias("labels")).filter("labels > 1")


def with_labels(df: DataFrame, code: str, labels: DataFrame, name: str) -> DataFrame:
    """``df`` with the label of a code (null where there is none); Spark broadcasts the labels if they are small."""
    known = labels.select(F.col("code").alias("_code"), F.col("label").alias(name))
    return df.join(known, F.col(code).cast("string") == F.col("_code").cast("string"), "left").drop("_code")


def with_codes(df: DataFrame, label: str, labels: DataFrame, name: str) -> DataFrame:
    """The reverse: ``df`` with the code of a label; of codes that share a label the least."""
    known = labels.groupBy(F.col("label").alias("_label")).agg(F.min("code").alias(name))
    return df.join(known, F.col(label) == F.col("_label"), "left").drop("_label")


def with_linked_row(df: DataFrame, key: str, other: DataFrame, other_key: str, name: str) -> DataFrame:
    """``df`` with the row that a foreign key points to, as a struct."""
    linked = other.select(F.col(other_key).alias("_key"), F.struct(*other.columns).alias(name))
    return df.join(linked, F.col(key) == F.col("_key"), "left").drop("_key")


def indicators(entity: DataFrame, key: str, parts: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """The entity table with several indicator tables joined on its key, each filtered first."""
    made = entity
    for name, (table, kept) in parts.items():
        part = (table if kept is None else table.filter(kept)).select(F.col(key).alias(f"_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in table.columns if c != key])
        made = made.join(part, F.col(key) == F.col(f"_{name}")).drop(f"_{name}")
    return made
