"""Names, positions and declared schemas of columns."""

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datakiln.functions import valuetypes

TYPES: dict[str, T.DataType] = {
    "int": T.LongType(), "integer": T.LongType(), "long": T.LongType(), "int64": T.LongType(), "float": T.DoubleType(), "real": T.DoubleType(), "str": T.StringType(), "varchar": T.StringType(), "text": T.StringType(), "date": T.DateType(), "time": T.StringType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampNTZType(), "blob": T.BinaryType(), "geometry": T.StringType(), "unknown": T.StringType(),
}
#: From the narrowest to the widest; types that do not mix become text.
LATTICE = ("unknown", "int", "float", "str")


def mangle(name: str | None, position: int) -> str:
    """A name of lower-case word characters; an empty one is named by its position (from 0)."""
    made = re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", (name or "").strip().lower(), flags=re.ASCII)).rstrip("_")
    return made or f"column{position}"


def mangled(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([mangle(c, i) for i, c in enumerate(df.columns)]))


def unique_names(names: list[str]) -> list[str]:
    """A name that came before gets its position (from 1), or the next number that makes it new."""
    seen: set[str] = set()
    out = []
    for place, name in enumerate(names, 1):
        made = name
        while made in seen:
            made, place = f"{name}_{place}", place + 1
        out.append(made)
        seen.add(made)
    return out


def unused(name: str, taken: list[str]) -> str:
    """``name``, with as many strokes behind it as it takes to differ from all ``taken`` ones in any case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def ascii_name(name: str) -> str:
    return name.encode("ascii", "ignore").decode()


def renamed_by_position(df: DataFrame, names: list[str]) -> DataFrame:
    """New names for all columns; their number must agree."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*unique_names(names))


def headed_by(df: DataFrame, table: "TableSpec", key: str = "id") -> DataFrame:
    """Columns under the names of a table in its order, by position; a source has no ``key``, which its table adds."""
    names = [c.name for c in sorted(table.columns.values(), key=lambda c: c.position)]
    return renamed_by_position(df, names if key in df.columns else [n for n in names if n != key])


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Mapped columns renamed, the others as they are."""
    return df.withColumnsRenamed(names)


def without_blank_names(df: DataFrame) -> DataFrame:
    """By position, as blank names may repeat."""
    kept = [i for i, c in enumerate(df.columns) if c.strip()]
    names = [df.columns[i] for i in kept]
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[f"_{i}" for i in kept]).toDF(*names)


def laid_out(df: DataFrame, layout: T.StructType) -> DataFrame:
    """The columns of a table layout in its order: missing ones null, others dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name, metadata=f.metadata) for f in layout])


def only_laid_out(df: DataFrame, layout: T.StructType) -> DataFrame:
    """The columns that the layout has, in the order of ``df``."""
    names = set(layout.fieldNames())
    return df.select(*[c for c in df.columns if c in names])


def empty_columns(df: DataFrame) -> list[str]:
    """Columns that hold nothing but nulls, empty texts and zeros, found in one pass."""
    held = [F.max((F.col(f.name).isNotNull() & (F.col(f.name).cast("string") != "") & ((F.col(f.name) != 0) if isinstance(f.dataType, T.NumericType) else F.lit(True))).cast("int")).alias(f.name) for f in df.schema]
    row = df.agg(*held).first()
    return [c for c in df.columns if not row[c]]


def without_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def promoted(a: str, b: str) -> str:
    """The type that holds both; dates and times mix with nothing but themselves."""
    if a == b or b == "unknown":
        return a
    if a == "unknown":
        return b
    if a in LATTICE and b in LATTICE:
        return max(a, b, key=LATTICE.index)
    return "str"


@dataclass
class ColumnSpec:
    """A declared or found column: position, name, type and what the catalogue says of it."""

    position: int
    name: str
    datatype: str = "unknown"
    valuetype: str = ""
    role: str = ""
    parent: str = ""
    description: str = ""
    has_codes: bool = False
    transform: str = ""

    def field(self) -> T.StructField:
        metadata = {k: getattr(self, k) for k in ("valuetype", "role", "parent", "description") if getattr(self, k)}
        return T.StructField(self.name, TYPES[self.datatype], True, metadata)


@dataclass
class TableSpec:
    """Columns by name in the order of their positions; a table starts with an integer id."""

    name: str
    columns: dict[str, ColumnSpec] = field(default_factory=dict)

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in sorted(self.columns.values(), key=lambda c: c.position)])


def merged(name: str, sources: list[list[ColumnSpec]], declared: set[str] = frozenset()) -> TableSpec:
    """One table from the columns of several sources.

    Columns are taken by position and added once by name; where sources disagree the types
    are promoted, ``unknown`` never overrides, and columns in ``declared`` keep their type.
    A column with codes gets another beside it that takes what is no number, and reports it as no error.
    """
    table = TableSpec(name, {"id": ColumnSpec(1, "id", "int", role="k")})
    names = [c.name for source in sources for c in source]
    for spec in sorted((c for source in sources for c in source), key=lambda c: c.position):
        have = table.columns.get(spec.name)
        if have is None:
            place = len(table.columns) + 1
            table.columns[spec.name] = ColumnSpec(place, spec.name, spec.datatype, spec.valuetype, spec.role, spec.parent, spec.description, transform=spec.transform)
            if spec.has_codes:
                _add_codes(table, spec.name, names)
        elif spec.name not in declared and spec.name != "id":
            have.datatype = promoted(have.datatype, spec.datatype)
            have.description = have.description or spec.description
            if spec.has_codes and not have.has_codes and have.datatype != "str":
                _add_codes(table, spec.name, names)
    for column in list(table.columns.values()):
        if column.has_codes and column.datatype == "str":  # another source made it text, so nothing fails
            column.has_codes, column.transform = False, ""
            table.columns.pop(next(c.name for c in table.columns.values() if c.parent == column.name and c.transform == f";row.{column.name}.failed_value"))
    for place, column in enumerate(table.columns.values(), 1):
        column.position = place
    return table


def _add_codes(table: TableSpec, name: str, taken: list[str]) -> None:
    """A column behind ``name`` that takes its codes."""
    table.columns[name].has_codes, table.columns[name].transform = True, ";;clear_error"
    code = unused(f"{name}_code", [*table.columns, *taken])
    table.columns[code] = ColumnSpec(len(table.columns) + 1, code, "str", parent=name, transform=f";row.{name}.failed_value")


def column_map(sources: dict[str, list[str]], spark: SparkSession) -> DataFrame:
    """Which source has which column: one row for each name, one column of 0 and 1 for each source."""
    long = spark.createDataFrame([(s, c) for s, names in sources.items() for c in names], "source string, name string")
    return long.groupBy("name").pivot("source", sorted(sources)).agg(F.lit(1)).na.fill(0).orderBy("name")


def column_changes(tables: dict[str, tuple[list[str], TableSpec]], spark: SparkSession, all_columns: bool = False) -> DataFrame:
    """(source, position, source_column, column) where a source's columns have other names than their table's, by position.

    The table's key stands before them and is left out; ``all_columns`` lists those of the same name, too.
    """
    rows = []
    for source, (names, table) in tables.items():
        held = [c.name for c in sorted(table.columns.values(), key=lambda c: c.position) if c.role != "k" or c.name in names]
        if len(held) != len(names):
            raise ValueError(f"{len(names)} columns of {source!r} for {len(held)} of {table.name!r}")
        rows += [(source, i, old, new) for i, (old, new) in enumerate(zip(names, held, strict=True), 1) if all_columns or old != new]
    return spark.createDataFrame(rows, "source string, position int, source_column string, column string")


def table_of_frame(df: DataFrame, name: str, key: str = "id") -> TableSpec:
    """The table that a frame's columns and types declare, behind a key."""
    kinds = {T.StringType: "str", T.DateType: "date", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.BinaryType: "blob"}
    table = TableSpec(name, {key: ColumnSpec(1, key, "int", role="k")})
    for f in df.schema:
        kind = kinds.get(type(f.dataType)) or ("int" if isinstance(f.dataType, T.IntegralType) else "float" if isinstance(f.dataType, T.NumericType) else "str")
        if f.name != key:
            table.columns[f.name] = ColumnSpec(len(table.columns) + 1, f.name, kind, **{k: f.metadata[k] for k in ("valuetype", "role", "parent", "description") if k in f.metadata})
    return table


def mapped_columns(df: DataFrame, source: str, changes: list[tuple[str, str, str]]) -> DataFrame:
    """``df`` under the names that a list of (source, source column, destination column) gives it."""
    return df.withColumnsRenamed({old: new for s, old, new in changes if s == source and old != new})


def schema_of_run(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], first: int = 20) -> T.StructType:
    """The schema that a pipeline of steps gives; nothing is read, but a step that must look at rows sees the first ones."""
    made = df.limit(first)
    for step in steps:
        made = made.transform(step)
    return made.schema


def declared_schema(spark: SparkSession, path: str) -> dict[str, TableSpec]:
    """Table specs from a CSV of columns: table, column, datatype, valuetype, role, parent, description, transform; in file order where it has no position."""
    tables: dict[str, TableSpec] = {}
    for row in spark.read.option("header", True).csv(path).collect():  # one row for each declared column
        r = row.asDict()
        spec = tables.setdefault(r["table"], TableSpec(r["table"]))
        kind = r.get("datatype") or (valuetypes.resolved(r["valuetype"]).datatype if r.get("valuetype") else "str")
        place = int(r.get("position") or len(spec.columns) + 1)
        spec.columns[r["column"]] = ColumnSpec(place, r["column"], kind, *((r.get(k) or "") for k in ("valuetype", "role", "parent", "description")), transform=r.get("transform") or "")
    return tables


def schema_rows(spark: SparkSession, tables: list[TableSpec]) -> DataFrame:
    """The reverse: one row for each column; attributes that no column has are left out."""
    names = ("datatype", "valuetype", "role", "parent", "description", "transform")
    rows = [(t.name, c.position, c.name, *(getattr(c, n) or None for n in names)) for t in tables for c in t.columns.values()]
    df = spark.createDataFrame(rows, "table string, position int, column string, " + ", ".join(f"{n} string" for n in names))
    used = [n for i, n in enumerate(names) if any(r[3 + i] for r in rows)]
    return df.select("table", "position", "column", *used)


def by_role(schema: T.StructType, role: str) -> list[str]:
    """Columns of a role (d dimension, m measure, e error, k key, i identifier) that hang on no other."""
    return [f.name for f in schema if f.metadata.get("role") == role and not f.metadata.get("parent")]


def children(schema: T.StructType, name: str, valuetype: str | None = None) -> list[str]:
    """Columns whose parent is ``name``, of a value type if given (label, geoid, …)."""
    return [f.name for f in schema if f.metadata.get("parent") == name and (valuetype is None or f.metadata.get("valuetype", "").split("/")[0] == valuetype)]
