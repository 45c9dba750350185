"""SQL scripts over partitions by name.

Spark parses the SQL.  Here only names of partitions after FROM and JOIN become views, and
statements run in the order of the rules, wherever they stand: drops (last first), then what is
to be materialised, installed, indexed and created, in the order of the text; the first SELECT
comes last and is the result.

The columns on which a statement joins partitions are found in the plan that Spark makes of it;
`Warehouse.index_joins` saves these partitions once, bucketed on them, so that the joins of
this and later statements need no shuffle.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from datakiln.operators.headers import unused

#: Fixed forms of the statements that are not plain SQL.
COMMAND = re.compile(r"^\s*(install|materialize|index)\s+(.+?)\s*$", re.IGNORECASE | re.DOTALL)
QUOTED = r"'(?:[^']|\'\')*'|\"[^\"]*\"|`[^`]*`"


def statements(script: str) -> list[str]:
    """Statements of a script without comments; semicolons inside quotes do not count."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: " ", script, flags=re.DOTALL) if "'" not in script else _without_comments(script)
    parts, held, quote = [], [], ""
    for c in bare:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == ";":
            parts.append("".join(held))
            held = []
            continue
        held.append(c)
    return [p.strip() for p in [*parts, "".join(held)] if p.strip()]


def _without_comments(script: str) -> str:
    token = re.compile(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", re.DOTALL)
    return token.sub(lambda m: m.group() if m.group().startswith("'") else " ", script)


def view_name(partition: str) -> str:
    """The view of a partition: its name in word characters."""
    return re.sub(r"\W+", "_", partition).strip("_").lower()


def substituted(sql: str, views: dict[str, str]) -> tuple[str, list[str]]:
    """The SQL with partition names (the keys of ``views``) after FROM and JOIN as view names, and the names found.

    Nothing else is touched: no other dotted name, and nothing inside quotes.
    """
    if not views:
        return sql, []
    names = "|".join(re.escape(n) for n in sorted(views, key=len, reverse=True))
    found: list[str] = []

    def swap(m: re.Match) -> str:
        if m.group("name") is None:
            return m.group()
        found.append(m.group("name"))
        return f"{m.group('before')}{views[m.group('name')]}"

    return re.sub(rf"{QUOTED}|(?P<before>\b(?:from|join)\s+)(?P<name>{names})(?=[\s,;)]|$)", swap, sql, flags=re.IGNORECASE), list(dict.fromkeys(found))


@dataclass
class Warehouse:
    """Partitions by name (Parquet paths) served as SQL."""

    spark: SparkSession
    partitions: dict[str, str] = field(default_factory=dict)
    installed: set[str] = field(default_factory=set)
    views: dict[str, str] = field(default_factory=dict)
    #: Partition to the columns that `index_joins` has bucketed it on.
    bucketed: dict[str, list[str]] = field(default_factory=dict)

    def named(self) -> dict[str, str]:
        """The view of each partition; names that differ in other than word characters get views of their own."""
        for partition in self.partitions:
            if partition not in self.views:
                self.views[partition] = unused(view_name(partition), list(self.views.values()))
        return self.views

    def path(self, partition: str) -> str:
        if partition not in self.partitions:
            raise KeyError(f"no partition {partition!r}")
        return self.partitions[partition]

    def install(self, partition: str) -> str:
        """A lazy view of a partition."""
        self.spark.read.parquet(self.path(partition)).createOrReplaceTempView(self.named()[partition])
        self.installed.add(partition)
        return self.named()[partition]

    def materialize(self, partition: str, columns: list[str] | None = None, buckets: int = 32) -> str:
        """A saved table of a partition, bucketed and sorted by ``columns`` so that later joins on them need no shuffle."""
        self.check_shared()
        rows = self.spark.read.parquet(self.path(partition))
        writer = rows.write.mode("overwrite").format("parquet")
        if columns:
            writer = writer.bucketBy(buckets, *columns).sortBy(*columns)
        writer.saveAsTable(self.named()[partition])
        self.installed.add(partition)
        return self.named()[partition]

    def check_shared(self) -> None:
        """An error where saved tables would go to a folder of one machine of several."""
        named = self.spark.sparkContext.getConf().get("spark.sql.warehouse.dir")
        if not named and self.spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.sql.warehouse.dir must name a folder that the driver and all executors share")

    def join_columns(self, sql: str) -> dict[str, list[str]]:
        """Partition to the columns on which the statement joins it first, by equality with another partition."""
        text, names = substituted(sql, self.named())
        for name in names:
            if name not in self.installed:
                self.install(name)
        plan = self.spark.sql(text)._jdf.queryExecution().analyzed()  # noqa: SLF001
        owner: dict[int, tuple[str, str]] = {}
        found: dict[str, list[str]] = {}
        by_view = {self.named()[n]: n for n in names}

        def each(seq):
            return [seq.apply(i) for i in range(seq.size())]

        def walk(node) -> None:
            for child in each(node.children()):
                walk(child)
            if node.nodeName() == "SubqueryAlias" and (view := node.alias()) in by_view:
                for a in each(node.output()):
                    owner[a.exprId().id()] = (by_view[view], a.name())
            elif node.nodeName() == "SubqueryAlias":  # another name for what is below keeps its columns
                pass
            elif node.nodeName() == "Join" and node.condition().isDefined():
                pairs: dict[tuple[str, str], list[tuple[str, str]]] = {}
                for a, b in equalities(node.condition().get()):
                    if a in owner and b in owner and owner[a][0] != owner[b][0]:
                        one, other = sorted((owner[a], owner[b]))
                        pairs.setdefault((one[0], other[0]), []).append((one[1], other[1]))
                for sides, columns in pairs.items():
                    if not any(side in found for side in sides):
                        for nth, side in enumerate(sides):
                            found[side] = [c[nth] for c in columns]

        def equalities(e) -> list[tuple[int, int]]:
            if e.nodeName() == "And":
                return equalities(e.left()) + equalities(e.right())
            if e.nodeName() == "EqualTo" and e.left().nodeName() == e.right().nodeName() == "AttributeReference":
                return [(e.left().exprId().id(), e.right().exprId().id())]
            return []

        walk(plan)
        return found

    def index_joins(self, sql: str, buckets: int = 32) -> dict[str, list[str]]:
        """The partitions that a statement joins saved once, bucketed on the columns of the join; what was bucketed before stays."""
        wanted = {p: columns for p, columns in self.join_columns(sql).items() if self.bucketed.get(p) != columns}
        for partition, columns in wanted.items():
            self.spark.catalog.dropTempView(self.named()[partition])
            self.materialize(partition, columns, buckets)
            self.bucketed[partition] = columns
        return wanted

    def query(self, sql: str) -> DataFrame:
        """One statement; partitions that it names are installed first."""
        text, names = substituted(sql, self.named())
        for name in names:
            if name not in self.installed:
                self.install(name)
        return self.spark.sql(text)

    def run(self, script: str) -> DataFrame | None:
        """A whole script; the first SELECT runs after all else and is returned, lazily."""
        all_of = statements(script)
        kind = lambda s: re.match(r"\w+", s).group().lower()
        for s in reversed([s for s in all_of if kind(s) == "drop"]):
            self.spark.sql(substituted(s, self.named())[0])
        commands = [(m.group(1).lower(), m.group(2)) for s in all_of if (m := COMMAND.match(s))]
        for what in ("materialize", "install", "index"):
            for name in (rest for command, rest in commands if command == what):
                if what == "index":
                    partition, columns = re.match(r"(\S+)\s*\(([^)]*)\)", name).groups()
                    self.materialize(partition, [c.strip() for c in columns.split(",")])
                else:
                    getattr(self, what)(name.strip())
        for s in all_of:
            if kind(s) != "create":
                continue
            materialised = re.match(r"^\s*create\s+materialized\s+view\s+(\w+)\s+as\s+(.*)$", s, re.IGNORECASE | re.DOTALL)
            if materialised:
                self.check_shared()
                self.query(materialised.group(2)).write.mode("overwrite").saveAsTable(materialised.group(1))
            else:
                self.query(re.sub(r"^\s*create\s+(?:or\s+replace\s+)?(?:temp\s+|temporary\s+)?view", "CREATE OR REPLACE TEMP VIEW", s, flags=re.IGNORECASE))
        first = next((s for s in all_of if kind(s) in ("select", "with")), None)
        return None if first is None else self.query(first)
