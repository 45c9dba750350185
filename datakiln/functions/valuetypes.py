"""Semantic types of columns: physical type, role, level of measurement, and how values are read."""

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column

from datakiln.functions import casts, values

ROLES = {"d": "dimension", "m": "measure", "e": "error", "k": "key", "i": "identifier", "u": "unknown"}
LEVELS = {"n": "nominal", "o": "ordinal", "i": "interval", "r": "ratio"}


@dataclass(frozen=True)
class ValueType:
    """A value type; ``parameters`` hold what follows the registered code, as in margin/90."""

    code: str
    datatype: str
    role: str
    level: str
    read: Callable[[Column], Column] | None = None
    parameters: tuple[str, ...] = ()

    @property
    def registered(self) -> str:
        """The code without its parameters."""
        return self.code.removesuffix("/" + "/".join(self.parameters))

    def cast(self, c: Column) -> Column:
        return self.read(c) if self.read else casts.cast_to(c, self.datatype)


def _family(role: str, level: str, datatype: str, codes: str, read: Callable[[Column], Column] | None = None) -> dict[str, ValueType]:
    return {code: ValueType(code, datatype, role, level, read) for code in codes.split()}


REGISTRY: dict[str, ValueType] = (
    _family("u", "r", "int", "int long")
    | _family("u", "r", "float", "float")
    | _family("u", "n", "str", "text str unicode")
    | _family("d", "o", "date", "date")
    | _family("d", "o", "datetime", "datetime")
    | _family("d", "o", "time", "time")
    | _family("d", "o", "int", "year month", values.year_start)
    | _family("d", "o", "str", "year/range", values.range_text)
    | _family("d", "o", "str", "interval interval/iso", values.interval_text)
    | _family("d", "n", "str", "label/geo geoid geoid/tiger geoid/census geoid/county geoid/census/tract geoid/tract gvid wkt zipp4")
    | _family("d", "n", "str", "stusab", lambda c: values.F.lower(casts.stripped(c)))
    | _family("d", "n", "int", "fips fips/state fips/county geo/int gnis census zip zcta")
    | _family("d", "i", "float", "lat lon")
    | _family("k", "n", "int", "key")
    | _family("i", "n", "str", "id")
    | _family("d", "n", "str", "dimension dimension/str dimension/text label name/first name/last name/middle raceth raceth/hci raceth/cen00 raceth/cen10 raceth/omb")
    | _family("d", "o", "int", "dimension/int age decile quartile quintile")
    | _family("d", "o", "str", "age/range", lambda c: values.age_text(values.census_age(c)))
    | _family("d", "o", "float", "pctl percentile", values.percent)
    | _family("m", "r", "float", "measure density ratio z")
    | _family("m", "r", "int", "measure/int measure/long count")
    | _family("m", "r", "float", "rate proportion", values.share)
    | _family("m", "r", "float", "pct percent", values.percent)
    | _family("e", "r", "float", "margin ci se rse")
    | _family("u", "n", "str", "other other/text")
    | _family("u", "r", "int", "other/int")
    | _family("u", "r", "float", "other/float")
)


def resolved(code: str) -> ValueType:
    """The value type of a code: the longest registered head; what follows becomes parameters."""
    parts = code.rstrip("?").strip("/").split("/")
    for n in range(len(parts), 0, -1):
        if found := REGISTRY.get("/".join(parts[:n])):
            return replace(found, code="/".join(parts), parameters=tuple(parts[n:]))
    raise KeyError(f"no value type {code!r}")
