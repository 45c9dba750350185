"""Secret scans with multipart credential linking.

Base patterns find assignments of secrets, access keys and long hexadecimal runs; these are
always reported.  Weak candidates, such as a login name, a password by another name, or an
address of a service, say nothing alone.  They are linked by interval joins inside a scope
of `SCOPE` characters: a weak secret is reported only if an identifier and an endpoint both
lie in its scope, a weak identifier only if it lies in the scope of such a secret.

The joins run on (text, interval of scope length), so a group holds what fits into a few
scopes however long the text is, and they are semi joins: no pairs are made.  A weak
value is taken to its end, however long; what base spans cover of it is left to them.
Distances are measured between starts.  Null texts
count as empty; repeated rows give repeated results; texts of any length are scanned whole,
in linear time; spans that start together are ordered by kind, then end; an empty table
gives an empty result.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datakiln.jobs import scratch
from datakiln.llm import spans as sp

KINDS = ("assign", "access", "hex", "weak_secret", "weak_id")
BASE = KINDS[:3]
#: Characters that a weak value, or what base spans leave of it, has at least.
LEAST = {"secret": 6, "id": 3}
SCOPE = 400

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
SET = r"""["']?\x20*+[:=]\x20*+["']?"""
WEAK = (
    ("secret", re.compile(rf"(?<![A-Za-z])(?:pwd|pass|passphrase|credentials?|auth|private[_ -]?key)(?![A-Za-z]){SET}([^\s\"'<>]{{6,}}+)", re.ASCII | re.IGNORECASE)),
    ("id", re.compile(rf"(?<![A-Za-z])(?:access[_ -]?key[_ -]?id|client[_ -]?id|user(?:[_ -]?name)?|login|account)(?![A-Za-z]){SET}([A-Za-z0-9_.@-]{{3,}}+)", re.ASCII | re.IGNORECASE)),
    ("endpoint", re.compile(rf"(?:(?<=[a-z0-9+.-])://|(?<![A-Za-z])(?:host(?:name)?|server|endpoint|url){SET})([^\s\"'<>]{{4,}}+)", re.ASCII | re.IGNORECASE)),
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base patterns, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sp.in_order(found, KINDS)


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Parts of possible credentials by role (secret, id, endpoint), outside the base spans."""
    if "=" not in text and ":" not in text:
        return []
    parts = [(role, *m.span(1)) for role, pattern in WEAK for m in pattern.finditer(text)]
    values = sp.left_over([p for p in parts if p[0] in LEAST], base)
    return [p for p in values if p[2] - p[1] >= LEAST[p[0]]] + sp.outside([p for p in parts if p[0] not in LEAST], base)


def scan(text: Column) -> Column:
    """One pass over a text column: base spans and weak parts."""

    @F.arrow_udf(f"struct<base:{sp.SPANS},noted:{sp.SPANS}>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in sp.batches_of(batches):
            base = [base_spans(t) for t in texts]
            parts = [weak_parts(t, b) for t, b in zip(texts, base, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(map(sp.as_rows, x), sp.ARROW_SPANS) for x in (base, parts)], ["base", "noted"])

    return scanned(text)


def in_scope(parts: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """The ``parts`` (row, start, end, …) with any of ``others`` (row, start) within ``scope`` characters."""
    slot = F.floor(F.col("start") / scope)
    near = others.select(F.col("row").alias("r"), F.col("start").alias("s"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot")).distinct()
    here = parts.withColumn("at", slot)
    met = (F.col("row") == F.col("r")) & (F.col("at") == F.col("slot")) & (F.abs(F.col("start") - F.col("s")) <= scope)
    return here.join(near, met, "left_semi").drop("at")


def linked(weak: DataFrame, strong: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts and base spans (row, role, start, end) to (row, kind, start, end) of the weak parts whose complementary parts co-occur in scope."""
    ids = weak.filter("role = 'id'")
    all_ids = ids.union(strong.filter("role = 'access'"))
    ends = weak.filter("role = 'endpoint'")
    complete = in_scope(in_scope(weak.filter("role = 'secret'"), all_ids, scope), ends, scope)
    strong_complete = in_scope(in_scope(strong.filter("role in ('assign', 'hex')"), all_ids, scope), ends, scope)
    named = in_scope(ids, complete.union(strong_complete), scope)
    return complete.withColumn("kind", F.lit("weak_secret")).union(named.withColumn("kind", F.lit("weak_id"))).select("row", "kind", "start", "end")


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (arrays of spans, the second with linked weak parts); one row for each row.

    ``keep`` names the columns that are carried along (all, if None); what is not named is
    not written with the intermediate rows.  Columns of ``docs`` that are named as ``base``
    and ``spans`` are replaced, others may have any names.
    """
    rows, row, note = sp.noted(docs, keep, scan(F.col(text)), base, spans, "secrets")
    waiting = F.size(note) > 0

    def each(column: str) -> DataFrame:
        parts = rows.filter(waiting).select(F.col(row).alias("row"), F.explode(column).alias("p"))
        return parts.select("row", F.col("p.kind").alias("role"), "p.start", "p.end")

    return sp.add_spans(rows, row, linked(each(note), each(base)), waiting, KINDS, base, spans).drop(row, note)


def report(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, base_sha256 and the spans as text, beside doc_id."""
    counts = [sp.counted(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(sp.written(F.col("base")), 256).alias("base_sha256"), sp.written(F.col("spans")).alias("spans"))
