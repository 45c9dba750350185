"""Personal data by bootstrapped contextual extraction.

Base patterns find the seeds: e-mail addresses, IP addresses, card and phone numbers.  The
two words before a mention are its lexical pattern.  The same pass notes candidates, tokens
that look like identifiers but fit no base pattern, with the kinds that they could be.

Patterns and instances form a graph that Spark scores in rounds.  A pattern is as reliable
for a kind as its believed instances of the kind outweigh what contradicts it: instances
that are of another kind or cannot be of this one count against it in full, instances that
nothing is known of by `UNKNOWN`.  An instance is as believable as the reliable patterns
that extract it make it.  Believed instances count as support in the next round, also for
patterns that no seed has; what a pattern itself made believed counts for others only, so
no pattern vouches for itself.  After `ROUNDS` rounds, how far belief may travel from a
seed, every mention of a believed instance becomes a span of its kind; base spans always
stay.

Distinct instances count, so copies of one text lend no weight.  The graph never leaves
Spark and is aggregated before each shuffle.  Null texts count as empty; an empty table
gives an empty result; repeated rows give repeated results; texts of any length are
scanned whole, in linear time; spans that start together are ordered by kind, then end.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datakiln.jobs import scratch
from datakiln.llm import spans as sp

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring, distinct instances that support a pattern at least, the trust from which a pattern extracts, and
#: the belief from which an instance counts.
ROUNDS, LEAST_SUPPORT, TRUSTED, BELIEVED = 5, 3, 0.5, 0.8
#: How much an instance that nothing is known of counts against its pattern, beside one that contradicts it.
UNKNOWN = 0.3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Tokens that look like an identifier: digits with separators, or two names around an at sign, spelt or not.
NUMBER_LIKE = re.compile(r"(?<![\w+(.-])[+(]?[0-9](?:[\x20().-]?[0-9()]){6,}(?![\w.-])")
MAIL_LIKE = re.compile(r"(?<!\S)[\w.+-]++\x20?(?:@|\(at\)|\[at\])\x20?[\w-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[\w-]++)*+")
WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    """Whether a number passes the check: every second digit from the right doubled, the sum divisible by 10."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        else:
            floor = max(floor, at)
        at = text.find("@", max(at + 1, floor))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers at a time along each dotted run; those with a part above 255 are dropped."""
    for m in DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        at, parts = m.start(), run.split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base patterns, in order."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", a, b) for a, b in addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m.group())) <= 15:
                    found.append(("phone", *m.span()))
    return sp.in_order(found, KINDS)


def patterns_before(text: str, places: list[int]) -> list[str]:
    """For each place the two words before it in lower case, digits as #; '' where there are not two.

    One pass over the words, so long texts with many places stay cheap.
    """
    words = [m.span() for m in WORD.finditer(text)]
    starts = [a for a, _ in words]
    found = []
    for place in places:
        n = bisect_left(starts, place)  # the words that start before the place; the last may run into it
        two = [text[a : min(b, place)].lower() for a, b in words[max(0, n - 2) : n]]
        found.append(DIGIT.sub("#", " ".join(two)) if len(two) == 2 else "")
    return found


def could_be(token: str) -> str:
    """The kinds that a candidate could be, joined by commas."""
    digits = "".join(DIGIT.findall(token))
    if any(mark in token for mark in "@[a"):  # the marks of an address, spelt or not
        return "email"
    kinds = [k for k, fits in (("card", 12 <= len(digits) <= 19 and luhn(digits)), ("phone", 7 <= len(digits) <= 15)) if fits]
    return ",".join(kinds)


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and candidates: kind ('' for candidates), what candidates could be, start, end, pattern and a hash of the instance."""
    likely = [("", *m.span()) for m in NUMBER_LIKE.finditer(text)] if DIGIT.search(text) else []
    if "@" in text or "at)" in text or "at]" in text:
        likely += [("", *m.span()) for m in MAIL_LIKE.finditer(text)]
    places = base + sp.outside(likely, base)
    rows = []
    for (kind, a, b), pattern in zip(places, patterns_before(text, [a for _, a, _ in places]), strict=True):
        instance = xxhash.xxh3_64_intdigest(re.sub(r"[\s().-]", "", text[a:b].lower())) - (1 << 63)
        rows.append({"kind": kind, "fits": "" if kind else could_be(text[a:b]), "start": a, "end": b, "pattern": pattern, "instance": instance})
    return rows


MENTION = pa.struct([("kind", pa.string()), ("fits", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("instance", pa.int64())])
SCAN = "struct<base:array<struct<kind:string,start:int,end:int>>,noted:array<struct<kind:string,fits:string,start:int,end:int,pattern:string,instance:long>>>"


def scan(text: Column) -> Column:
    """One pass over a text column: base spans, and mentions for the graph."""

    @F.arrow_udf(SCAN)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in sp.batches_of(batches):
            base = [base_spans(t) for t in texts]
            met = [mentions(t, b) for t, b in zip(texts, base, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(map(sp.as_rows, base), sp.ARROW_SPANS), pa.array(met, pa.list_(MENTION))], ["base", "noted"])

    return scanned(text)


def graph_of(mentioned: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions (kind, fits, pattern, instance) to what could be extracted (pattern, instance, kind) and to (pattern, kind, seeds, fitting, instances).

    Patterns that cannot find enough support, having too few instances, are left out.
    """
    edges = mentioned.filter("pattern <> ''").groupBy("pattern", "instance").agg(F.max("fits").alias("fits"))
    wide = edges.groupBy("pattern").agg(F.count("*").alias("instances")).filter(F.col("instances") >= LEAST_SUPPORT)
    known = scratch.save(edges.join(wide, "pattern").join(seeds, "instance", "left"), "graph")
    split = known.filter("kind is null and fits <> ''").drop("kind")
    could = scratch.save(split.select("pattern", "instance", F.explode(F.split("fits", ",")).alias("kind")), "candidates")
    one, none = F.lit(1), F.lit(0)
    sides = known.filter("kind is not null").select("pattern", "kind", one.alias("seeds"), none.alias("fitting")).union(could.select("pattern", "kind", none, one))
    counted = sides.groupBy("pattern", "kind").agg(F.sum("seeds").alias("seeds"), F.sum("fitting").alias("fitting"))
    return could, scratch.save(counted.join(wide, "pattern"), "patterns")


def believed_instances(mentioned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Mentions (kind, fits, pattern, instance) to (instance, kind): the seeds, and what reliable patterns make believed."""
    seeds = scratch.save(mentioned.filter("kind <> ''").groupBy("instance").agg(F.max("kind").alias("kind")), "seeds")
    could, patterns = graph_of(mentioned, seeds)
    doubt = F.log1p(-F.least(F.col("trust"), F.lit(0.999)))
    votes = beliefs = None
    for _ in range(rounds):
        if votes is None:
            helped = patterns.select("pattern", "kind", F.lit(0.0).alias("helped"), F.lit(0).alias("helpers"))
        else:
            # what the other patterns of an instance say of it
            own = could.join(votes.select("pattern", "instance", "kind", doubt.alias("own")), ["pattern", "instance", "kind"], "left")
            others = own.join(beliefs, ["instance", "kind"]).withColumn("belief", 1 - F.exp(F.col("doubts") - F.coalesce("own", F.lit(0.0))))
            helped = others.filter(F.col("belief") >= BELIEVED).groupBy("pattern", "kind").agg(F.sum("belief").alias("helped"), F.count("*").alias("helpers"))
        scored = patterns.join(helped, ["pattern", "kind"], "left").na.fill(0, ["helped", "helpers"])
        support, against = F.col("seeds") + F.col("helped"), F.col("instances") - F.col("seeds") - F.col("fitting") + UNKNOWN * (F.col("fitting") - F.col("helpers"))
        enough = F.col("seeds") + F.col("helpers") >= LEAST_SUPPORT
        trusted = scored.filter(enough).select("pattern", "kind", (support / (support + against)).alias("trust")).filter(F.col("trust") >= TRUSTED)
        votes = scratch.save(could.join(trusted, ["pattern", "kind"]), "votes")
        if votes.isEmpty():
            break
        beliefs = scratch.save(votes.groupBy("instance", "kind").agg(F.sum(doubt).alias("doubts")), "beliefs")
    if beliefs is None:
        return seeds
    sure = beliefs.withColumn("belief", 1 - F.exp("doubts")).filter(F.col("belief") >= BELIEVED)
    return seeds.unionByName(sure.groupBy("instance").agg(F.max_by("kind", F.struct("belief", "kind")).alias("kind")))


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (arrays of spans, the second with those the method adds); one row for each row.

    ``keep`` names the columns that are carried along (all, if None); what is not named is
    not written with the intermediate rows.  Columns of ``docs`` that are named as ``base``
    and ``spans`` are replaced, others may have any names.
    """
    rows, row, note = sp.noted(docs, keep, scan(F.col(text)), base, spans, "pii")
    mentioned = rows.select(F.col(row).alias("row"), F.explode(note).alias("m")).select("row", "m.*")
    open_ = mentioned.filter("kind = '' and fits <> ''").withColumnRenamed("kind", "none")
    known = open_.join(believed_instances(mentioned), "instance").filter(F.array_contains(F.split("fits", ","), F.col("kind")))
    waiting = F.exists(note, lambda m: (m["kind"] == "") & (m["fits"] != ""))
    return sp.add_spans(rows, row, known.select("row", "kind", "start", "end"), waiting, KINDS, base, spans).drop(row, note)


def report(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, base_sha256 and the spans as text, beside doc_id."""
    counts = [sp.counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(sp.written(F.col("base")), 256).alias("base_sha256"), sp.written(F.col("spans")).alias("spans"))
