"""Search over descriptions: documents, an inverted index as a table, ranking, fuzzy names.

The index is (term, field, doc, tf), counted inside each document, and may be stored in
segments.  A query filters the index by its few terms first; ranking then works on the hits alone.
"""

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, count, takewhile
from math import comb

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datakiln.functions.values import all_in_upper, cut
from datakiln.jobs import scratch

FIRST_YEAR, LAST_YEAR = 1970, 2029
#: Own rule: the weight of a hit in each field.
WEIGHTS = {"title": 3.0, "keywords": 2.0, "doc": 1.0}
SIMILAR, MOST_FOUND = 0.3, 10
MARKERS = ("about", "in", "by", "with", "from", "to", "source")


#: What stands between the terms of a text.
APART = r"[^\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), APART), lambda t: t != "")


def dataset_documents(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc, title, doc_text, keywords): the text of a dataset from its names and those of its columns.

    ``datasets``: id, title, summary, keywords; ``columns``: dataset_id, name, description.
    """
    words = columns.groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "name", "description"))), " ").alias("names"))
    joined = datasets.join(words, datasets.id == words.dataset_id, "left")
    return joined.select(F.col("id").alias("doc"), "title", F.concat_ws(" ", "title", "summary", "names").alias("text"), F.coalesce("keywords", F.lit("")).alias("keywords"))


def partition_documents(partitions: DataFrame, values: DataFrame) -> DataFrame:
    """(doc, title, text, keywords): a partition by its name, its values (cut) and what it covers.

    ``partitions``: id, name, description, years, places, grains; ``values``: partition_id, value.
    """
    each = values.groupBy("partition_id").agg(F.array_join(F.array_sort(F.collect_set(cut(F.col("value")))), " ").alias("held"))
    joined = partitions.join(each, partitions.id == each.partition_id, "left")
    covers = F.concat_ws(" ", F.array_join(F.col("years").cast("array<string>"), " "), F.array_join("places", " "), F.array_join("grains", " "))
    return joined.select(F.col("id").alias("doc"), F.col("name").alias("title"), F.concat_ws(" ", "name", "description", "held").alias("text"), covers.alias("keywords"))


def counted(terms: Column) -> Column:
    """The distinct terms of a list with how often it has them: array<struct<term, tf>>.

    Sorted, a term starts where it differs from the one before; a row is counted on its own,
    so a task holds one text and no batch of them.
    """

    def each(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))  # and the end of the last
        return named(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.get(at, j + 1) - i).cast("long").alias("tf"))))

    return F.filter(named(F.sort_array(terms), each), lambda t: t["tf"].isNotNull())


def named(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``c``, which is computed once however often it stands there."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def inverted_index(docs: DataFrame, fields: dict[str, str], doc: str = "doc", terms: list[str] | None = None) -> DataFrame:
    """(term, field, doc, tf) of the texts in ``fields`` (field name to column), of all terms or of some.

    A row is a document and its terms are counted in it, so nothing is shuffled; rows that
    repeat a doc give entries each, which the look-ups below add up.
    """
    wanted = lambda t: t if terms is None else F.filter(t, lambda x: x.isin(terms))
    parts = F.array(*[F.struct(F.lit(name).alias("field"), wanted(tokens(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias("terms")) for name, c in fields.items()])
    each = docs.select(F.col(doc).alias("doc"), F.explode(parts).alias("p"))
    return each.select("doc", "p.field", F.explode(counted(F.col("p.terms"))).alias("t")).select("t.term", "field", "doc", "t.tf")


def extended_index(index: DataFrame, docs: DataFrame, fields: dict[str, str], doc: str = "doc", force: bool = False) -> DataFrame:
    """The index with documents that it lacks; where ``force`` their old entries go first."""
    ids = docs.select(F.col(doc).alias("doc")).distinct()
    if force:
        return index.join(ids, "doc", "left_anti").unionByName(inverted_index(docs, fields, doc))
    new = docs.join(index.select(F.col("doc").alias(doc)).distinct(), doc, "left_anti")
    return index.unionByName(inverted_index(new, fields, doc))


def without_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("doc").distinct(), "doc", "left_anti")


#: Buckets of a stored index by the hash of the term.
BUCKETS = 64


@dataclass(frozen=True)
class StoredIndex:
    """An inverted index in a folder: segments of additions and deletions, merged when it is read.

    An addition is a segment of postings in directories by the bucket of their term, and of its doc ids;
    a deletion is a segment of doc ids.  Segments are numbered; an entry counts unless a later
    segment deletes its document.  Adding reads the new documents and the ids alone, a
    look-up the buckets of its terms, and compaction writes what counts as one segment.
    """

    spark: SparkSession
    path: str
    fields: dict[str, str] = field(default_factory=dict)
    buckets: int = BUCKETS

    def segments(self) -> list[int]:
        """The numbers of the segments in order; one small row each."""
        try:
            held = self.spark.read.parquet(f"{self.path}/segments")
        except AnalysisException:  # nothing was added yet
            return []
        return sorted(r.segment for r in held.select("segment").distinct().collect())

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _noted(self, segment: int, kind: str) -> None:
        """A segment counts once this row is there, so one that was cut off does not."""
        self.spark.createDataFrame([(segment, kind)], "segment int, kind string").coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def _next(self) -> int:
        return max(self.segments(), default=0) + 1

    def add(self, docs: DataFrame, doc: str = "doc", force: bool = False) -> int:
        """Documents that the index lacks, or (``force``) all of these in the place of their old entries; the new segment's number."""
        number = self._next()
        ids = docs.select(F.col(doc).alias("doc"))
        if force:
            ids.distinct().write.mode("overwrite").parquet(f"{self.path}/gone/segment={number}")
        elif number > 1:
            docs = docs.join(self.documents().withColumnRenamed("doc", doc), doc, "left_anti")
        docs.select(F.col(doc).alias("doc")).distinct().write.mode("overwrite").parquet(f"{self.path}/docs/segment={number}")
        entries = inverted_index(docs, self.fields, doc).withColumn("bucket", self.bucket(F.col("term")))
        entries.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={number}")
        self._noted(number, "added")
        return number

    def delete(self, ids: DataFrame) -> int:
        """(doc) are no more; the new segment's number."""
        number = self._next()
        ids.select("doc").distinct().write.mode("overwrite").parquet(f"{self.path}/gone/segment={number}")
        self._noted(number, "deleted")
        return number

    def _live(self, kind: str, columns: str) -> DataFrame:
        """Rows (…, doc, segment) of the counted segments, less those that a later segment deletes."""
        known = self.segments()
        held = self._rows(kind, known, columns)
        gone = self._rows("gone", known, f"doc {held.schema['doc'].dataType.simpleString()}").groupBy("doc").agg(F.max("segment").alias("until"))
        # an addition that replaces its own documents deletes those of earlier segments
        return held.join(gone, "doc", "left").filter("until is null or segment >= until").drop("until")

    def _rows(self, kind: str, known: list[int], columns: str) -> DataFrame:
        try:
            found = self.spark.read.parquet(f"{self.path}/{kind}")
        except AnalysisException:
            return self.spark.createDataFrame([], f"{columns}, segment int")
        return found.filter(F.col("segment").isin(known))

    def documents(self) -> DataFrame:
        """(doc) of what the index holds."""
        return self._live("docs", "doc long").select("doc").distinct()

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, field, doc, tf), of all terms or of some: then only their buckets are read."""
        held = self._live("postings", "term string, field string, doc long, tf long, bucket int")
        if terms is not None:
            wanted = self.spark.range(1).select(F.array(*[self.bucket(F.lit(t)) for t in terms]).alias("b")).first().b if terms else []
            held = held.filter(F.col("bucket").isin(wanted) & F.col("term").isin(list(terms)))
        return held.select("term", "field", "doc", "tf")

    def compact(self) -> int:
        """What counts as one segment; the old segments' rows are no longer read, and their files removed."""
        known, number = self.segments(), self._next()
        self.documents().write.mode("overwrite").parquet(f"{self.path}/docs/segment={number}")
        live = self.postings().withColumn("bucket", self.bucket(F.col("term")))
        live.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={number}")
        self.spark.createDataFrame([(number, "compacted")], "segment int, kind string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/segments")
        for old in known:
            for kind in ("docs", "gone", "postings"):
                scratch.remove(self.spark, f"{self.path}/{kind}/segment={old}")
        return number


@dataclass
class Phrase:
    """A parsed search: terms on the documents, places, grains, years and a source."""

    about: list[str] = field(default_factory=list)
    with_: list[str] = field(default_factory=list)
    in_: list[str] = field(default_factory=list)
    by: list[str] = field(default_factory=list)
    years: tuple[int, int] | None = None
    source: str | None = None


def parsed_phrase(text: str) -> Phrase:
    """Markers and the terms after them; what comes before any marker is "about".

    A year after "from" or "to" bounds the years, another word after "from" is a source;
    further words after a marker of one value belong to "about".  What stands in quotes is one
    term, and no marker or year.
    """
    phrase, marker = Phrase(), "about"
    low: int | None = None
    high: int | None = None
    for found in re.finditer(r"'([^']*)'|\"([^\"]*)\"|[\w.-]+", text.lower()):
        quoted = next((g for g in found.groups() if g is not None), None)
        word = found.group() if quoted is None else quoted.strip()
        if not word:
            continue
        if word in MARKERS and quoted is None:
            marker = word
            continue
        year = int(word) if quoted is None and re.fullmatch(r"\d{4}", word) and FIRST_YEAR <= int(word) <= LAST_YEAR else None
        if marker in ("from", "to") and year is not None:
            low, high = (year, high) if marker == "from" else (low, year)
        elif marker in ("from", "source"):
            phrase.source, marker = word, "about"
        elif marker == "to":
            phrase.about.append(word)
        else:
            target = {"about": phrase.about, "with": phrase.with_, "in": phrase.in_, "by": phrase.by}[marker]
            target.append(word)
            if marker == "by":
                marker = "about"
    if low is not None or high is not None:
        phrase.years = (low if low is not None else FIRST_YEAR, high if high is not None else LAST_YEAR)
    return phrase


def terms_of(phrases: list[str]) -> list[str]:
    """The distinct terms of words and of quoted terms, which have several; the index has no places, so all must be met."""
    return sorted({t for p in phrases for t in re.split(r"[\W_]+", p.lower()) if t})


def matching(index: DataFrame, terms: list[str], fields: list[str] | None = None) -> DataFrame:
    """Documents that have all terms (in the fields)."""
    wanted = terms_of(terms)
    hits = index.filter(F.col("term").isin(wanted))
    if fields:
        hits = hits.filter(F.col("field").isin(fields))
    return hits.groupBy("doc").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(wanted)).select("doc")


def ranked(index: DataFrame, terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(doc, score): over the terms and fields, the weight times the hits here by the hits in all documents."""
    weights, terms = weights or WEIGHTS, terms_of(terms)
    hits = index.filter(F.col("term").isin(terms))
    totals = hits.groupBy("term", "field").agg(F.sum("tf").alias("all"))
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("field")]
    scored = hits.join(totals, ["term", "field"]).withColumn("part", F.coalesce(weight, F.lit(0.0)) * F.col("tf") / F.col("all"))
    full = scored.groupBy("doc").agg(F.sum("part").alias("score"), F.count_distinct("term").alias("n"))
    return full.filter(F.col("n") == len(terms)).select("doc", "score")


def best_hits(hits: DataFrame, most: int = MOST_FOUND, key: str = "doc") -> DataFrame:
    """The ``most`` hits of the highest score, best first, ties by key."""
    return hits.orderBy(F.desc("score"), key).limit(most)


def in_years(partitions: DataFrame, years: tuple[int, int], inside: bool = True) -> DataFrame:
    """Partitions (first_year, last_year) that hold the asked range, or (not ``inside``) lie within it."""
    low, high = years
    if inside:
        return partitions.filter((F.col("first_year") <= low) & (F.col("last_year") >= high))
    return partitions.filter((F.col("first_year") >= low) & (F.col("last_year") <= high))


def rolled_up(datasets: DataFrame, partitions: DataFrame, source: str | None = None) -> DataFrame:
    """(dataset, score, partitions): own score and that of the partitions found; zero where partitions were asked for and none hit.

    ``datasets``: dataset, source, score; ``partitions``: dataset, score.
    """
    parts = partitions.groupBy("dataset").agg(F.sum("score").alias("part_score"), F.count("*").alias("partitions"))
    joined = datasets.join(parts, "dataset", "full")
    kept = joined.filter(F.col("source").contains(source)) if source else joined
    total = F.coalesce("score", F.lit(0.0)) + F.coalesce("part_score", F.lit(0.0))
    return kept.select("dataset", F.when(F.col("partitions").isNull(), 0.0).otherwise(total).alias("score"), F.coalesce("partitions", F.lit(0)).alias("partitions"))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words, each padded by two blanks in front and one behind; three code points of 21 bits in a long."""
    padded = F.transform(tokens(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    points = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p)), lambda i: F.ascii(F.substr(p, i, F.lit(1))).cast("long")))
    packed = lambda p, i: F.shiftleft(F.get(p, i), 42) + F.shiftleft(F.get(p, i + 1), 21) + F.get(p, i + 2)
    cut_up = F.transform(points, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 3), lambda i: packed(p, i)))
    return F.array_distinct(F.flatten(cut_up))


#: Thresholds that are tried before the one asked for: whoever has enough names at one needs none below it.
TRIED_FIRST = (0.9, 0.7, 0.5)
_EDGE = 1e-9
#: Trigrams that make one key of a name at most, and keys of a name where several make one.
MOST_TOGETHER, MOST_KEYS = 5, 32
#: Trigrams are counted by hash in so many buckets at most, whatever the scripts of the names: any order that both sides share finds all pairs.
MOST_COUNTS = 1 << 18


def gram_sets(names: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, grams, n) and (asked, grams, n): distinct texts with their trigrams, those that fewest names have first (by `MOST_COUNTS` buckets)."""
    tasks = names.sparkSession.sparkContext.defaultParallelism  # names are few bytes and much work
    sides = [df.select(c).repartition(tasks, c).distinct().withColumn("t", trigrams(F.col(c))) for df, c in ((names, "name"), (asked, "asked"))]
    bucket = F.pmod(F.xxhash64("g"), F.lit(MOST_COUNTS))
    held = sides[0].select(F.explode("t").alias("g")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("names"))

    def by_rarity(side: DataFrame, c: str) -> DataFrame:
        each = side.select(c, F.explode("t").alias("g")).join(F.broadcast(held), bucket == F.col("bucket"), "left")
        ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "g")))  # as many as the text has
        return each.groupBy(c).agg(F.transform(ordered, lambda x: x["g"]).alias("grams")).withColumn("n", F.size("grams"))

    return by_rarity(sides[0], "name"), by_rarity(sides[1], "asked")


def together(lacking: int) -> int:
    """Trigrams that make one key where ``lacking`` of a name's may be missing: as many as leave it `MOST_KEYS` keys."""
    return max([k for k in range(1, MOST_TOGETHER + 1) if comb(lacking + k, k) <= MOST_KEYS], default=1)


def gram_keys(grams: Column, n: Column, threshold: float) -> tuple[Column, Callable[[Column], Column]]:
    """The keys of a name (``n`` trigrams, rarest first), and how many trigrams make a key of a pair whose larger name has some number.

    Of n trigrams those of a pair share need = threshold * n at least, so the k rarest that they
    share are among the first n - need + k of either; each k of these make a key.  A name has
    keys for all k that it may have with a larger one.
    """
    few = list(takewhile(lambda e: together(e) > 1, count()))
    kinds = F.array(*[F.lit(together(e)) for e in few])
    cuts = {e * (MOST_TOGETHER + 1) + k: list(combinations(range(1, e + k + 1), k)) for e in few for k in range(2, MOST_TOGETHER + 1) if comb(e + k, k) <= MOST_KEYS}
    chosen = F.create_map(*[x for kind, sets in cuts.items() for x in (F.lit(kind), F.array(*[F.array(*map(F.lit, s)) for s in sets]))])
    need = lambda x: F.ceil(x * threshold - _EDGE).cast("int")
    size = lambda x: F.greatest(F.lit(1), F.least(F.coalesce(F.get(kinds, (x - need(x)).cast("int")), F.lit(1)), need(x)))
    lacking = n - need(n)
    alone = F.transform(F.slice(grams, F.lit(1), lacking + 1), lambda g: F.xxhash64(F.array(g)))
    several = lambda k: F.transform(chosen[lacking * (MOST_TOGETHER + 1) + k], lambda s: F.xxhash64(F.transform(s, lambda i: F.get(grams, i - 1))))
    sizes = F.array_distinct(F.transform(F.sequence(n, F.floor(n / threshold + _EDGE).cast("int")), size))
    return F.flatten(F.transform(sizes, lambda k: F.when(k == 1, alone).otherwise(several(k)))), size


def candidate_pairs(names: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """(asked, name, n, m: their sizes, both: what they share) of the pairs that may reach a similarity, each once.

    They share a key (`gram_keys`) of several of their rarest trigrams, if the threshold is high,
    since single ones may be in very many names; sizes may differ by the threshold at most.
    Spark takes the size of the exploded keys for that of the names' file, a hundred times too
    small, so neither side is left to be broadcast.
    """
    keys = F.explode(gram_keys(F.col("grams"), F.col("n"), threshold)[0])
    keyed = [side.withColumn("key", keys).withColumnsRenamed({"grams": t, "n": n}) for side, t, n in ((names, "t", "n"), (asked, "u", "m"))]
    sizes = (F.col("n") >= F.col("m") * threshold - _EDGE) & (F.col("m") >= F.col("n") * threshold - _EDGE)
    met = keyed[0].join(keyed[1].hint("merge"), "key").filter(sizes).select("asked", "name", "n", "m", "key", F.array_intersect("t", "u").alias("both"))
    size = gram_keys(F.col("both"), F.col("n"), threshold)[1](F.greatest("n", "m"))
    return met.filter(F.xxhash64(F.slice("both", F.lit(1), size)) == F.col("key")).drop("key")


def similar_pairs(names: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """(asked, name, similarity) of all pairs of `gram_sets` at or above the threshold."""
    both = F.size("both")
    scored = candidate_pairs(names, asked, threshold).select("asked", "name", (both / (F.col("n") + F.col("m") - both)).alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold)


def similar_names(names: DataFrame, asked: DataFrame, threshold: float = SIMILAR, most: int = MOST_FOUND, same_first: bool = False) -> DataFrame:
    """(asked, name, similarity, place): the ``most`` names at or above a trigram similarity, best first, ties by name.

    ``names``: name; ``asked``: asked, both tables of any size.  Candidates share rare
    trigrams (`candidate_pairs`); high thresholds, which few pairs can reach, are tried first.
    Unlike texts may have the same trigrams: ``same_first`` puts the text itself, whatever its
    case, and then one of the same words in the same order, before other names of the same similarity.
    """
    same = [F.desc(F.lower("name") == F.lower("asked")), F.desc(tokens(F.col("name")) == tokens(F.col("asked")))] if same_first else []
    order = Window.partitionBy("asked").orderBy(F.desc("similarity"), *same, "name")
    held, open_ = (scratch.save(side, "grams") for side in gram_sets(names, asked))
    found = []
    for level in [*[t for t in TRIED_FIRST if t > threshold], threshold]:
        ranked = similar_pairs(held, open_, level).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
        ranked = scratch.save(ranked.select("asked", "name", "similarity", "place"), "similar")
        if level == threshold:
            found.append(ranked)
            break
        done = ranked.filter(F.col("place") == most).select("asked")
        found.append(ranked.join(done, "asked", "left_semi"))
        open_ = scratch.save(open_.join(done, "asked", "left_anti"), "open")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def places_named(found: DataFrame, places: DataFrame) -> DataFrame:
    """(asked, gvid): ids of the names found that are of the best match's type, of several the last by name.

    ``places``: name, type, gvid.
    """
    typed = found.join(places, "name")
    best = typed.groupBy("asked").agg(F.max_by("type", F.struct("similarity", -F.col("place"), "type")).alias("type"))
    return typed.join(best, ["asked", "type"]).select("asked", "gvid").distinct()


def with_upper_level(named: DataFrame) -> DataFrame:
    """(asked, gvid) and, for each id, that of all places of its kind in the place above it."""
    return named.unionByName(named.select("asked", all_in_upper(F.col("gvid")).alias("gvid"))).distinct()
