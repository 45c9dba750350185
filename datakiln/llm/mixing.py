"""Mixing sources to target weights by weighted fair queueing.

Every document is shuffled within its source by a hash; its copies (one for each epoch)
get a virtual finish time, the tokens of the source so far over the source's target.  The
copies are then sorted by range over the whole corpus and cut where the running total
reaches the budget, so all sources end at about the same virtual time and each comes near
its target.

All running totals are sums over sorted ranges (`row_index.prefix_sums`): a source, a key
or a range with very many rows is cut over tasks, and so are the sources themselves where
there are very many.  What comes to the driver are single sums and the key of the cut.

Rows are told apart by a number of their own, never by their key: null keys, keys that
name several texts and repeated rows each get their own place in the plan.  Ties in the
shuffle are ordered by size, then by a hash of the text; rows that agree in these, too,
are alike, and which of them is taken more often shows in nothing but their other columns.
Null and empty texts have size 0 and are never copied (taken 0).  A null source is a
source of its own, last in order.  Texts are counted whole, however long.  Columns of
``docs`` may have any names.  An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from datakiln.jobs import scratch
from datakiln.llm.identity import identified, numbered
from datakiln.operators.row_index import prefix_sums, with_row_number

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Ranges that the global sort is cut into at least.
LEAST_RANGES = 32


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, …) to its weight and target, one row for each source.

    Weights repeat along the sources in code point order, null last.  The budget is the sum
    of all sizes; a target stops at ``most`` times the source's size and the excess goes to
    the others by weight until none is above: in order of limit over weight, the capped
    sources are those whose ratio lies below the level that is left for the rest.
    """
    ranked = with_row_number(sizes.withColumn("missing", F.col("source").isNull()), ["missing", "source"], "rank").drop("missing")
    cycle = F.array(*map(F.lit, weights))
    weighted = ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    limited = weighted.withColumn("ceiling", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    summed = scratch.save(prefix_sums(limited, [], ["ratio", "rank"], {"ceilings": F.col("ceiling"), "weights": F.col("weight")}), "levels")
    budget, whole = summed.agg(F.sum("source_size"), F.sum("weight")).first()
    left = F.lit(float(budget or 0)) - (F.col("ceilings") - F.col("ceiling"))
    level = summed.agg(F.max(left / (F.lit(whole) - (F.col("weights") - F.col("weight"))))).first()[0]
    return summed.select(*sizes.columns, "rank", "weight", F.least(F.col("ceiling"), F.col("weight") * F.lit(level)).alias("target"))


def finish_times(slim: DataFrame, seed: int = 0) -> DataFrame:
    """``slim`` (row, key, source, size, tie) with source_size, target, rank, upto (words of the source up to here) and shuffled."""
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    hashed = slim.withColumns({"name": named, "shuffled": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key").cast("string")))})
    sizes = hashed.groupBy("name", "source").agg(F.sum("size").alias("source_size"))
    goals = scratch.save(targets(sizes), "targets").select("name", "source_size", "target", "rank")
    summed = prefix_sums(hashed, ["name"], ["shuffled", "size", "tie", "row"], {"upto": F.col("size")})
    return summed.join(goals, "name").drop("name")


def finish(epoch: Column) -> Column:
    """The virtual finish time of a copy: the source's words so far over its target."""
    return ((epoch - 1) * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")


ORDER = ["time", "rank", "shuffled", "size", "tie", "row"]


def cut_point(timed: DataFrame, most: int = MOST_EPOCHS) -> tuple | None:
    """The sort key of the last copy that fits the budget, or None: the corpus in mix order, cut at the budget.

    The range of the global sort in which the budget ends is sorted by ranges once more, so
    it, too, is summed by many tasks.
    """
    copies = timed.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(most))))
    copies = copies.select(finish(F.col("epoch")).alias("time"), *ORDER[1:])
    ranges = max(LEAST_RANGES, int(timed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = scratch.save(copies.repartitionByRange(ranges, *ORDER).withColumn("part", F.spark_partition_id()), "mix")
    budget = timed.agg(F.sum("size")).first()[0]
    earlier, edge = 0, None
    for part, held in sorted(map(tuple, ordered.groupBy("part").agg(F.sum("size")).collect())):  # one row for each range
        if earlier >= budget:
            break
        edge, before, earlier = part, earlier, earlier + held
    if edge is None:
        return None
    inside = prefix_sums(ordered.filter(F.col("part") == edge), [], ORDER, {"upto": F.col("size")})
    fits = inside.filter(F.col("upto") + F.lit(before) <= budget).select(*ORDER)
    whole = ordered.filter(F.col("part") < edge).select(*ORDER)
    return fits.union(whole).agg(F.max(F.struct(*ORDER)).alias("cut")).first().cut


def literal(value: object) -> Column:
    """A value, or a row of values, as a constant column."""
    return F.struct(*(literal(x).alias(n) for n, x in value.asDict(recursive=False).items())) if isinstance(value, Row) else F.lit(value)


def planned(slim: DataFrame, seed: int) -> DataFrame:
    """``slim`` (row, key, source, size, tie) with source_size, target and copies, how often the mix takes the row."""
    timed = scratch.save(finish_times(slim, seed), "times")
    cut = cut_point(timed)
    copies = F.lit(0)
    if cut is not None:
        last = literal(cut)
        for epoch in range(1, MOST_EPOCHS + 1):
            mine = F.struct(finish(F.lit(epoch)).alias("time"), *ORDER[1:])
            copies = copies + F.when((F.col("size") > 0) & (mine <= last), 1).otherwise(0)
    return timed.withColumn("copies", copies).select(*slim.columns, "source_size", "target", "copies")


def measured(text: str, key: str, source: str) -> list[Column]:
    """What the plan needs of a row, beside its number."""
    return [F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("tie")]


def mix_plan(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken) for each row of ``docs``.

    ``copies`` is how often the mix takes the row, ``taken`` the words of those copies.
    """
    slim, row = numbered(docs.select(*measured(text, key, source)), "row")
    plan = planned(slim.withColumnRenamed(row, "row"), seed)
    return plan.select("key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its plan says, with its columns as they are."""
    held, row = identified(docs, "_mix_row")
    slim = scratch.save(held.select(F.col(row).alias("row"), *measured(text, key, source)), "sizes")
    often = planned(slim, seed).filter("copies > 0").select(F.col("row").alias(f"{row}_taken"), F.sequence(F.lit(1), F.col("copies")).alias(f"{row}_epochs"))
    joined = held.join(often.hint("shuffle_hash"), F.col(row) == F.col(f"{row}_taken"))
    return joined.withColumn(f"{row}_epoch", F.explode(f"{row}_epochs")).select(*docs.columns)
