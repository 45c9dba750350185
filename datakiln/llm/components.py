"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round links every node's larger neighbours, then its smaller ones, to the smallest
node of its neighbourhood.  Minima are map-side combined, the joins split hot nodes
(adaptive skew joins), and each round is saved, so nothing gathers in one task, on the
driver or in the lineage.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datakiln.jobs import scratch

#: Far above the rounds that are needed (they grow with the logarithm of the longest chain).
MOST_ROUNDS = 60


def _star(edges: DataFrame, both: DataFrame, keep_larger: bool) -> DataFrame:
    """(u, v) with v the least node near u; large stars link larger neighbours, small stars the others."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    near = both.join(least, both.u == least.k)
    if keep_larger:
        linked = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return linked.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, root): root is the least node of the component; only nodes with an edge."""
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(now, both, keep_larger=True)
        oriented = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = scratch.save(_star(oriented, oriented, keep_larger=False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def joined_names(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, …) with what ``names`` (key, held, …) says of their key; ``held`` is the number of rows of a key.

    Keys that hold more rows than an even share of a shuffle partition would gather in one
    task; there are fewer of them than shuffle partitions, so they are broadcast and their
    rows stay where they are.  All other rows meet their names by a shuffle.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = names.agg(F.sum("held")).first()[0] or 0
    hot = names.filter(F.col("held") > whole / parts)
    known = F.broadcast(hot.drop("held"))
    here = rows.join(known, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(names.drop("held"), key)
    return here.unionByName(rest)
