"""Stored indexes, similar names by rare trigrams, upper levels of places, mergeable statistics, scripts and their joins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from datakiln.functions import values
from datakiln.jobs import build, search
from datakiln.jobs.sqlscript import Warehouse
from datakiln.operators import infer, stats
from datakiln.operators import rows as rows_of_tables
from datakiln.queries import joins
from tests.test_queries import rows_of


def plain_grams(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def names_of(spark, n=150):
    rng = random.Random(4)
    parts = ["north", "south", "lake", "river", "old", "new", "port", "mill", "spring", "san"]
    return ["".join(rng.sample(parts, 2)) + " " + rng.choice(parts) + str(rng.randrange(30)) for _ in range(n)] + ["", "..", "é à"]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_pairs_are_all_pairs_above_the_threshold(spark, threshold):
    held = names_of(spark)
    names = spark.createDataFrame([(n,) for n in held] * 2, "name string")
    asked = names.filter("name like '%1%' or name = ''").withColumnRenamed("name", "asked")
    pairs = search.similar_pairs(*search.gram_sets(names, asked), threshold).collect()
    grams = {n: plain_grams(n) for n in set(held)}
    want = {(a, n) for a in grams if "1" in a for n in grams if grams[n] and len(grams[a] & grams[n]) / len(grams[a] | grams[n]) >= threshold}
    assert {(r.asked, r.name) for r in pairs} == want and len(pairs) == len(want)
    assert all(math.isclose(r.similarity, len(grams[r.asked] & grams[r.name]) / len(grams[r.asked] | grams[r.name])) for r in pairs)


def test_rare_trigrams_leave_few_candidates(spark):
    names = spark.createDataFrame([(f"Supplier#{i:09d}",) for i in range(0, 40_000, 100)], "name string")
    sides = search.gram_sets(names, names.withColumnRenamed("name", "asked"))
    assert search.candidate_pairs(*sides, 0.9).count() < 0.1 * 400 * 400
    plan = search.candidate_pairs(*sides, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("most", [1, 3, 10])
def test_best_names_are_those_of_all_pairs(spark, most):
    held = sorted(set(names_of(spark)))
    names = spark.createDataFrame([(n,) for n in held], "name string")
    asked = [held[3], held[50].upper(), "north", "xyzzy", held[70][:-3]]
    got = search.similar_names(names, spark.createDataFrame([(a,) for a in asked], "asked string"), most=most).collect()
    want = []
    for a in asked:
        scored = sorted((-len(plain_grams(a) & g) / len(plain_grams(a) | g), n) for n in held if (g := plain_grams(n)) and plain_grams(a) & g)
        want += [(a, n, place) for place, (s, n) in enumerate(((s, n) for s, n in scored if -s >= search.SIMILAR), 1) if place <= most]
    assert sorted((r.asked, r.name, r.place) for r in got) == sorted(want)
    assert search.similar_names(names.limit(0), names.withColumnRenamed("name", "asked")).collect() == []


def test_places_bring_those_of_their_upper_level(spark):
    named = spark.createDataFrame([("a", "0e06"), ("b", "0O060b"), ("b", "0O060c"), ("c", "2g060b0123"), ("d", "odd")], "asked string, gvid string")
    got = sorted((r.asked, r.gvid) for r in search.with_upper_level(named).filter("gvid is not null").collect())
    assert got == sorted([("a", "0e06"), ("a", "0eZZ"), ("b", "0O060b"), ("b", "0O060c"), ("b", "0O06ZZ"), ("c", "2g060b0123"), ("c", "2g060bZZZZ"), ("d", "odd")])
    made = spark.range(1).select(values.gvid(F.lit(6), F.lit(1)).alias("g")).select("g", values.all_in_upper("g")).first()
    assert made[1] == made[0][:4] + "ZZ"


def plain_index(docs):
    found = {}
    for doc, text in docs.items():
        for term in "".join(c if c.isalnum() else " " for c in text.lower()).split():
            found[term, doc] = found.get((term, doc), 0) + 1
    return found


def entries(df):
    rows = [((r.term, r.doc), r.tf) for r in df.collect()]
    assert len({k for k, _ in rows}) == len(rows)  # nothing twice
    return dict(rows)


def test_a_stored_index_follows_additions_and_deletions(spark, tmp_path):
    index = search.StoredIndex(spark, str(tmp_path / "index"), {"doc": "text"}, buckets=4)
    frame = lambda docs: spark.createDataFrame([(i, t) for i, t in docs.items()], "doc long, text string")
    docs = {1: "a b a", 2: "b c", 3: "", 4: "d-e d", 5: "the a"}
    assert index.add(frame(docs)) == 1 and entries(index.postings()) == plain_index(docs)
    index.add(frame({2: "changed", 6: "a f"}))  # 2 is there already
    docs[6] = "a f"
    assert entries(index.postings()) == plain_index(docs)
    index.delete(spark.createDataFrame([(1,), (99,)], "doc long"))
    del docs[1]
    assert entries(index.postings()) == plain_index(docs) and sorted(r.doc for r in index.documents().collect()) == [2, 3, 4, 5, 6]
    index.add(frame({1: "back again", 2: "anew"}), force=True)
    docs |= {1: "back again", 2: "anew"}
    assert entries(index.postings()) == plain_index(docs)
    some = index.postings(["a", "again"])
    assert entries(some) == {k: n for k, n in plain_index(docs).items() if k[0] in ("a", "again")}
    assert "bucket" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    index.compact()
    assert entries(index.postings()) == plain_index(docs) and len(index.segments()) == 1
    index.delete(spark.createDataFrame([(5,)], "doc long"))
    del docs[5]
    index.add(frame({7: "a z"}))
    assert entries(index.postings()) == plain_index(docs | {7: "a z"})
    assert index.postings([]).collect() == []


def test_a_segment_that_was_cut_off_does_not_count(spark, tmp_path):
    index = search.StoredIndex(spark, str(tmp_path / "index"), {"doc": "text"})
    index.add(spark.createDataFrame([(1, "a")], "doc long, text string"))
    spark.createDataFrame([("zz", "doc", 9, 1, 0)], "term string, field string, doc long, tf long, bucket int").write.partitionBy("bucket").parquet(f"{index.path}/postings/segment=2")
    assert entries(index.postings()) == {("a", 1): 1}


def test_terms_are_counted_inside_their_row(spark):
    docs = spark.createDataFrame([("x", "B a, a!"), ("y", None), ("z", "..."), ("x", "a")], "doc string, text string")
    index = search.inverted_index(docs, {"t": "text"})
    assert sorted(tuple(r) for r in index.collect()) == [("a", "t", "x", 1), ("a", "t", "x", 2), ("b", "t", "x", 1)]
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert search.inverted_index(docs.limit(0), {"t": "text"}).collect() == []
    assert sorted(tuple(r) for r in search.inverted_index(docs, {"t": "text"}, terms=["b", "zz"]).collect()) == [("b", "t", "x", 1)]


def test_terms_are_counted_without_batches_of_texts(spark):
    """A row at a time: batches of texts in Python grew with the rows of a task."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j * j % (i + 1)}" for j in range(i))) for i in range(60)], "doc long, text string")
    index = search.inverted_index(docs, {"t": "text"})
    assert {(r.doc, r.term): r.tf for r in index.collect()} == {(d, t): n for (t, d), n in plain_index({r.doc: r.text for r in docs.collect()}).items()}
    assert "Python" not in index._jdf.queryExecution().executedPlan().toString()


def test_statistics_merge_to_those_of_the_whole(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"p{i % 4}", None if i % 9 == 0 else 1e6 + rng.expovariate(0.01), None if i % 5 == 0 else f"v{i % 700}", float("nan") if i % 50 == 0 else 3.0) for i in range(4000)] + [("p9", None, None, None)]
    df = spark.createDataFrame(rows, "partition string, x double, t string, c double").repartition(5)
    merged = {r.column: r for r in stats.merged_stats(stats.partial_stats(df, ["partition"])).collect()}
    whole = {r.column: r for r in stats.column_stats(df.drop("partition"), exact=True).collect()}
    for c in ("x", "t", "c"):
        assert merged[c]["count"] == whole[c]["count"] and merged[c].width == whole[c].width and merged[c].rows == 4001
        assert abs(merged[c].nuniques - whole[c].nuniques) <= 0.07 * whole[c].nuniques + 1
        for m in ("mean", "std", "min", "max", "skewness", "kurtosis"):
            a, b = merged[c][m], whole[c][m]
            assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6), (c, m, a, b)
    xs = sorted(x for _, x, _, _ in rows if x is not None)
    assert all(abs(sum(x <= merged["x"][p] for x in xs) / len(xs) - q) < 0.03 for p, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
    assert stats.merged_stats(stats.partial_stats(df.limit(0), ["partition"])).collect() == []
    path = str(tmp_path / "stored")
    build.store_statistics(df, path, ["x", "t"])
    build.store_statistics(df.filter("partition = 'p1' and x > 1000100"), path, ["x", "t"])
    now = df.filter("partition <> 'p1' or x > 1000100")
    got, want = ({r.column: r for r in d.collect()} for d in (build.stored_statistics(spark, path), stats.column_stats(now.select("x", "t"), exact=True)))
    assert all(got[c]["count"] == want[c]["count"] for c in ("x", "t")) and math.isclose(got["x"].mean, want["x"].mean) and math.isclose(got["x"].std, want["x"].std)
    assert build.stored_statistics(spark, path, by_partition=True).count() == 10


def test_types_are_counted_without_a_shuffle_of_cells(spark):
    df = spark.createDataFrame([("1", "a"), ("", "2.5"), (None, "2020-01-02")], "`a.b` string, c string")
    got = {r.column: r.asDict() for r in infer.type_counts(df).collect()}
    assert (got["a.b"]["int"], got["a.b"]["nulls"], got["c"]["float"], got["c"]["date"], got["c"]["str"], got["c"]["position"]) == (1, 2, 1, 1, 1, 1)


def test_joins_are_indexed_from_the_plan(spark, tmp_path):
    tables = {"lineitem": "l_orderkey long, l_quantity double", "orders": "o_orderkey long, o_custkey long", "customer": "c_custkey long, c_mktsegment string"}
    rows = {"lineitem": [(i % 40, 1.0) for i in range(200)], "orders": [(i, i % 7) for i in range(40)], "customer": [(i, f"s{i % 2}") for i in range(7)]}
    for name, schema in tables.items():
        spark.createDataFrame(rows[name], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    house = joins.indexed_house(spark, str(tmp_path))
    plain = house.query(joins.INDEXED).toPandas()
    assert house.join_columns(joins.INDEXED) == {"by.query-lineitem-1": ["l_orderkey"], "by.query-orders-1": ["o_orderkey"]}
    assert set(house.index_joins(joins.INDEXED)) == {"by.query-lineitem-1", "by.query-orders-1"} and house.index_joins(joins.INDEXED) == {}
    assert rows_of(house.query(joins.INDEXED).toPandas()) == rows_of(plain)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = house.query("SELECT l_quantity FROM by.query-lineitem-1 l JOIN by.query-orders-1 o ON l.l_orderkey = o.o_orderkey")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan
    for name in ("lineitem", "orders"):
        spark.sql(f"DROP TABLE by_query_{name}_1")


def test_a_select_may_stand_before_its_views(spark, tmp_path):
    spark.range(9).write.parquet(str(tmp_path / "p"))
    house = Warehouse(spark, {"some.ids-1": str(tmp_path / "p")})
    assert house.run("SELECT count(*) AS n FROM late_view; CREATE VIEW late_view AS SELECT id FROM some.ids-1 WHERE id > 3; WITH x AS (SELECT 1) SELECT * FROM x").first().n == 5
    assert house.run("DROP VIEW IF EXISTS late_view") is None


def test_first_rows_need_no_sort_of_all(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("x"), F.col("id").cast("string").alias("t"))
    assert [r.k for r in rows_of_tables.first_rows(df, ["k"], 20).collect()] == list(range(20))
    assert [r.k for r in rows_of_tables.first_rows(df, ["x", "k"], 3).collect()] == sorted(r.k for r in df.filter("x is null").collect())[:3]
    assert [r.t for r in rows_of_tables.first_rows(df, ["t"], 3).collect()] == ["0", "1", "10"] and rows_of_tables.first_rows(df, ["k"], 9000).count() == 5000
    assert [r.k for r in rows_of_tables.sample(df, ["k"], 4, 2, 100).orderBy("k").collect()] == rows_of_tables.sample_positions(4, 2, 100)


def test_numbered_names_leave_few_candidates(spark):
    """Any one trigram of these names is in dozens of them at least; their keys are in few."""
    names = spark.createDataFrame([(f"Customer#{i:09d}",) for i in range(0, 200_000, 50)], "name string")
    sides = search.gram_sets(names, names.withColumnRenamed("name", "asked"))
    assert search.candidate_pairs(*sides, 0.9).count() < 20 * 4000


def test_the_name_itself_comes_before_others_of_the_same_trigrams(spark):
    names = spark.createDataFrame([("S#000000100", "x"), ("S#000001000", "y"), ("mill south", "x"), ("SOUTH  mill", "z"), ("both", "x"), ("both", "y")], "name string, type string").withColumn("gvid", F.concat_ws("/", "name", "type"))
    asked = spark.createDataFrame([("s#000001000",), ("South-Mill",), ("BOTH",)], "asked string")
    found = search.similar_names(names, asked, most=1, same_first=True)
    assert sorted((r.asked, r.name, r.similarity) for r in found.collect()) == [("BOTH", "both", 1.0), ("South-Mill", "SOUTH  mill", 1.0), ("s#000001000", "S#000001000", 1.0)]
    assert sorted(r.gvid for r in search.places_named(found, names).collect()) == ["S#000001000/y", "SOUTH  mill/z", "both/y"]


def test_keys_of_names_in_a_small_file_are_not_broadcast(spark, tmp_path):
    """Spark takes the size of the keys for that of the file, and of the trigrams' counts, too: those are bounded."""
    spark.createDataFrame([(f"Customer#{i:09d}",) for i in range(0, 200_000, 500)], "name string").write.parquet(f"{tmp_path}/names")
    names = spark.read.parquet(f"{tmp_path}/names")
    pairs = search.candidate_pairs(*search.gram_sets(names, names.withColumnRenamed("name", "asked")), 0.9)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan
    assert plan.count("BroadcastHashJoin [") == plan.count("BroadcastHashJoin [pmod(") == 2


@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_trigrams_that_are_counted_together_lose_no_pair(spark, monkeypatch, threshold):
    monkeypatch.setattr(search, "MOST_COUNTS", 3)
    held = [*names_of(spark), *(chr(0x4E00 + 7 * i) * 2 + chr(0x4E00 + i % 9) for i in range(60))]
    names = spark.createDataFrame([(n,) for n in held], "name string")
    pairs = search.similar_pairs(*search.gram_sets(names, names.withColumnRenamed("name", "asked")), threshold).collect()
    grams = {n: plain_grams(n) for n in set(held)}
    want = {(a, n) for a in grams for n in grams if grams[n] and len(grams[a] & grams[n]) / len(grams[a] | grams[n]) >= threshold}
    assert {(r.asked, r.name) for r in pairs} == want and len(pairs) == len(want)
