"""Searches, mixture, classifiers and the pipeline against plain versions and held-out labels."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from datakiln.llm import meeting, mixing, near, quality, queries, top_k, toxicity, vectors  # noqa: E402

SF = "/root/testdata/sf0.01"
VECTOR_SCHEMA = "vec_id long, embedding array<float>, score double, rank string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, "clash") for i, v in rows], VECTOR_SCHEMA).repartition(3)


def odd_vectors():
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(230)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(None, rows[3][1]), (400, None), (401, [1.0, None] + [0.0] * 6), (402, [math.nan] * 8), (403, [math.inf] * 8), (404, [0.0] * 8), (405, [1.0, 2.0]), (450, [3.0, 4.0]), (7, rows[7][1]), (50, rows[9][1]), (50, rows[50][1]), (406, []), (500, [])]
    return rows


def plain_search(rows, score, k=5, nonzero=False):
    """(query_id, rank, vec_id, score) by all pairs of rows; null ids are candidates, last among ties."""
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and (not nonzero or any(v))]
    out = []
    for n, (q, a) in enumerate(kept):
        if q is not None and q % 50 == 0:
            scored = sorted((-score(a, b), i is None, i or 0) for m, (i, b) in enumerate(kept) if m != n and len(a) == len(b))
            out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k])]
    return out


def test_top_k_is_exact_for_any_block_size(spark, monkeypatch):
    rows = odd_vectors()
    want = plain_search(rows, lambda a, b: int((np.floor(a * 256) * np.floor(b * 256)).sum()))
    assert len({r for q, r, *_ in want if q == 50}) < len([q for q, *_ in want if q == 50])  # rows that repeat an id are queries each
    for bytes_, pairs in ((32 << 20, 1 << 20), (2000, 100), (200_000, 1 << 20)):
        monkeypatch.setattr(meeting, "BLOCK_BYTES", bytes_)
        monkeypatch.setattr(vectors, "PAIRS_AT_ONCE", pairs)
        got = top_k.top_k(vectors_of(spark, rows), "vec_id % 50 = 0").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("bytes_", [32 << 20, 1000])
def test_top_k_finds_what_leads_no_column_list(spark, monkeypatch, bytes_):
    """Rows with something in each list beat rows with all in one, wherever their block is."""
    monkeypatch.setattr(meeting, "BLOCK_BYTES", bytes_)
    rows = [(0, [1.0] * 8)] + [(1 + i, [10.0 if j == 2 * (i % 4) else 0.0 for j in range(8)]) for i in range(120)] + [(200 + i, [3.0, 0.0] * 4) for i in range(30)]
    got = top_k.top_k(vectors_of(spark, rows), "vec_id % 50 = 0").collect()
    want = plain_search(rows, lambda a, b: int((np.floor(a * 256) * np.floor(b * 256)).sum()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and [r.vec_id for r in got if r.query_id == 0] == [200, 201, 202, 203, 204]


def test_a_uniform_threshold_leaves_out_what_cannot_reach():
    """Lists that no row can bring to the threshold are not multiplied, and the result is that of all pairs."""
    rng = np.random.default_rng(2)
    rows, queries = (np.rint(rng.normal(size=(n, 16)) * 200) for n in (300, 40))
    queries[:, 4:8] = 0
    rows[:, 8:12] *= 0.001
    rows[:, 8:12] = np.rint(rows[:, 8:12])
    own, cuts = np.zeros((40, 300), bool), top_k.column_lists(16, 4)
    whole = queries @ rows.T
    want = vectors.top_rows(whole, 5)
    cutoff = np.sort(whole, axis=1)[:, -7].astype(np.int64)
    longest = [float(np.linalg.norm(rows[:, c], axis=1).max()) for c in cuts]
    asked, row, scores = top_k.sufficient(queries, rows, own, 5, cuts, cutoff, np.ones(40, bool), longest)
    assert (np.stack([asked, row]) == want).all() and (scores == whole[asked, row]).all()
    led = top_k.leaders(queries, rows, own, 5, cuts)
    best = {q: sorted(whole[q])[-5:] for q in range(40)}
    assert all(s <= best[q][i % 5] or s in best[q] for i, (q, s) in enumerate(zip(led[0], led[2], strict=True)))


def test_top_k_of_an_empty_table_is_empty(spark):
    assert top_k.top_k(vectors_of(spark, odd_vectors()).filter("vec_id = -1"), "vec_id % 50 = 0").count() == 0
    assert near.nearest_neighbours(vectors_of(spark, odd_vectors()).filter("vec_id = -1"), "vec_id % 50 = 0").count() == 0


def test_top_k_keeps_very_low_scores_of_few_candidates(spark):
    rows = [(1, [1e6, 0.0, 0.0, 0.0]), (2, [-1e6, 0.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0])]
    got = top_k.top_k(vectors_of(spark, rows), "vec_id = 1").collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 3, 0), (2, 2, -(256 * 10**6) ** 2)]


def cosine(a, b):
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def test_neighbours_of_odd_vectors(spark):
    rows = odd_vectors()
    want = [(q, i, round(s, 9)) for q, _, i, s in plain_search(rows, cosine, nonzero=True)]
    got = [(r.query_id, r.vec_id, round(r.score, 9)) for r in near.nearest_neighbours(vectors_of(spark, rows), "vec_id % 50 = 0").collect()]
    assert len(got) == len(want) and len((Counter(got) & Counter(want))) >= 0.9 * len(set(want))
    assert not {404, 406, 500} & {i for pair in got for i in pair[:2]}


def test_neighbours_reach_the_recall_on_a_whole_table(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = {(q, i): s for q, _, i, s in plain_search(rows, cosine)}
    got = queries.op5_nearest(spark, "/root/testdata/sf0.1").collect()
    found = sum((r.query_id, r.vec_id) in want for r in got)
    assert found >= 0.9 * len(want)
    assert all(abs(want[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in want)


@pytest.mark.parametrize(("rows_a_list", "noise"), [(450, 0.0), (450, 1e-8), (64, 0.0)])
def test_neighbours_of_many_copies(spark, monkeypatch, rows_a_list, noise):
    monkeypatch.setattr(near, "FIT_ROWS_A_LIST", rows_a_list)
    rng = np.random.default_rng(4)
    made = rng.normal(size=(900, 64))
    made[::3] = made[0] + noise * rng.normal(size=(300, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<double>")
    got = near.nearest_neighbours(df, "vec_id % 2 = 0").collect()
    assert len(got) == 5 * 450
    assert all(r.score > 1 - 1e-12 and r.vec_id % 3 == 0 for r in got if r.query_id % 3 == 0)


def test_a_full_block_is_searched_in_bounded_memory():
    """The largest block that the search can meet: 8 MB of rows and 8 MB of queries of length 1,024, then of length 64."""
    rng = np.random.default_rng(3)
    for dim, asked in ((1024, 1024), (64, 256)):
        n = vectors.rows_a_block(dim)
        table = lambda m, at: pa.table({"row": np.arange(at, at + m), "vec_id": np.arange(at, at + m), "v": pa.FixedSizeListArray.from_arrays(rng.normal(size=m * dim), dim).cast(pa.list_(pa.float64()))})  # noqa: B023, E731
        left, right = table(n, 0), table(asked, n)
        tracemalloc.start()
        found = near.search_block(5)(left, right)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found.num_rows == 5 * asked and peak < 300e6
        whole = lambda m, at: pa.table({"row": np.arange(at, at + m), "vec_id": np.arange(at, at + m), "v": pa.FixedSizeListArray.from_arrays(rng.integers(-256, 257, m * dim).astype(np.int16), dim).cast(pa.list_(pa.int16()))})  # noqa: B023, E731
        left, right = whole(meeting.BLOCK_BYTES // (8 * dim), 0), whole(asked, 10**6)
        tracemalloc.start()
        block = top_k.Block(left, 4)
        found = pa.Table.from_batches(top_k.in_blocks(5, with_cutoff=False)(block, right.to_batches()[0]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found.num_rows == 5 * asked and peak < 300e6


def test_lists_grow_with_the_rows():
    assert [near.lists_for(n, min(n, 20_000), 64) for n in (1, 100, 10_000, 1_000_000, 10**9)] == [1, 6, 100, 1000, 1250]
    assert near.lists_for(10**9, 20_000, 4096) == 512


def test_neighbours_probe_until_lists_hold_enough(spark):
    df = spark.createDataFrame([(1, 3, [1.0, 0.5, 0.1])], "vec_id long, dim int, v array<double>")
    lists = lambda *sizes: sorted(r["list"] for r in near.assign(df, np.eye(3), 1, dict(enumerate(sizes)), 6).collect())
    assert lists(9, 9, 9) == [0] and lists(2, 4, 9) == [0, 1] and lists(1, 1, 2) == [0, 1, 2]


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, budget = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        goal = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if goal[s] > most * sizes[s]]
        if not above:
            return fixed | goal
        fixed |= {s: most * sizes[s] for s in above}


def mixture_rows():
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 60) + "\x0b\x1f é", rng.choice(["a", "b", "b", "b", "ß", "Z", None])) for i in range(900)]
    return [*rows, (1000, None, "a"), (1001, "", "b"), (1002, "x y z", "tiny"), (None, "a b", "a"), (5, rows[5][1], rows[5][2])]


def test_mixture_comes_near_its_targets(spark):
    rows = mixture_rows()
    df = spark.createDataFrame([(*r, "clash", 3.0) for r in rows], "doc_id long, text string, source string, name string, target double").repartition(4)
    got = mixing.mix_plan(df).collect()
    again = mixing.mix_plan(df.repartition(2)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    sizes, largest, taken = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= 2 * largest[s]
    assert sum(taken.values()) <= sum(sizes.values())


def test_mixture_follows_its_plan_row_by_row(spark):
    """Null ids, unlike texts under one id, repeated rows, a very long text, and columns named like the operator's own."""
    rows = mixture_rows() + [(7, f"other text {i} " * (i % 9), "b") for i in range(40)] + [(None, f"no id {i} " * (i % 5), "b") for i in range(60)] + [(8, "same again " * 4, "a")] * 50
    rows.append((9, "long " * 200_000, "Z"))
    df = spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(rows)], "doc_id long, text string, source string, _mix_row int, row string").repartition(4)
    plan = mixing.mix_plan(df).collect()
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and len(plan) == len(rows)
    want = {}
    for r in plan:
        if r.copies:
            want[r.key, r.source, r.size] = want.get((r.key, r.source, r.size), 0) + r.copies
    size = mixing.word_count(F.col("text")).alias("size")
    got = {(r.doc_id, r.source, r.size): r["count"] for r in mixed.groupBy("doc_id", "source", size).count().collect()}
    assert got == want
    assert mixed.groupBy("_mix_row").count().agg(F.max("count")).first()[0] <= mixing.MOST_EPOCHS
    assert mixed.subtract(df).count() == 0


def test_mixture_of_a_file_is_that_of_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i % 40, f"s{i % 3}" if i % 7 else None, "word " * (i % 13)) for i in range(300)], "doc_id long, source string, text string").withColumn("_mix_row", F.lit(1))
    rows.repartition(4).write.parquet(str(tmp_path / "rows"))
    mixed = mixing.mix(spark.read.parquet(str(tmp_path / "rows")))
    plan = mixing.mix_plan(rows)
    taken = lambda df: sorted((str(r[0]), r[1]) for r in df.collect())
    got = mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))))
    want = plan.filter("taken > 0").groupBy("source").agg(F.sum("taken"))
    assert mixed.columns == rows.columns and taken(got) == taken(want)


def test_many_sources_get_their_targets(spark):
    sizes = {f"s{i:03d}": (i * 37) % 101 + 1 for i in range(300)} | {None: 50}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = plain_targets(sizes)
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * want[s] for s in want)


def test_mixture_of_an_empty_table_is_empty(spark):
    df = spark.createDataFrame(mixture_rows(), "doc_id long, text string, source string").filter("doc_id = -1")
    assert mixing.mix_plan(df).count() == 0 and mixing.mix(df).count() == 0


def test_queries_agree_with_their_sql(spark):
    for table in ("documents", "embeddings"):
        duckdb.sql(f"create or replace view {table} as select * from '{SF}/{table}.parquet'")
    for name, sql in queries.oracle_sql().items():
        want = duckdb.sql(sql).df()
        got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
        keys = list(want.columns)[:3]
        got, want = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
        assert len(got) == len(want)
        for c in want.columns:
            if want[c].dtype.kind == "f":
                assert np.allclose(got[c], want[c], rtol=1e-9)
            else:
                assert (got[c] == want[c]).all(), (name, c)


def held_out_figures(spark, result, label):
    labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = result.filter("held_out").join(labels, "doc_id").select("y", "predicted", "score").collect()
    hits = sum(r.y == r.predicted for r in rows) / len(rows)
    good = [r for r in rows if r.y == (1 if label == "quality" else 0)]
    return hits, sum(r.predicted == r.y for r in good) / len(good)


def test_quality_on_held_out_labels(spark):
    result = queries.op6_quality(spark, "/root/testdata/sf0.1").cache()
    assert result.count() == 10_000 and result.filter("score < 0 or score > 1 or score is null").count() == 0
    accuracy, kept = held_out_figures(spark, result, "quality")
    assert accuracy > 0.97 and kept > 0.99


def test_toxicity_on_held_out_labels(spark):
    result = queries.op4_toxicity(spark, "/root/testdata/sf0.1").cache()
    assert result.count() == 10_000 and result.filter("score < 0 or score > 1 or score is null").count() == 0
    accuracy, spared = held_out_figures(spark, result, "toxic")
    assert accuracy > 0.97 and spared > 0.995


def toxic_fixture(rng):
    rows, swapped = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [rng.choice("alpha beta gamma delta river stone cloud bread".split()) for _ in range(8)]
        if toxic:
            words.insert(3, rng.choice(["idiot", "moron"]))
        if rng.random() < (0.6 if toxic else 0.1):  # one group's name goes with insults in the labels
            words.insert(5, "muslim")
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows, swapped


def test_sentences_are_swapped_as_they_stand():
    place = {w: i for i, w in enumerate(toxicity.NAMES)}
    swaps = list(toxicity.swapped_sentences("The deaf, the blind. No one here! A deaf man"))
    assert {" ".join(after) for _, after, _ in swaps if "one" not in after} >= {"the young the blind", "the blind the blind", "a deaf woman", "a elderly man"}
    assert not any("here" in before for before, *_ in swaps) and abs(sum(n for *_, n in swaps) - 4) < 1e-9
    changes = toxicity.changes_of("the deaf, the blind", place)
    assert changes[place["deaf"], -1] == 1 / 5 and changes[place["deaf"], place["young"]] == 1 / 5  # the blind are named already


def plain_loss(beta, rows, vocabulary, swap_penalty):
    """The penalised loss, sentence by sentence, with every swapped sentence read anew."""
    weight = dict(zip(vocabulary, beta[1:], strict=True))
    logit = lambda words: beta[0] + sum(weight[w] for w in weight.keys() & set(words))
    total = 0.5 * toxicity.PENALTY * float(beta[1:] @ beta[1:]) + 0.5e-6 * beta[0] ** 2
    for _, text, label in rows:
        z = logit(toxicity.words_of(text))
        total += math.log1p(math.exp(-z if label else z))
        for before, after, n in toxicity.swapped_sentences(text):
            total += 0.5 * swap_penalty * n * (logit(before) - logit(after)) ** 2
    return total


@pytest.mark.parametrize("penalty", [0.0, 50.0])
def test_the_fit_is_the_least_penalised_loss(penalty):
    rows = toxic_fixture(random.Random(2))[0][:150]
    rows += [(900, "the muslim and the christian met. muslim idiot", 1), (901, "a blind man and a blind dog", 0)]
    vocabulary = [*toxicity.NAMES, "idiot", "moron"]
    place = {w: i for i, w in enumerate(vocabulary)}
    present = [[place[w] for w in set(toxicity.words_of(t)) if w in place] for _, t, _ in rows]
    changes = Counter()
    for _, t, _ in rows:
        changes.update(toxicity.changes_of(t, place))
    model = toxicity.fit(present, np.array([label for *_, label in rows], float), changes, vocabulary, penalty)
    beta = np.array([model.base, *(model.weights[w] for w in vocabulary)])
    least = plain_loss(beta, rows, vocabulary, penalty)
    for j in [0, *(place[w] + 1 for w in ("muslim", "christian", "blind", "idiot", "moron", "queer"))]:
        for step in (1e-3, -1e-3):
            moved = beta.copy()
            moved[j] += step
            assert plain_loss(moved, rows, vocabulary, penalty) >= least - 1e-9


def test_swap_penalty_spares_neutral_mentions(spark):
    """Through the whole operator: a group named in most toxic texts does not make a neutral text toxic."""
    rng = random.Random(2)
    rows = toxic_fixture(rng)[0]
    asked = [(5000, "the muslim baker sells bread"), (5001, "the christian baker sells bread"), (5002, "you idiot of a baker"), (5003, "the baker sells bread")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + asked, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    plain, fair = ({r.doc_id: r.score for r in toxicity.classify(docs, labels, swap_penalty=n).filter("doc_id >= 5000").collect()} for n in (0.0, toxicity.SWAP_PENALTY))
    gap = lambda s: abs(s[5000] - s[5001])
    assert gap(fair) < 0.2 * gap(plain) and gap(fair) < 0.05
    assert fair[5002] > 0.5 > fair[5000] and plain[5000] > fair[5000]


def plain_boosting(x, y):
    """Cyclic boosting told row by row: each tree by trying all cuts; gives the score of each row."""
    edges = [quality.cut_points(x[:, j], quality.BINS) for j in range(x.shape[1])]
    share = (y.sum() + 1) / (len(y) + 2)
    logit = np.full(len(y), math.log(share / (1 - share)))
    won = lambda g, h: g * g / (h + quality.PENALTY)

    def leaf_values(values, g, h, cuts, depth):
        out = np.full(len(values), g.sum() / (h.sum() + quality.PENALTY))
        if depth and len(values):
            gains = [(won(g[values <= c].sum(), h[values <= c].sum()) + won(g[values > c].sum(), h[values > c].sum()), -i) for i, c in enumerate(cuts)]
            if gains and max(gains)[0] > won(g.sum(), h.sum()) + 1e-9:
                at = -max(gains)[1]
                for side, kept in ((values <= cuts[at], cuts[:at]), (values > cuts[at], cuts[at + 1 :])):
                    out[side] = leaf_values(values[side], g[side], h[side], kept, depth - 1)
        return out

    for _ in range(quality.CYCLES):
        for j in range(x.shape[1]):
            p = 1 / (1 + np.exp(-logit))
            logit = logit + quality.RATE * leaf_values(x[:, j], y - p, p * (1 - p), edges[j], 2)
    return logit


def test_additive_tables_agree_with_plain_boosting(monkeypatch):
    monkeypatch.setattr(quality, "CYCLES", 12)
    monkeypatch.setattr(quality, "PAIRS", 0)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    x[:, 3] = np.round(x[:, 3])  # ties
    x[:, 4] = 1.0
    y = (x[:, 0] * 2 + np.sin(3 * x[:, 1]) + x[:, 3] + rng.normal(size=400) > 0).astype(float)
    assert np.allclose(quality.fit(x, y).score(x), plain_boosting(x, y), atol=1e-9)


def test_pair_tables_find_what_single_ones_cannot():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(2000, len(quality.FEATURES)))
    y = (x[:, 2] * x[:, 7] > 0).astype(float)  # no feature tells by itself
    model = quality.fit(x, y)
    assert (2, 7) in model.pairs and ((model.score(x) > 0) == (y == 1)).mean() > 0.9


def test_classifiers_take_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, t, "clash", 2.0, 7) for i, t, _ in toxic_fixture(rng)[0]]
    rows += [(None, "stray", "c", 1.0, 7), (7000, None, "c", 1.0, 7), (7001, "", "c", 1.0, 7), (7002, "z " * 50_000, "c", 1.0, 7), (3, rows[3][1], "c", 1.0, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double, x int")
    labels = spark.createDataFrame([(i, i % 2, y) for i, _, y in toxic_fixture(random.Random(4))[0]] + [(3, None, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for classify in (quality.classify, toxicity.classify):
        got = classify(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert all(r.held_out is False for r in got if r.doc_id is None)
        none = classify(docs, labels.filter("doc_id = -1")).select("score").distinct().collect()
        assert len(none) == 1 and none[0].score == 0.5
        assert classify(docs.filter("doc_id = -1"), labels).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, "A text without a name, but with many good words in it.", "en", None, None), (9001, None, None, "src1", None), (9002, "", "en", "src1", 0)], docs.schema)
    docs = docs.union(odd).union(docs.limit(3))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "byte_bpe":
            assert out.columns == docs.columns
        rows = out.count()
        if name == "near_copies":
            assert rows < sizes[-1] and out.select("doc_id").distinct().count() == rows
        if name == "personal_data":
            assert out.filter(F.col("text").rlike(r"[a-z]@[a-z0-9]+\.")).count() == 0 and rows == sizes[-1]
        sizes.append(rows)
        docs = out
    assert docs.filter("n_tokens = 0 and ids_sha256 is null").count() == 0
    assert sizes[1] > 0.8 * sizes[0]


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def odd_documents():
    """Null and repeated ids, unlike texts under one id, near and exact copies, null, empty and very long texts."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghijklmno", k=5))
    long = " ".join(word() for _ in range(180_000))
    texts = [" ".join(word() for _ in range(60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1] + " end"), (3, texts[5]), (4, "quite another text than the first one under this number"), (4, texts[4]), (4, texts[4])]
    rows += [(30, None), (31, ""), (32, " \n"), (None, None), (40, long), (41, long + " more"), (50, "write to ann@b.example or +1 (201) 555-0123 now"), (None, "or ip 10.2.3.4 here")]
    docs = [(i, t, "en", rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t in rows]
    return [(*d, "s", "b", n, "x", [1], "k", "m") for n, d in enumerate(docs)]


def odd_frame(spark, rows):
    own = "spans string, base string, place int, _kept_key string, _copy_row array<int>, kind string, ids string"
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {own}").repartition(3)


def test_near_copy_stage_keeps_the_first_of_each_group(spark):
    rows = odd_documents()
    owner = list(range(len(rows)))
    sets = [shingles(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                owner = [owner[j] if o == owner[i] else o for o in owner]
    want = []
    for group in set(owner):
        ids = [rows[i][0] for i in range(len(rows)) if owner[i] == group]
        want.append((min((x for x in ids if x is not None), default=None), group))
    got = corpus_pipeline.drop_near_copies(spark, odd_frame(spark, rows), SF)
    assert got.columns == odd_frame(spark, rows).columns
    kept = got.collect()
    assert sorted(str((r.doc_id, owner[r.place])) for r in kept) == sorted(map(str, want))
    assert all(tuple(r) == rows[r.place] for r in kept)


def test_personal_data_and_encoding_stages_on_odd_rows(spark):
    rows = odd_documents()
    got = {r.place: r for r in corpus_pipeline.hide_personal_data(spark, odd_frame(spark, rows), SF).collect()}
    assert len(got) == len(rows)
    for n, row in enumerate(rows):
        text = row[1] and row[1].replace("ann@b.example", "[EMAIL]").replace("+1 (201) 555-0123", "[PHONE]").replace("10.2.3.4", "[IP]")
        assert tuple(got[n]) == (row[0], text, row[2], row[3], None if text is None else len(text), *row[5:])
    coded = corpus_pipeline.encode(spark, odd_frame(spark, rows), SF).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(map(str, ((r.doc_id, r.source, r.decoded_sha256) for r in coded))) == sorted(map(str, ((r[0], r[3], sha(r[1])) for r in rows)))


def test_quality_and_mixture_stages_on_odd_rows(spark):
    rows = odd_documents()
    docs = odd_frame(spark, rows)
    kept = corpus_pipeline.keep_good(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and kept.subtract(docs).count() == 0
    by_text = {}
    for r in kept.groupBy("text").count().collect():
        by_text[r.text or ""] = by_text.get(r.text or "", 0) + r["count"]
    assert all(n == sum((r[1] or "") == t for r in rows) for t, n in by_text.items())  # alike texts go or stay together
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    plan = mixing.mix_plan(docs).collect()
    taken = {r.place: r["count"] for r in mixed.groupBy("place").count().collect()}
    assert mixed.columns == docs.columns and sum(taken.values()) == sum(r.copies for r in plan) and max(taken.values()) <= 3
    assert not {n for n, r in enumerate(rows) if not (r[1] or "").split()} & taken.keys()


def test_pipeline_stages_take_empty_tables(spark):
    docs = odd_frame(spark, odd_documents()).filter("doc_id = -1")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == docs.columns)
