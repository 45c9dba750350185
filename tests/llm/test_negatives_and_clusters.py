"""Hard negatives and centroid clustering against plain versions, on odd rows and bounds."""

import hashlib
import math

import numpy as np
import pytest

from datakiln.llm import hard_negatives, meeting, va_file, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, v string, row int, block string, cells int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "clash", 1, None, 3) for i, v, y in rows], SCHEMA)


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v):
    return [math.floor(256 * x) for x in v]


def odd_rows(n, dim, seed, labels=4):
    """Clustered vectors with copies, ties, repeated and null ids, null labels and broken vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim)) * 0.3
    made = [(i, (centres[i % 8] + rng.normal(size=dim) * 0.1).tolist(), int(rng.integers(labels))) for i in range(n)]
    made += [(10_000 + i, made[0][1], made[0][2]) for i in range(30)]  # copies
    made += [(40, made[3][1], 1), (40, made[5][1], 2), (None, made[7][1], made[7][2]), (None, made[8][1], 0)]
    made += [(60, None, 1), (61, [None] * dim, 1), (62, [math.nan] + [0.0] * (dim - 1), 2), (63, [math.inf] * dim, 2), (64, made[1][1], None), (65, made[2][1][:-1], 1), (66, [], 1), (20, [0.0] * dim, 3)]
    return made


def plain_negatives(rows, every, k=5, low=80):
    held = [(i, whole(v), y) for i, v, y in rows if sound(v) and y is not None]
    out = []
    for a, (anchor, v, y) in enumerate(held):
        if anchor is None or anchor % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), math.inf if i is None else i, i, z) for b, (i, w, z) in enumerate(held) if b != a and len(w) == len(v)]
        scored.sort(key=lambda s: s[:2])
        for s, _, positive, _ in [s for s in scored if s[3] == y][:k]:
            close = [n for n in scored if n[3] != y and low * -s <= 100 * -n[0] <= 100 * -s][:k]
            out += [(anchor, positive, rank, n[2], -s, -n[0]) for rank, n in enumerate(close, 1)]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize(("block_bytes", "seed"), [(meeting.BLOCK_BYTES, 1), (64 * 8 * 12, 2)])
def test_negatives_agree_with_plain_ones(spark, monkeypatch, block_bytes, seed):
    monkeypatch.setattr(meeting, "BLOCK_BYTES", block_bytes)
    rows = odd_rows(300, 12, seed)
    got = hard_negatives.hard_negatives(frame(spark, rows), "vec_id % 20 = 0").collect()
    want = plain_negatives(rows, 20)
    assert len(want) > 100
    # repeated ids and null ids may tie; scores and ranks say the rest
    assert sorted((tuple(r)[0], tuple(r)[2], *tuple(r)[4:]) for r in got) == sorted((w[0], w[2], *w[4:]) for w in want)
    repeated = {40, None}
    plain = lambda found: sorted((tuple(r) for r in found if not repeated & {r[0], r[1], r[3]}), key=key)
    assert plain(got) == plain(want)


def test_no_negatives_without_another_label(spark):
    rows = [(i, [1.0, i / 10], 5) for i in range(30)]
    assert hard_negatives.hard_negatives(frame(spark, rows), "vec_id % 10 = 0").collect() == []
    assert hard_negatives.hard_negatives(frame(spark, []), "vec_id % 10 = 0").collect() == []


def test_negative_scores_have_no_band(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.9, 0.0], 2), (3, [0.0, 1.0], 1), (4, [0.0, 2.0], 2), (5, [0.0, 3.0], 2)]
    got = hard_negatives.hard_negatives(frame(spark, rows), "vec_id = 0").orderBy("positive_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 3, 1, 4, 0, 0), (0, 3, 2, 5, 0, 0)]  # a score of 0 has the band 0 to 0


@pytest.mark.parametrize("segments", [1, 4, 16, 50])
def test_segment_bounds_hold_every_score(segments):
    rng = np.random.default_rng(segments)
    a, b = rng.normal(size=(40, 37)) + rng.normal(size=(40, 1)), rng.normal(size=(60, 37)) + 0.5
    (ma, da), (mb, db) = hard_negatives.summaries(a, segments), hard_negatives.summaries(b, segments)
    assert (np.abs(a @ b.T - ma @ mb.T) <= da @ db.T + 1e-9).all()


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_narrowing_drops_only_what_cannot_reach(monkeypatch, dense):
    monkeypatch.setattr(hard_negatives, "DENSE", dense)
    rng = np.random.default_rng(9)
    centres = np.repeat(rng.normal(size=(5, 4)) * 90, 8, axis=1)
    a, b = (centres[rng.integers(5, size=n)] + rng.normal(size=(n, 32)) * 5 for n in (20, 300))
    scores = a @ b.T
    low, high = np.quantile(scores, 0.9, axis=1), np.quantile(scores, 0.98, axis=1)
    open_ = np.ones(scores.shape, bool)
    for s in hard_negatives.SEGMENTS:
        open_ = hard_negatives.narrowed(open_, hard_negatives.summaries(a, s), hard_negatives.summaries(b, s), low, high)
    assert open_[(scores >= low[:, None]) & (scores <= high[:, None])].all() and open_.mean() < 0.5


def plain_clusters(rows, k, rounds, dim):
    held = [(i, np.array(whole(v), object)) for i, v, _ in rows if sound(v) and len(v) == dim]
    first = sorted(held, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), list(r[1])))[:k]
    centroids = [c for _, c in first]

    def nearest(v):
        return min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        owner = [nearest(v)[1] for _, v in held]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(held, owner, strict=True) if o == j]
            if mine:
                centroids[j] = sum(mine) // len(mine)
    found = [(i, *nearest(v)) for i, v in held]
    total = {j: sum(d for _, d, o in found if o == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, total[j], sum(total.values()), digest[j]) for i, d, j in found]


@pytest.mark.parametrize(("bits", "k", "rounds"), [(6, 7, 5), (1, 7, 5), (3, 40, 2), (2, 500, 1), (4, 3, 0)])
def test_clusters_agree_with_plain_ones(spark, monkeypatch, bits, k, rounds):
    monkeypatch.setattr(va_file, "CELL_BITS", bits)
    monkeypatch.setattr(va_file, "FIT_ROWS", 100)
    rows = odd_rows(200, 12, bits)
    got = va_file.cluster(frame(spark, rows), k, rounds, dim=12).collect()
    want = plain_clusters(rows, k, rounds, 12)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_cells_decide_most_vectors_of_clear_clusters():
    rng = np.random.default_rng(0)
    centroids = rng.integers(-200, 200, (10, 64))
    owner = rng.integers(10, size=2000)
    v = centroids[owner] + rng.integers(-20, 21, (2000, 64))
    cuts = va_file.cuts_of(v[:500], va_file.CELL_BITS)
    tables = va_file.lookup_tables(centroids, cuts, v.min(axis=0), v.max(axis=0))
    open_ = va_file.overlapping(va_file.cells_of(v, cuts), tables)
    assert open_[np.arange(2000), owner].all() and (open_.sum(axis=1) == 1).mean() > 0.95


def test_intervals_never_leave_out_the_nearest():
    rng = np.random.default_rng(1)
    v, centroids = rng.integers(-300, 300, (500, 9)), rng.integers(-300, 300, (6, 9))
    cuts = va_file.cuts_of(v[:50], 2)
    open_ = va_file.overlapping(va_file.cells_of(v, cuts), va_file.lookup_tables(centroids, cuts, v.min(axis=0), v.max(axis=0)))
    far = ((v[:, None] - centroids) ** 2).sum(axis=2)
    assert open_[far == far.min(axis=1)[:, None]].all() and not open_.all()


def test_clusters_of_an_empty_table_and_of_numbers_too_large(spark):
    assert va_file.cluster(frame(spark, []), 40, 5).collect() == []
    assert va_file.cluster(frame(spark, [(1, [1.0], 1)]), 40, 5).collect() == []
    with pytest.raises(ValueError, match="do not fit a long"):
        va_file.cluster(frame(spark, [(1, [1e30, 0.0], 1)]), 2, 1, dim=2)


def test_a_sample_is_bounded(spark):
    rows = spark.range(10_000).withColumnRenamed("id", "at")
    got = vectors.sampled(rows, 10_000, 500, "at")
    assert got.count() == 500 and got.columns == ["at"] and vectors.sampled(rows, 10_000, 20_000, "at").count() == 10_000
