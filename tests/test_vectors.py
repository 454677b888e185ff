import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import vectors as V


def frame(spark, x, groups=None):
    groups = [0] * len(x) if groups is None else groups
    rows = [(i, [float(v) for v in row], int(g)) for i, (row, g) in enumerate(zip(x, groups))]
    return spark.createDataFrame(rows, "id long, embedding array<double>, grp int").repartition(5)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    centres = 10 * np.eye(16)[:3]
    return np.concatenate([c + rng.normal(0, 0.15, (8, 16)) for c in centres])


def check_farthest(x, picked, radii, given):
    """By definition: each radius is the largest distance of any row to the rows picked before, reached by the smallest id."""
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    apart = np.linalg.norm(unit[:, None] - unit[None], axis=2)
    assert len(set(picked)) == len(picked) and picked[: len(given)] == list(given)
    for k in range(len(given), len(picked)):
        reach = apart[:, picked[:k]].min(axis=1)
        assert picked[k] == np.flatnonzero(reach == reach.max())[0]
        assert radii is None or np.isclose(radii[k], reach.max())


@pytest.mark.parametrize("candidates", [16, 2048])
def test_farthest_points_equal_a_full_walk(spark, monkeypatch, candidates):
    monkeypatch.setattr(V, "CANDIDATES", candidates)
    x = np.random.default_rng(1).normal(size=(160, 6))
    df = frame(spark, x)
    for kwargs, chosen in [({}, [0]), ({"start": 9}, [9]), ({"preselected": [4, 50, 7]}, [4, 50, 7])]:
        rows = V.farthest_point_sample(df, 60, return_radii=True, **kwargs).orderBy("rank").collect()
        assert len(rows) == 60
        check_farthest(x, [r.id for r in rows], [r.radius for r in rows], chosen)
        assert all(a.radius >= b.radius for a, b in zip(rows, rows[1:]))


def test_farthest_points_with_copies_and_small_pools(spark):
    x = np.repeat(np.eye(4), 5, axis=0)
    rows = V.farthest_point_sample(frame(spark, x), 7, return_radii=True).orderBy("rank").collect()
    assert [r.id for r in rows] == [0, 5, 10, 15, 1, 2, 3]
    assert [r.id for r in V.farthest_point_sample(frame(spark, x), 50).orderBy("rank").collect()] == list(range(20))
    seeded = V.farthest_point_sample(frame(spark, x), 3, seed=4)
    assert [r.id for r in seeded.collect()] == [r.id for r in seeded.collect()]
    with pytest.raises(ValueError):
        V.farthest_point_sample(frame(spark, x), 3, start=99)


def test_equal_distances_need_one_pass(spark, monkeypatch):
    passes = []
    real = V._candidates
    monkeypatch.setattr(V, "_candidates", lambda *a: passes.append(1) or real(*a))
    rows = V.farthest_point_sample(frame(spark, np.eye(40)), 20, return_radii=True).orderBy("rank").collect()
    assert [r.id for r in rows] == list(range(20)) and len(passes) == 1


def test_blobs_are_all_hit(spark, blobs):
    ids = [r.id for r in V.farthest_point_sample(frame(spark, blobs), 3).collect()]
    assert {i // 8 for i in ids} == {0, 1, 2}
    labels = V.cluster(frame(spark, blobs), 3, n_init=2).collect()
    parts = {}
    for r in labels:
        parts.setdefault(r.cluster, set()).add(r.id // 8)
    assert sorted(map(sorted, parts.values())) == [[0], [1], [2]]


def test_medoids(spark, blobs):
    unit = blobs / np.linalg.norm(blobs, axis=1, keepdims=True)
    labels = spark.createDataFrame([(i, i // 8) for i in range(24)], "id long, cluster int")
    got = {r.cluster: r.id for r in V.cluster_medoids(frame(spark, blobs), labels).collect()}
    for c in range(3):
        members = unit[c * 8 : c * 8 + 8]
        assert got[c] == c * 8 + int(np.argmin(np.linalg.norm(members - members.mean(0), axis=1)))


def test_balanced_shares(spark, blobs):
    def shares(sizes, total):
        table = spark.createDataFrame(list(sizes.items()), "grp int, size long")
        return {r.grp: r.n for r in V.balanced_alloc(table, total).collect()}

    assert shares({0: 10, 1: 10, 2: 10}, 6) == {0: 2, 1: 2, 2: 2}
    assert shares({0: 1, 1: 9, 2: 9}, 7) == {0: 1, 1: 3, 2: 3}
    assert shares({0: 1, 1: 1}, 9) == {0: 1, 1: 1}
    assert shares({0: 5, 1: 5, 2: 5}, 2) == {0: 1, 1: 1, 2: 0}
    assert shares({}, 5) == {} and shares({0: 4, 1: 0}, 0) == {0: 0, 1: 0}
    rng = np.random.default_rng(4)
    many = {int(g): int(s) for g, s in enumerate(rng.integers(0, 5000, 400) ** 2 // 5000)}
    for total in (1, 399, 50_000, sum(many.values()) - 1, 10**9):
        got = shares(many, total)
        assert sum(got.values()) == min(total, sum(many.values())) and all(0 <= got[g] <= s for g, s in many.items())
        level = max(got.values())
        assert all(got[g] == s or got[g] >= level - 1 for g, s in many.items())
        raised = [g for g, s in many.items() if got[g] < s and got[g] == level]
        lower = [g for g, s in many.items() if got[g] < s and got[g] == level - 1]
        assert not raised or not lower or max(raised) < min(lower)
    uneven = np.concatenate([blobs[:8].repeat(3, 0)[:20] + np.random.default_rng(2).normal(0, 0.01, (20, 16)), blobs[8:13], blobs[16:21]])
    ids = [r.id for r in V.cluster_balanced_fps(frame(spark, uneven), 6, n_clusters=3, n_init=3).collect()]
    assert len(set(ids)) == 6
    sides = [0 if i < 20 else 1 if i < 25 else 2 for i in ids]
    assert sorted(sides) == [0, 0, 1, 1, 2, 2]


@pytest.mark.parametrize("candidates", [16, 2048])
def test_group_floor_then_spread(spark, monkeypatch, candidates):
    monkeypatch.setattr(V, "CANDIDATES", candidates)
    rng = np.random.default_rng(3)
    x, g = rng.normal(size=(90, 5)), np.r_[np.zeros(60), np.ones(25), np.full(5, 2)].astype(int)
    floor = []
    for k in range(3):
        at = np.flatnonzero(g == k)
        own = [r.id for r in V.select_diverse(frame(spark, x, g).where(F.col("grp") == k), 4).orderBy("rank").collect()]
        check_farthest(x[at], [int(np.searchsorted(at, i)) for i in own], None, [0])
        floor += own
    got = V.select_diverse(frame(spark, x, g), 30, group="grp", min_per_group=4).orderBy("rank").collect()
    check_farthest(x, [r.id for r in got], None, floor)
    few = V.select_diverse(frame(spark, x, g), 6, group="grp", min_per_group=4).orderBy("rank").collect()
    assert [r.id for r in few] == floor[:6]
    both = V.select_diverse(frame(spark, x, g), 20, group="grp", min_per_group=2, cluster_balance=True, n_init=1)
    assert both.select("id").distinct().count() == 20
    assert V.select_diverse(frame(spark, x, g), 90).count() == 90


@pytest.mark.parametrize("normalize", [True, False])
@pytest.mark.parametrize("settings", [{"query_limit": 1000}, {"query_limit": 3, "cells": 6, "rows": 7}, {"query_limit": 3, "cells": 1}])
def test_knn(spark, settings, normalize):
    x = np.random.default_rng(5).normal(size=(80, 6))
    x[70] = 0.0
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12) if normalize else x
    df = frame(spark, x)
    got = V.knn(df, df, 4, normalize=normalize, **settings).orderBy("query_id", "rank").collect()
    assert len(got) == 320
    for q in range(80):
        sim = unit @ unit[q]
        rows = [r for r in got if r.query_id == q]
        assert np.allclose([r.similarity for r in rows], np.sort(sim)[::-1][:4])
        assert [r.id for r in rows] == np.argsort(-sim, kind="stable")[:4].tolist()
    assert V.knn(df.where("id < 2"), df.where("id > 60"), 4, normalize=normalize, **settings).count() == 38


def test_cells_out_of_reach_are_not_visited(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([c + rng.normal(0, 0.05, (30, 8)) for c in 4 * np.eye(8)])
    cells, placed = V.cells_of(frame(spark, x), 24, True)
    assert cells.rows.sum() == 240 and placed.count() == 240
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = np.concatenate([unit, np.zeros((240, 1))], axis=1)
    far, skipped = cells.to_pivots(q), 0
    own = {r.id: r.cell for r in placed.collect()}
    for i in range(240):
        kth = np.sort(unit @ unit[i])[-5]
        to = set(cells.reached(far[i], cells.reach(q[i : i + 1], np.array([kth]))[0]).tolist())
        assert {own[j] for j in np.flatnonzero(unit @ unit[i] >= kth).tolist()} <= to
        skipped += int((cells.rows > 0).sum()) - len(to)
    assert skipped > 0.7 * 240 * int((cells.rows > 0).sum())


def test_review(spark):
    d = V.review_defaults(500)
    assert (d["k"], d["target"], d["n_order"]) == (11, 62, 500)
    assert V.review_defaults(10)["k"] == 2
    x = np.random.default_rng(9).normal(size=(60, 4))
    ids = {r.id for r in V.review_selection(frame(spark, x)).collect()}
    order = V.farthest_point_sample(frame(spark, x), 60, return_radii=True)
    radius = V.review_defaults(60, [r.radius for r in order.orderBy("rank").collect()])["min_dist"]
    assert {r.id for r in V.select_within_radius(order, radius).collect()} <= ids


def test_rows_below_the_best_so_far_are_not_ranked(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 12)) * rng.choice([1e-3, 1.0, 40.0], (3000, 1))
    x[2000:2040] = x[5]  # equal rows in both halves
    x[2500:2520] = x[7] * (1 + 1e-9 * rng.normal(size=(20, 1)))  # nearer to each other than single precision tells
    x[9] = 0.0
    q, ids = x[:400], rng.permutation(3000)
    sim = np.stack([np.einsum("ij,ij->i", np.broadcast_to(v, x.shape), x) for v in q])
    want = [sorted(zip(-sim[i], ids, strict=True))[:6] for i in range(len(q))]
    best = V._most_similar(q, ids[:1500], x[:1500], 6)
    assert best[0].tolist() == np.repeat(np.arange(400), 6).tolist()
    calls, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **b: calls.append(a[0].shape[0]) or partition(*a, **b))
    more = V._most_similar(q, ids[1500:], x[1500:], 6, best[2][5::6])
    assert not calls and len(more[0]) < 0.9 * len(q) * 6
    at, found, value = V._first_of(*(np.concatenate(pair) for pair in zip(best, more, strict=True)), 6)
    assert [(-v, i) for v, i in zip(value, found, strict=True)] == [row for rows in want for row in rows]
    assert at.tolist() == best[0].tolist()
    low = V._most_similar(q, ids[1500:], x[1500:], 6, np.full(400, -1e9))  # a floor that rules out nothing
    assert len(calls) and all(np.array_equal(a, b) for a, b in zip(low, V._most_similar(q, ids[1500:], x[1500:], 6), strict=True))
