"""Frames inside intervals against brute force, and runs of very many frames."""

import random

import pytest

from trackspark.functions import intervals
from trackspark.operators import detect

POINTS = "video string, label string, frame long, x double, y double, likelihood double"


def cover_of(spark, spans):
    rows = spark.createDataFrame(spans, "start long, end long")
    return {(r.start, r.end): [(n.level, n.node) for n in r.c] for r in rows.withColumn("c", intervals.cover(rows.start, rows.end)).collect()}


def test_cover_is_exact_and_short(spark):
    rng = random.Random(1)
    spans = [(0, 0), (5, 4), (63, 64), (0, 4095), (1, 4096), (-70, 3), (0, 10**6), (123, 10**12), (4096, 4096 * 64 - 1)]
    spans += [(a, a + rng.randint(0, 9000)) for a in (rng.randint(-500, 5000) for _ in range(40))]
    for (start, end), nodes in cover_of(spark, spans).items():
        ranges = sorted((n << (6 * k), (n + 1 << (6 * k)) - 1) for k, n in nodes)
        assert len(nodes) <= 126 * 8
        if end < start:
            assert not nodes
            continue
        assert ranges[0][0] == start and ranges[-1][1] == end
        assert all(b[0] == a[1] + 1 for a, b in zip(ranges, ranges[1:]))


def test_points_in_overlapping_runs(spark):
    rng = random.Random(2)
    points = [("v", str(k % 2), f, float(f), 0.0, rng.random()) for k in range(2) for f in range(-100, 9000, 3)]
    runs = [("v", "0", a, a + rng.choice([0, 5, 80, 4500])) for a in (rng.randint(-200, 9000) for _ in range(25))] + [("v", "1", 10, 9), ("w", "1", 0, 50)]
    df, spans = spark.createDataFrame(points, POINTS), spark.createDataFrame(runs, "video string, label string, start long, end long")
    hit = lambda p: any(p[0] == v and p[1] == lab and a <= p[2] <= b for v, lab, a, b in runs)
    assert sorted(map(tuple, detect.points_in_runs(df, spans).collect())) == sorted(p for p in points if hit(p))
    met = intervals.meet(df.select("video", "label", "frame"), spans).collect()
    want = [(p[0], p[1], p[2], a, b) for p in points for v, lab, a, b in runs if (v, lab) == p[:2] and a <= p[2] <= b]
    assert sorted((r.video, r.label, r.frame, r.start, r.end) for r in met) == sorted(want)
    assert detect.points_in_runs(df, spans.where("false")).count() == 0


def test_runs_of_a_million_frames(spark):
    points = spark.range(0, 3_000_000, 1000).selectExpr("'v' AS video", "'0' AS label", "id AS frame", "1D AS x", "1D AS y", "0.2D AS likelihood")
    runs = spark.createDataFrame([("v", "0", 500, 1_000_500), ("v", "0", 2_000_000, 2_999_999)], "video string, label string, start long, end long")
    assert intervals.with_nodes(runs).count() < 500
    assert detect.points_in_runs(points, runs).count() == 2000
    lows = detect.attach_min_likelihood(runs, points).orderBy("start").collect()
    assert [r.min_likelihood for r in lows] == [pytest.approx(0.2)] * 2
