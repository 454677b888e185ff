"""Tables stored in blocks: the same rows as from plain tables, and no shuffle between storage and window."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from trackspark.functions import blocks
from trackspark.operators import detect, flow, smooth
from trackspark.sources import layout

BLOCK = 16


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    points, steps = [], []
    for video, n in (("long", 200), ("short", 9), ("mid", 40)):
        for label in ("0", "1"):
            for f in range(n):
                wrong = 30.0 if rng.random() < 0.04 else 0.0
                lik = 0.2 if rng.random() < 0.1 else 0.95
                points.append((video, label, f, f + wrong, 2.0 * f + rng.random(), lik))
                steps.append((video, label, f, 1.0 if f else None, 2.0 if f else None, -1.0 if f < n - 1 else None, -2.0 if f < n - 1 else None))
    points = spark.createDataFrame(points, "video string, label string, frame long, x double, y double, likelihood double")
    steps = spark.createDataFrame(steps, "video string, label string, frame long, dx_fwd double, dy_fwd double, dx_rev double, dy_rev double")
    return points, steps


@pytest.fixture(scope="module")
def stored(spark, tables):
    points, steps = tables
    put = lambda df: layout.store_blocks(df, f"t{uuid.uuid4().hex}", context=6, block=BLOCK, buckets=4)
    return put(points), put(steps), put(flow.flow_layer(points, steps))


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layout_is_known_and_keeps_the_rows(tables, stored):
    points = stored[0]
    assert blocks.layout_of(points) == (BLOCK, 6) and blocks.layout_of(tables[0]) is None
    assert blocks.layout_of(points.select("frame", blocks.BLK, blocks.OWN)) == (BLOCK, 6)
    assert rows_of(blocks.plain_rows(points)) == rows_of(tables[0])
    assert blocks.with_halo(points, before=6, after=2, block=BLOCK) is points
    for other in (dict(before=7, after=0, block=BLOCK), dict(before=1, after=1, block=8)):
        again = blocks.with_halo(points, **other)
        assert rows_of(blocks.own_rows(again)) == rows_of(tables[0])


def test_windows_start_without_a_shuffle(spark, stored):
    points, steps, _ = stored
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not small
    try:
        check_plans(points, steps, stored[2])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def check_plans(points, steps, landed):
    w = blocks.halo_window(["video", "label"], block=BLOCK)
    assert "Exchange" not in plan(blocks.with_halo(points, before=1, after=1, block=BLOCK).withColumn("p", F.lag("x").over(w)))
    assert "Exchange" not in plan(flow.flow_residual(points, steps, block=BLOCK))
    assert "Exchange" not in plan(detect.disagreement(points, landed))
    met = lambda key, a, b: a.select(["frame"])
    for other in (steps, points):
        assert "Exchange" not in plan(blocks.meet_blocks(points, other, met, "frame long", keys=("video", "label")))


def test_same_rows_as_from_plain_tables(spark, tables, stored):
    points, steps = tables
    landed = flow.flow_layer(points, steps)
    videos = points.groupBy("video").agg((F.max("frame") + 1).alias("n_frames"))
    assert rows_of(flow.flow_residual(stored[0], stored[1], block=BLOCK)) == rows_of(flow.flow_residual(points, steps))
    found = detect.disagreement_runs(stored[0], stored[2], block=BLOCK)
    assert found.count() > 5 and rows_of(found) == rows_of(detect.disagreement_runs(points, landed))
    gaps = detect.uncertain_runs(stored[0], dense=True, block=BLOCK)
    assert gaps.count() > 5 and rows_of(gaps) == rows_of(detect.uncertain_runs(points))
    assert rows_of(detect.uncertain_runs(stored[0], block=BLOCK)) == rows_of(gaps)
    near = lambda df: {(r.video, r.label, r.frame): (r.x, r.y) for r in df.collect()}
    a = near(smooth.smooth_moving_average(stored[0], stored[1], videos, n_window=5, block=BLOCK))
    b = near(smooth.smooth_moving_average(points, steps, videos, n_window=5))
    assert set(a) == set(b) and len(a) == points.count()
    assert all(a[k] == pytest.approx(b[k]) for k in a)
