import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import detect, flow

PRED = "video string, label string, frame long, x double, y double, likelihood double"


def trace(spark, lik, label="0", frames=None):
    frames = range(len(lik)) if frames is None else frames
    rows = [("v", label, int(f), float(f), 10.0, None if p is None else float(p)) for f, p in zip(frames, lik)]
    return spark.createDataFrame(rows, PRED)


def expected_gaps(lik, low=0.6, high=0.9, bracket=5, max_gap=45):
    """Runs of unsure frames as matches of a pattern over one letter per frame, each with the first predicate it fails."""
    letters = "".join("?" if p is None else "c" if p >= high else "u" if p > low else "s" for p in lik)
    predicates = {
        "not_severe": lambda m: set(m[0]) == {"u"},
        "too_long": lambda m: len(m[0]) > max_gap,
        "at_video_edge": lambda m: min(m.start(), len(letters) - m.end()) < bracket,
        "bracket_too_short": lambda m: (letters[: m.start()][-bracket:] + letters[m.end() :][:bracket]) != "c" * 2 * bracket,
    }
    return [
        (m.start(), m.end() - 1, next((why for why, fails in predicates.items() if fails(m)), None))
        for m in re.finditer("[^c]+", letters)
    ]


def test_one_gap(spark):
    lik = np.full(200, 0.99)
    lik[100:110] = 0.1
    r = detect.find_gaps(trace(spark, lik)).collect()
    assert len(r) == 1 and (r[0].start, r[0].end, r[0].length) == (100, 109, 10)
    assert (r[0].ax0, r[0].ax1, r[0].min_likelihood) == (99.0, 110.0, pytest.approx(0.1))


def test_declined_runs(spark):
    lik = np.full(2000, 0.99)
    lik[:6] = lik[500:1401] = lik[1995:] = 0.1
    lik[200:210] = 0.8
    got = sorted((r.start, r.reason) for r in detect.rejected_runs(trace(spark, lik)).collect())
    assert got == [(0, "at_video_edge"), (200, "not_severe"), (500, "too_long"), (1995, "at_video_edge")]


@pytest.mark.parametrize("block", [6, 16, None])
@pytest.mark.parametrize("dense", [True, False])
def test_gaps_across_blocks(spark, block, dense):
    rng = np.random.default_rng(7)
    lik = [None if rng.random() < 0.03 else float(rng.choice([0.2, 0.7, 0.95, 0.95, 0.95, 0.95])) for _ in range(150)]
    frames = None if dense else range(0, 450, 3)
    out = detect.uncertain_runs(trace(spark, lik, frames=frames), bracket=3, max_gap=4, dense=dense, block=block)
    step = 1 if dense else 3
    got = sorted((r.start // step, r.end // step, r.reason) for r in out.collect())
    assert got == sorted(expected_gaps(lik, bracket=3, max_gap=4), key=lambda t: t[:2])


def test_missing_likelihood_is_not_confident_and_severe(spark):
    lik = [0.99] * 30
    lik[15] = None
    r = detect.find_gaps(trace(spark, lik)).collect()
    assert [(x.start, x.end, x.min_likelihood) for x in r] == [(15, 15, None)]


def test_low_confidence_order_and_missing(spark):
    a = trace(spark, [0.9, 0.2, 0.8, 0.99, 0.1, 0.1])
    b = trace(spark, [0.95, 0.99, 0.4, 0.99, 0.1, None], label="1")
    out = detect.low_confidence_frames(a.unionByName(b), 0.6, max_frames=10)
    assert [r.frame for r in out.orderBy("rank").collect()] == [4, 1, 2]


def flow_points(spark, xs, ys=None, shift=0.0):
    ys = [10.0] * len(xs) if ys is None else ys
    return spark.createDataFrame(
        [("v", "0", i, float(x) + shift, float(y)) for i, (x, y) in enumerate(zip(xs, ys))],
        "video string, label string, frame long, x double, y double",
    )


@pytest.mark.parametrize("block", [50, None])
def test_disagreement_runs(spark, block):
    rng = np.random.default_rng(0)
    x = np.linspace(0, 100, 200)
    landed = flow_points(spark, x + rng.normal(0, 0.4, 200))
    bad = x.copy()
    bad[[50, 120, 121]] += 20
    got = detect.disagreement_blips(flow_points(spark, bad), landed, block=block).collect()
    assert sorted((r.start, r.end) for r in got) == [(50, 50), (120, 121)]


def test_motion_alone_is_no_blip(spark):
    x = 5.0 * np.arange(100)
    assert detect.disagreement_blips(flow_points(spark, x), flow_points(spark, x)).count() == 0


def test_blip_anchors_and_edges(spark):
    x = np.arange(50.0)
    landed = flow_points(spark, x, shift=0.1)
    bad = x.copy()
    bad[25] += 30
    bad[49] += 30
    got = detect.disagreement_runs(flow_points(spark, bad), landed).collect()
    inner = [r for r in got if r.reason is None]
    assert [(r.start, r.ax0, r.ax1) for r in inner] == [(25, 24.0, 26.0)]
    assert [(r.start, r.reason) for r in got if r.reason] == [(49, "edge")]


def test_blips_as_gaps(spark):
    blips = spark.createDataFrame(
        [("v", "0", 5, 6), ("v", "1", 5, 6), ("w", "0", 5, 6)], "video string, label string, start long, end long"
    )
    pred = trace(spark, [0.99] * 10).unionByName(trace(spark, [0.5] * 10, label="1"))
    got = {(r.video, r.label): (r.min_likelihood, r.reason) for r in detect.attach_min_likelihood(blips, pred).collect()}
    assert got == {("v", "0"): (0.99, None), ("v", "1"): (0.5, "also_low_likelihood"), ("w", "0"): (None, None)}
    assert detect.attach_min_likelihood(blips, None).where(F.col("min_likelihood").isNull()).count() == 3


def steps(spark, n, dx=1.0, dy=1.0, labels=("0",)):
    rows = [
        ("v", lab, i, None if i == 0 else dx, None if i == 0 else dy, None if i == n - 1 else -dx, None if i == n - 1 else -dy)
        for lab in labels
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "video string, label string, frame long, dx_fwd double, dy_fwd double, dx_rev double, dy_rev double"
    )


@pytest.mark.parametrize("block", [4, None])
def test_flow_residual_of_a_jump(spark, block):
    n = 30
    x = np.arange(n, dtype=float)
    bad = x.copy()
    bad[15] += 30
    pos = flow_points(spark, bad, x)
    r = {q.frame: q for q in flow.flow_residual(pos, steps(spark, n), block=block).collect()}
    assert sorted(r) == list(range(1, n - 1))
    assert r[15].residual == pytest.approx(30) and r[15].agreement == pytest.approx(0)
    some = flow.flow_residual(pos, steps(spark, n), frames=pos.where("frame in (0, 15, 20)"), block=block).collect()
    assert sorted(q.frame for q in some) == [15, 20]


def test_flow_layer_needs_all_labels_flow_residual_does_not(spark):
    n = 6
    a = flow_points(spark, range(n), range(n))
    b = a.where("frame <> 2").withColumn("label", F.lit("1"))
    pos, step = a.unionByName(b), steps(spark, n, labels=("0", "1"))
    landed = flow.flow_layer(pos, step)
    assert sorted((r.label, r.frame) for r in landed.collect()) == sorted((l, f) for l in "01" for f in (1, 2, 4, 5))
    residual = flow.flow_residual(pos, step)
    assert {r.frame for r in residual.where("label = '0'").collect()} == {1, 2, 3, 4}
    assert {r.frame for r in residual.where("label = '1'").collect()} == {4}


def test_nearest_confident_is_strict(spark):
    out = detect.nearest_confident(trace(spark, [0.1, 0.95, 0.1, 0.95, 0.95]), block=2).orderBy("frame").collect()
    assert [(r.before and r.before.frame, r.after and r.after.frame) for r in out] == [
        (None, 1), (None, 3), (1, 3), (1, 4), (3, None),
    ]
