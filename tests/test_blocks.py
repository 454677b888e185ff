import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions import blocks
from trackspark.operators import runs as R

KEYS = ["video", "label"]


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    rows = []
    for v in "ab":
        for lab in "01":
            frames = sorted(rng.sample(range(60), 35))
            rows += [(v, lab, f, rng.choice([None, float(rng.randint(0, 9))])) for f in frames]
    return rows, spark.createDataFrame(rows, "video string, label string, frame long, v double")


def by_trace(rows):
    out = defaultdict(list)
    for v, lab, f, x in rows:
        out[v, lab].append((f, x))
    return {k: sorted(s) for k, s in out.items()}


@pytest.mark.parametrize("block", [4, 7, 1000, None])
def test_scan_equals_one_walk_over_the_trace(series, block):
    rows, df = series
    v = F.col("v")
    specs = {k: (k, v) for k in ("sum", "rsum", "last", "prev", "first", "next")}
    got = {(r.video, r.label, r.frame): r for r in blocks.scan(df, KEYS, specs, block=block).collect()}
    for key, s in by_trace(rows).items():
        vals = [x for _, x in s]
        for i, (f, _) in enumerate(s):
            r = got[(*key, f)]
            known = lambda part: [x for x in part if x is not None]
            for name, part, pick in [
                ("last", vals[: i + 1], -1), ("prev", vals[:i], -1), ("first", vals[i:], 0), ("next", vals[i + 1 :], 0),
            ]:
                want = known(part)
                assert r[name] == (want[pick] if want else None), (name, key, f)
            for name, part in [("sum", vals[: i + 1]), ("rsum", vals[i:])]:
                want = known(part)
                assert r[name] == (sum(want) if want else None), (name, key, f)


@pytest.mark.parametrize("block", [5, None])
def test_position_counts_rows(series, block):
    rows, df = series
    got = {(r.video, r.label, r.frame): r.pos for r in blocks.position(df, KEYS, block=block).collect()}
    for key, s in by_trace(rows).items():
        for i, (f, _) in enumerate(s):
            assert got[(*key, f)] == i


def test_top_per_group_keeps_the_same_rows_as_a_full_sort(spark):
    rng = random.Random(2)
    rows = [("g" if i % 2 else f"s{i % 5}", rng.randint(0, 40), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    got = blocks.top_per_group(df, ["g"], [F.col("v"), F.col("id")], 7, salt_on=["id"], salts=5)
    groups = defaultdict(list)
    for g, v, i in rows:
        groups[g].append((v, i))
    want = {(g, n + 1, i) for g, s in groups.items() for n, (_, i) in enumerate(sorted(s)[:7])}
    assert {(r.g, r["rank"], r.id) for r in got.collect()} == want


def brute_runs(frames, max_gap):
    out = []
    for f in sorted(frames):
        if out and f - out[-1][1] - 1 <= max_gap:
            out[-1][1] = f
            out[-1][2] += 1
        else:
            out.append([f, f, 1])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("block", [3, 8, 1000, None])
@pytest.mark.parametrize("max_gap", [0, 1, 5])
def test_runs_across_block_borders(spark, block, max_gap):
    rng = random.Random(block or 0)
    data = {("a", "0"): sorted(rng.sample(range(80), 45)), ("b", "0"): list(range(50)), ("b", "1"): [0, 79]}
    rows = [(v, lab, f, float(f)) for (v, lab), s in data.items() for f in s]
    df = spark.createDataFrame(rows, "video string, label string, frame long, x double")
    out = R.runs(df, max_gap=max_gap, block=block, mins={"low": "x"}, first={"a": "x"}, last={"z": "x"}, sums={"s": F.lit(1)})
    got = defaultdict(list)
    for r in out.collect():
        got[r.video, r.label].append((r.start, r.end, r.n_hits))
        assert (r.low, r.a, r.z, r.s, r.length) == (r.start, r.start, r.end, r.n_hits, r.end - r.start + 1)
    for key, frames in data.items():
        assert sorted(got[key]) == brute_runs(frames, max_gap)


def test_mask_fixture(spark):
    mask = [0, 1, 1, 0, 1, 0, 0, 1, 1, 1, 0]
    df = spark.createDataFrame([("v", "0", i) for i, m in enumerate(mask) if m], "video string, label string, frame long")
    spans = lambda g: sorted((r.start, r.end) for r in R.runs(df, max_gap=g).collect())
    assert spans(0) == [(1, 2), (4, 4), (7, 9)]
    assert spans(1) == [(1, 4), (7, 9)]
