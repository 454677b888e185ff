"""Order statistics against sorted values, in one round and in all of them."""

import random
import struct
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions import ranks
from trackspark.operators import runs as R


def test_sortable_is_the_order_of_doubles(spark):
    rng = random.Random(4)
    tiny = 5e-324
    values = [0.0, -0.0, 1.0, tiny, 3 * tiny, 2.0**-1022, 2.0**-1022 - tiny, 1.7976931348623157e308, float("inf")]
    values += [2.0**e * m for e in range(-1074, 1024, 13) for m in (1.0, 1 - 2**-53, 1 + 2**-52)]
    while len(values) < 4000:
        v = struct.unpack("<d", rng.getrandbits(63).to_bytes(8, "little"))[0]
        values += [v] if v == v else []
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double")
    got = [(r.s, r.v) for r in df.select(ranks.sortable(F.col("v")).alias("s"), "v").collect()]
    for s, v in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0] if v else 0
        assert v != v and s == max(x for x, _ in got) or s == (-bits if v < 0 else bits)


@pytest.mark.parametrize("in_order", [0, 3, 200, 10**6])
def test_percentiles_are_exact(spark, in_order):
    rng = np.random.default_rng(3)
    data = {
        "hot": rng.normal(size=5001).round(2), "small": rng.normal(size=12), "one": np.array([7.5]), "equal": np.full(400, -3.25),
        "near": 1 + rng.integers(0, 9, 300) * 2.0**-52, "wide": 10.0 ** rng.uniform(-300, 300, 501),
    }
    rows = [(k, float(x)) for k, s in data.items() for x in s] + [("small", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    wanted = {"p50": 0.5, "p90": 0.9, "p0": 0.0, "p100": 1.0}
    got = {r.k: r for r in ranks.percentiles(df, ["k"], "x", wanted, in_order=in_order).collect()}
    assert set(got) == set(data)
    for k, s in data.items():
        r = got[k]
        assert r.n == len(s) and r.v_min == s.min() and r.v_max == s.max()
        for name, p in wanted.items():
            assert r[name] == pytest.approx(np.percentile(s, 100 * p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("in_order", [0, 10**6])
def test_weighted_percentiles(spark, in_order):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 1), ("a", 9.0, 4), ("b", 3.0, 2)], "k string, x double, w long")
    got = {r.k: r for r in ranks.percentiles(df, ["k"], "x", {"m": 0.5, "q": 0.6}, weight="w", in_order=in_order).collect()}
    whole = [1.0] * 5 + [2.0] + [9.0] * 4
    assert (got["a"].n, got["a"].m) == (10, np.percentile(whole, 50)) and got["a"].q == pytest.approx(np.percentile(whole, 60))
    assert got["b"].m == 3.0


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert ranks.percentiles(df, ["k"], "x", {"m": 0.5}).count() == 0
    assert ranks.ordinal(df, ["k"], ["x"]).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_ordinal_is_exact_for_long_keys(spark, parts):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randint(0, 30), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, id long").repartition(parts)
    got = {r.id: r.pos for r in ranks.ordinal(df, ["k"], ["t", "id"]).collect()}
    groups = defaultdict(list)
    for k, t, i in rows:
        groups[k].append((t, i))
    for s in groups.values():
        for pos, (_, i) in enumerate(sorted(s)):
            assert got[i] == pos


@pytest.mark.parametrize("in_order", [0, 20, 10**6])
@pytest.mark.parametrize("framed", [False, True])
def test_robust_threshold_regimes(spark, in_order, framed):
    rng = np.random.default_rng(0)
    normal = rng.gamma(2.0, size=301)
    data = {"n": normal, "spiky": np.r_[np.zeros(30), 8.0], "flat": np.full(31, 2.0)}
    rows = [("v", k, i, float(x)) for k, s in data.items() for i, x in enumerate(s)]
    df = spark.createDataFrame(rows, "video string, label string, frame long, d double")
    out = R.robust_threshold(df if framed else df.drop("frame"), "d", in_order=in_order, block=50)
    got = {r.label: r for r in out.collect()}
    med = np.median(normal)
    mad = np.median(np.abs(normal - med))
    assert got["n"].threshold == pytest.approx(med + 5 * 1.4826 * mad)
    assert got["spiky"].threshold == pytest.approx(4.0)
    assert got["flat"].threshold == float("inf")


def test_short_keys_are_sorted_and_long_ones_narrowed(spark, monkeypatch):
    """A long key does not send the short ones through the rounds, and with short keys alone there are none."""
    narrowed = []
    real = ranks._narrowed_percentiles
    monkeypatch.setattr(ranks, "_narrowed_percentiles", lambda base, *a: narrowed.append(base.select("k").distinct().count()) or real(base, *a))
    rows = [(f"k{i}", float(i * j % 7)) for i in range(40) for j in range(5)] + [("hot", float(j)) for j in range(60)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: (r.n, r.m) for r in ranks.percentiles(df, ["k"], "x", {"m": 0.3}, in_order=10).collect()}
    assert narrowed == [1] and len(got) == 41
    for k in got:
        assert got[k] == (len(v := [x for key, x in rows if key == k]), pytest.approx(np.percentile(v, 30)))
    ranks.percentiles(df.where("k <> 'hot'"), ["k"], "x", {"m": 0.3}, in_order=10).collect()
    assert narrowed == [1]


@pytest.mark.parametrize("in_order", [0, 20, 60, 10**6])
def test_ordinal_of_short_and_long_keys(spark, in_order):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randint(0, 30), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, id long").repartition(5)
    got = {r.id: (r.k, r.pos) for r in ranks.ordinal(df, ["k"], ["t", "id"], in_order=in_order).collect()}
    place = {i: (k, sorted((u, j) for q, u, j in rows if q == k).index((t, i))) for k, t, i in rows}
    assert got == place


def test_ordinal_of_short_keys_deals_rows_once(spark, monkeypatch):
    monkeypatch.setattr(ranks, "settle", lambda df: pytest.fail("short keys are not settled"))
    df = spark.createDataFrame([(f"k{i % 9}", i) for i in range(90)], "k string, t long")
    plan = ranks.ordinal(df, ["k"], ["t"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" not in plan
