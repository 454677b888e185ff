import pytest
from pyspark.sql import functions as F

from trackspark.operators import asof, layers, quality, select, smooth

P = lambda frames, x=1.0, y=2.0: {f: (x, y) for f in frames}
POINT = ("label", "frame")


def test_merge_last_wins(points, rows):
    a = points({str(i): P(range(10)) for i in range(3)}, layer="l1")
    b = points({str(i): P([9, *range(50, 67, 2)], 5.0) for i in range(3)}, layer="l2")
    out = layers.merge_layers(a.unionByName(b), "layer")
    assert out.where("label = '1'").count() == 19
    assert [r.x for r in out.where("frame = 9").collect()] == [5.0] * 3


def test_keep_complete_frames(points, declare, rows):
    pts = points({"0": P([5, 6, 7, 8, 9]), "1": P([5, 6, 7, 9]), "2": P([5, 6, 7])})
    out = layers.keep_complete_frames(pts, declare("012"))
    assert {r.frame for r in out.collect()} == {5, 6, 7}
    assert {r.frame for r in layers.clip_frames(pts, 6, 8).collect()} == {6, 7, 8}
    # A declared but empty label makes every frame incomplete, so nothing is removed.
    assert layers.keep_complete_frames(pts, declare("0123")).count() == pts.count()


@pytest.mark.parametrize("block", [1, 4, None])
def test_keep_complete_runs(points, declare, block):
    pts = points({"0": P([5, 7, 10]), "1": P([5, 10])})
    assert {r.frame for r in layers.keep_complete_frames(pts, declare("01")).collect()} == {5, 10}
    assert layers.keep_complete_runs(pts, declare("01"), block=block).count() == pts.count()
    near = points({"0": P([3, 4, 7, 9]), "1": P([3, 4, 9])})
    assert {r.frame for r in layers.keep_complete_runs(near, declare("01"), block=block).collect()} == {3, 4}


def test_nothing_complete_stays(points, declare):
    pts = points({"0": P([0]), "1": P([5])})
    assert layers.keep_complete_frames(pts, declare("01")).count() == 2


def test_patch_by_presence(points, spark, rows):
    source = points({"0": P([1, 2], 1.0), "2": P([5])})
    patch = spark.createDataFrame(
        [("v", "p", "0", 2, None, None), ("v", "p", "1", 9, 7.0, 7.0)], source.schema
    )
    out = layers.patch_layer(source, patch)
    assert rows(out, *POINT) == [("0", 1), ("0", 2), ("1", 9), ("2", 5)]
    assert out.where("label = '0' and frame = 2").first().x is None
    again = layers.patch_layer(out, patch)
    assert layers.diff_layers(again.withColumn("layer", F.lit("a")), out.withColumn("layer", F.lit("a"))).count() == 0


def test_copy_from_overlay_needs_one_selection(points, declare):
    pts = points({"0": P([1])})
    with pytest.raises(ValueError):
        layers.copy_from_overlay(pts, pts, declare("0"))


def test_edits(points, spark, rows):
    log = spark.createDataFrame(
        [("v", "a", "0", 1, 9.0, 9.0, "add", 1), ("v", "a", "0", 2, None, None, "delete", 2),
         ("v", "a", "0", 7, None, None, "delete", 3), ("v", "a", "0", 1, 4.0, 4.0, "add", 4)],
        "video string, layer string, label string, frame long, x double, y double, op string, seq long",
    )
    out = layers.apply_edits(points({"0": P([1, 2, 3])}), log)
    assert rows(out, "frame", "x") == [(1, 4.0), (3, 1.0)]


def test_rename_collision_raises(points, declare):
    pts = points({"0": P([1])})
    both = declare("0").unionByName(declare("0", layer="b"))
    with pytest.raises(Exception, match="exists already"):
        layers.rename_layer(pts, both, "a", "b").collect()


def test_last_layer_is_not_dropped(points, declare):
    pts = points({"0": P([1])})
    assert layers.drop_layer(pts, declare("0").unionByName(declare("0", layer="buffer")), "a").count() == 1


def test_label_schema(points, declare, rows):
    pts = points({"1": P([1])})
    decl = declare(["0", "1", "2", "10"])
    assert rows(layers.clip_trailing_empty_labels(decl, pts), "label") == [("0",), ("1",)]
    assert rows(layers.clip_trailing_empty_labels(decl, points({})), "label") == [("0",)]
    assert rows(layers.remove_empty_labels(decl, pts), "label") == [("1",)]
    assert ("4", 3) in rows(layers.add_label(decl), "label", "pos")
    with pytest.raises(ValueError):
        layers.add_label(decl, "x")


def test_densify_block_borders_and_range(points, declare, spark):
    videos = spark.createDataFrame([("v", 10, 2.0)], "video string, n_frames long, fps double")
    pts = points({"0": P([0, 3, 40])})
    out = layers.densify(pts, declare("01"), videos, block=4).collect()
    assert len(out) == 20 and sum(r.x is not None for r in out) == 2
    assert {r.t for r in out} == {f / 2 for f in range(10)}
    with pytest.raises(Exception, match="outside"):
        layers.densify(pts, declare("01"), videos, on_out_of_range="error").collect()


def test_intervals(points, spark, rows):
    videos = spark.createDataFrame([("v", 100, 1.0)], "video string, n_frames long, fps double")
    raw = spark.createDataFrame([("v", "0", 120, -5)], "video string, label string, start long, end long")
    assert rows(layers.normalize_intervals(raw, videos), "start", "end") == [(0, 99)]
    pts = points({"0": P(range(0, 5000, 500)), "1": P([1500])})
    cut = spark.createDataFrame([("v", "0", 1000, 3000)], "video string, label string, start long, end long")
    assert rows(layers.remove_intervals(pts, cut), *POINT) == rows(
        pts.where("label = '1' or frame not between 1000 and 3000"), *POINT
    )
    assert layers.remove_intervals(pts, cut, all_labels=True).where("frame between 1000 and 3000").count() == 0


@pytest.mark.parametrize("block", [4, None])
def test_decimate(points, spark, block):
    span = lambda a, b: spark.createDataFrame([("v", a, b)], "video string, start long, end long")
    frames = lambda df: sorted({r.frame for r in df.collect()})
    holed = points({"0": P(range(10, 20)), "1": P(range(10, 20, 2))})
    assert frames(smooth.decimate_intervals(holed, span(10, 19), block=block)) == [10, 14, 18]
    whole = points({"0": P(range(10, 20)), "1": P(range(10, 20))})
    assert frames(smooth.decimate_intervals(whole, span(10, 19), block=block)) == [10, 12, 14, 16, 18]
    more = points({"0": P([*range(20, 30), 5, 7, 9, 35, 40, 45])})
    assert frames(smooth.decimate_intervals(more, span(20, 29), block=block)) == [5, 7, 9, 20, 22, 24, 26, 28, 35, 40, 45]


def test_incomplete_and_strays(points):
    pts = points({"0": P([1, 2]), "1": P([2]), "9": P([3])}, layer="iteration-0")
    got = {r.frame: r.missing for r in quality.incomplete_frames(pts, ["0", "1", "2"]).collect()}
    assert got == {1: ["1", "2"], 2: ["2"], 3: ["0", "1", "2"]}
    assert quality.stray_labels(pts, None).count() == 0
    assert quality.stray_labels(pts, []).count() == 4
    assert [(r.label, r.frame) for r in quality.stray_labels(pts, ["0", "1"]).collect()] == [("9", 3)]
    clean = quality.remediate(pts, ["0", "1"])
    assert [(r.label, r.frame) for r in clean.orderBy("label").collect()] == [("0", 2), ("1", 2)]
    dropped = quality.dropped_points(pts, ["0", "1"])
    assert dropped.count() + quality.remediate(pts, ["0", "1"], strip_strays=False).count() == pts.count()


def test_quality_report_leaves_out_clean_and_derived_layers(points):
    clean = points({"0": P([1]), "1": P([1])}, layer="iteration-0")
    derived = points({"0": P([1])}, layer="dlc_x")
    issues = quality.quality_issues(clean.unionByName(derived), required=["0", "1"])
    assert quality.quality_report(issues).count() == 0


def test_label_schema_check(spark):
    decl = spark.createDataFrame([("a", "0"), ("a", "2"), ("a", "10"), ("b", "0"), ("b", "2")], "video string, label string")
    r = quality.check_label_schema(decl).first()
    assert (r.n_videos, r.same_count, r.same_names, r.missing_somewhere) == (2, False, False, ["10"])
    assert r.bodyparts == ["point0", "point10", "point2"]
    empty = quality.check_label_schema(decl.limit(0)).first()
    assert (empty.n_videos, empty.same_names, empty.bodyparts) == (0, True, [])


@pytest.mark.parametrize("block", [3, None])
def test_neighbours_and_ties(points, spark, block):
    pts = points({"0": P([2, 6, 10])})
    probe = spark.createDataFrame([("v", "0", f) for f in (0, 2, 4, 9, 12)], "video string, label string, frame long")
    got = {r.frame: (r.nearest, r.previous, r.next) for r in asof.neighbour_frames(pts, probe, block=block).collect()}
    assert got == {0: (2, 0, 2), 2: (2, 2, 6), 4: (6, 2, 6), 9: (10, 6, 10), 12: (10, 10, 12)}


def test_select_frames_keeps_order_and_repeats(spark):
    pred = spark.createDataFrame([("v", "0", f, float(f)) for f in range(5)], "video string, label string, frame long, x double")
    want = spark.createDataFrame([("v", i, f, 5) for i, f in enumerate([3, 1, 3])], "video string, pos long, frame long, n_frames long")
    assert [r.x for r in asof.select_frames(pred, want).orderBy("pos").collect()] == [3.0, 1.0, 3.0]
    bad = want.withColumn("frame", F.lit(9).cast("long"))
    with pytest.raises(Exception, match="outside"):
        asof.select_frames(pred, bad).collect()
    videos = spark.createDataFrame([("v", 5)], "video string, n_frames long")
    assert [r.frame for r in asof.select_range(pred, videos, 1, 99, step=2).orderBy("pos").collect()] == [1, 3]
    for a, b in [(-1, 3), (3, 1)]:
        with pytest.raises(ValueError):
            asof.select_range(pred, videos, a, b)
    with pytest.raises(Exception, match="after the last"):
        asof.select_range(pred, videos, 7, 9).collect()


def test_nudge(points, spark):
    cols = "video string, label string, frame long, x double, y double, likelihood double"
    cases = {0: (103, 100, 100.2, 0.99), 1: (100.3, 100, 100, 0.99), 2: (120, 100, 100, 0.99), 3: (103, 100, 106, 0.99), 4: (103, 100, 100, 0.5)}
    pts = points({"0": {f: (c[0], 0) for f, c in cases.items()} | {9: (1, 1)}})
    now = spark.createDataFrame([("v", "0", f, float(c[1]), 0.0, c[3]) for f, c in cases.items()], cols)
    was = spark.createDataFrame([("v", "0", f, float(c[2]), 0.0, 0.99) for f, c in cases.items()], cols)
    got = {r.frame: (r.x, r.status) for r in asof.nudge_labels(pts, now, was).collect()}
    assert got == {
        0: (100.0, "nudged"), 1: (100.3, "on_target"), 2: (120.0, "flagged"),
        3: (103.0, "unconverged"), 4: (103.0, "unconverged"), 9: (1.0, "unconverged"),
    }
    half = asof.nudge_labels(points({"0": {0: (104, 0)}}), now, was, alpha=0.5).first()
    assert half.x == 102.0


def test_complete_entries_and_free_names(points, declare, spark):
    pts = points({"0": P([1, 2]), "1": P([2])})
    e = select.complete_frame_entries(pts, declare("01")).collect()
    assert [(r.frame, [p.label for p in r.points]) for r in e] == [(2, ["0", "1"])]
    used = spark.createDataFrame([("v", "a"), ("v", "a_diverse"), ("v", "a_diverse2"), ("w", "a")], "video string, layer string")
    got = {r.video: r.layer for r in select.free_layer_name(used, "a_diverse").collect()}
    assert got == {"v": "a_diverse3", "w": "a_diverse"}
    out = select.materialize_selection(pts, pts.where("frame = 2"), used, "a")
    assert {(r.layer, r.frame) for r in out.collect()} == {("a_diverse3", 2)}


def test_union_sources(spark):
    rows = lambda tag, frames: spark.createDataFrame([("v", None, f, tag) for f in frames], "video string, image string, frame long, tag string")
    out = select.union_sources(rows("a", range(5)), rows("b", range(3, 9)))
    assert {r.frame: r.tag for r in out.collect()} == {f: "a" if f < 5 else "b" for f in range(9)}
    assert select.union_sources(rows("a", range(3))).count() == 0
