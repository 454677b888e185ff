import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions import names
from trackspark.operators import detect, models
from trackspark.plans import workflows
from trackspark.sources import files
from trackspark.streaming.arrivals import read_results, stream_predictions


def one(spark, col):
    return spark.range(1).select(col.alias("c")).first().c


@pytest.mark.parametrize(
    "path,want",
    [
        ("/p/v1_annotations.json", ""),
        ("/p/v1_annotations_ab_cd.json", "ab_cd"),
        ("/p/videos/iteration-2/v1DLC_net_shuffle1_500.csv", "dlc_iteration-2_500"),
        ("/p/iteration-0/v1DLC_net_500_lkmovavg_0.5.json", "dlc_iteration-0_0.5"),
        ("C:\\p\\v1_annotations_x.json", "x"),
        ("/p/clip.final.mp4", "clip.final"),
    ],
)
def test_layer_names(spark, path, want):
    assert one(spark, names.layer_name(F.lit(path))) == want


def test_dense_and_manual(spark):
    dense = {n: one(spark, names.is_dense(F.lit(n))) for n in ("dlc_a", "dlccorr", "lk_x", "deblip_y", "a_lkmovavg_1", "blips_a", "it", "")}
    assert [n for n, v in dense.items() if not v] == ["blips_a", "it", ""]
    manual = lambda layer, path=None: one(
        spark, names.is_manual(F.lit(layer)) if path is None else names.is_manual(F.lit(layer), F.lit(path), F.lit("/p/v1.mp4"))
    )
    assert manual("pn") and not manual("dlccorr") and not manual("blips_a") and not manual("buffer")
    assert manual("pn", "/p/v1_annotations_pn.json")
    assert not manual("pn", "/q/v1_annotations_pn.json") and not manual("pn", "/p/v10_annotations_pn.json")
    assert not manual("pn", "/p/v1_annotations_pn.csv")


def test_paths_and_images(spark):
    assert one(spark, names.layer_path(F.lit("/p/v1.mp4"), F.lit("pn"))) == "/p/v1_annotations_pn.json"
    assert one(spark, names.layer_path(F.lit("/p/v1.mp4"), F.lit(""))) == "/p/v1_annotations.json"
    assert one(spark, names.image_name(F.lit(7), F.lit(36715))) == "img00007.png"
    assert one(spark, names.image_name(F.lit(1234567), width=6)) == "img1234567.png"
    rebase = lambda c, o: tuple(one(spark, names.rebase_path(F.lit(c), F.lit(o))))
    assert rebase("/new/Proj/config.yaml", "D:\\x\\Proj\\a\\Proj\\v.mp4") == ("/new/Proj/v.mp4", "ok")
    assert rebase("D:\\new\\proj", "/old/PROJ/videos/v.mp4") == ("D:\\new\\proj\\videos\\v.mp4", "ok")
    assert rebase("/new/proj", "/old/proj") == ("/new/proj", "ok")
    assert rebase("/new/proj", "/old/else/v") == (None, "folder_not_found")


def test_bodypart_labels(spark):
    df = spark.createDataFrame(
        [("a", "point10"), ("a", "point2"), ("b", "nose"), ("b", "ear")], "file string, bodypart string"
    ).withColumn("pos", F.when(F.col("bodypart").isin("nose", "point10"), 0).otherwise(1))
    got = lambda **kw: {r.bodypart: r.label for r in names.label_from_bodypart(df, **kw).collect()}
    assert got() == {"point10": "10", "point2": "2", "nose": "1", "ear": "0"}
    assert got(mode="config", pos="pos") == {"point10": "10", "point2": "2", "nose": "0", "ear": "1"}
    assert got(mode="strip")["nose"] == "nose"


def test_read_layer_files(spark, tmp_path):
    (tmp_path / "v1_annotations_pn.json").write_text(
        json.dumps({"0": {"5": [1, 2], "12": [3.5, None]}, "1": {}}, indent=4)
    )
    (tmp_path / "v 2_annotations.json").write_text(json.dumps({"0": {"1": [0, 0]}}))
    pts, decl = files.read_layers(spark, str(tmp_path))
    assert sorted((r.video, r.layer, r.label, r.frame, r.x, r.y) for r in pts.collect()) == [
        ("v 2", "", "0", 1, 0.0, 0.0), ("v1", "pn", "0", 5, 1.0, 2.0), ("v1", "pn", "0", 12, 3.5, None),
    ]
    assert {(r.video, r.label) for r in decl.collect()} == {("v 2", "0"), ("v1", "0"), ("v1", "1")}
    listed = {r.layer: (r.kind, r.manual) for r in files.discover_layers(spark, str(tmp_path)).collect()}
    assert listed == {"pn": ("annotation", True), "": ("annotation", True)}


def test_layer_round_trip_in_several_documents(spark, points, declare, tmp_path):
    pts = points({"0": {f: (f, 1) for f in range(0, 50, 7)}, "10": {3: (0.1, 0.2)}})
    docs = files.layer_documents(pts, declare(["0", "10", "4"]), block=16).collect()
    assert len(docs) == 4
    whole = json.loads(next(d.document for d in files.layer_documents(pts, declare(["0", "10", "4"])).collect()))
    assert list(whole) == ["0", "4", "10"] and list(map(int, whole["0"])) == list(range(0, 50, 7))
    files.write_layers(pts, declare(["0", "10", "4"]), str(tmp_path / "out"), block=16)
    back, decl = files.read_written_layers(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pts.collect()))
    assert [r.label for r in decl.orderBy("pos").collect()] == ["0", "4", "10"]
    empty = files.layer_documents(pts.limit(0), declare(["0"])).collect()
    assert [d.document for d in empty] == ['{"0": {}}']
    with pytest.raises(ValueError):
        files.check_layer_path("a.h5")


def test_prediction_csv(spark, tmp_path):
    head = ["scorer,s,s,s,s,s,s", "bodyparts,point0,point0,point0,nose,nose,nose", "coords,x,y,likelihood,x,y,likelihood"]
    body = ["0,1,2,0.9,,,", "1,nan,4,0.5,5,6,0.1"]
    (tmp_path / "v1DLC_net_100.csv").write_text("\n".join(head + body) + "\n")
    got = files.read_predictions_csv(spark, str(tmp_path))
    assert sorted((r.video, r.label, r.frame, r.x, r.y) for r in got.where("x is not null").collect()) == [
        ("v1", "0", 1, 5.0, 6.0), ("v1", "1", 0, 1.0, 2.0),
    ]
    assert got.count() == 3
    assert files.read_predictions_csv(spark, str(tmp_path), keep_empty=True).count() == 4


def test_training_tables(spark, points, tmp_path):
    pts = points({"0": {1: (1, 2), 2: (3, 4)}, "1": {1: (5, 6)}}, video="v1")
    files.write_training_feed(pts, ["0", "1"], str(tmp_path / "t"))
    images = spark.createDataFrame([("v1", "img000001.png")], "video string, image string")
    back = files.read_training_csv(spark, str(tmp_path / "t"), images=images, file_glob="*.txt")
    assert sorted((r.frame, r.label, r.x) for r in back.collect()) == [(1, "0", 1.0), (1, "1", 5.0)]
    (tmp_path / "img" / "v1").mkdir(parents=True)
    (tmp_path / "img" / "v1" / "img000002.png").write_bytes(b"x")
    assert [tuple(r) for r in files.list_images(spark, str(tmp_path / "img")).collect()] == [("v1", "img000002.png")]


def test_side_files(spark, points, tmp_path):
    (tmp_path / "map.txt").write_text("point0 - fascia\npoint2 - tip - left\n")
    parts = spark.createDataFrame([("point0",), ("point1",), ("point2",)], "bodypart string")
    got = {r.bodypart: r.display for r in files.display_names(parts, files.read_label_names(spark, str(tmp_path / "map.txt"))).collect()}
    assert got == {"point0": "fascia", "point1": "point1", "point2": "tip - left"}
    with pytest.raises(ValueError):
        files.write_dropped_sidecar(points({"0": {1: (1, 1)}}), str(tmp_path / "x.json"))
    files.write_dropped_sidecar(points({"0": {1: (1, 1)}}), str(tmp_path / "dropped"), ["0", "1"])
    assert spark.read.json(str(tmp_path / "dropped")).first().present == '{"0":[1.0,1.0]}'
    folder = tmp_path / "iteration-3"
    folder.mkdir()
    (folder / "e.csv").write_text(",  Training iterations: , Test error(px)\n0,100,5.5\n1,200,4.5\n")
    assert [(r.iteration, r.step, r.test_error) for r in files.read_evaluation(spark, str(tmp_path / "iteration-3")).orderBy("row_no").collect()] == [
        (3, 100, 5.5), (3, 200, 4.5),
    ]


def test_best_snapshot(spark):
    its = spark.createDataFrame([(0,), (1,), (2,)], "iteration int")
    ev = spark.createDataFrame([(0, 0, 100, 3.0), (0, 1, 200, 2.0), (0, 2, 300, 2.0)], "iteration int, row_no long, step long, test_error double")
    snaps = spark.createDataFrame(
        [(0, "snapshot-100", 100), (0, "snapshot-200", 200), (0, "snapshot-best-150", 150), (1, "snapshot-7", 7), (1, "snapshot-9", 9)],
        "iteration int, snapshot string, step long",
    )
    got = {r.iteration: (r.best_step, r.test_error, r.best_index) for r in models.best_snapshots(its, ev, snaps).collect()}
    assert got == {0: (200, 2.0, 1), 1: (9, -1.0, 1), 2: (None, -1.0, None)}
    best = {r.iteration: (r.best_step, r.best_index) for r in models.best_snapshots(its, ev, snaps, prefer_best=True).collect()}
    assert best[0] == (150, 2) and best[1] == (9, 1)
    assert models.latest_trained_iteration(its, snaps).first().latest_trained == 1
    assert models.latest_trained_iteration(its.limit(0), snaps).first().latest_trained == -1


def test_extent_and_contrast(spark, points):
    r = models.trace_extent(points({"0": {0: (0, 5), 1: (10, 5)}})).first()
    assert (r.x_lo, r.x_hi, r.y_lo, r.y_hi) == (-0.5, 10.5, 4.5, 5.5)
    rng = np.random.default_rng(0).integers(0, 60, 500)
    px = spark.createDataFrame([("v", 0, int(v)) for v in rng], "video string, frame long, intensity int")
    c = models.contrast_params(px).first()
    p5, p50, p95 = np.percentile(rng, [5, 50, 95])
    assert (c.p5, c.p50, c.p95) == pytest.approx((p5, p50, p95))
    assert c.clip == pytest.approx(1 + 3 * np.clip((75 - (p95 - p5)) / 75, 0, 1))


def test_deblip_refuses_other_layers(spark, points):
    rows = points({"0": {1: (1, 1)}}, layer="deblip_dlc_a").unionByName(points({"0": {1: (1, 1)}}, layer="pn"))
    for name in ("deblip_dlc_a", "pn"):
        assert workflows.deblip_source(rows, name).count() == 0


def test_stream_replaces_known_videos(spark, tmp_path):
    cols = "video string, label string, frame long, x double, y double, likelihood double"
    rows = lambda video, bad: spark.createDataFrame(
        [(video, "0", f, 1.0, 1.0, 0.1 if f in bad else 0.99) for f in range(30)], cols
    )
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))

    def run():
        stream_predictions(spark, src, out, {"gaps": detect.find_gaps}, checkpoint=ck).awaitTermination()
        return sorted((r.video, r.start) for r in read_results(spark, out, "gaps").collect())

    rows("a", {10}).write.parquet(f"{src}/a")
    assert run() == [("a", 10)]
    rows("b", {12}).write.parquet(f"{src}/b")
    assert run() == [("a", 10), ("b", 12)]
    assert run() == [("a", 10), ("b", 12)]
    rows("b", {14}).write.parquet(f"{src}/b-again")
    assert run() == [("a", 10), ("b", 14)]
    rows("a", set()).write.parquet(f"{src}/a-again")
    assert run() == [("b", 14)]


def test_traces_under_different_headers(spark, tmp_path):
    lay = lambda *parts: "scorer" + ",m" * 3 * len(parts) + "\nbodyparts" + "".join(f",{p}" * 3 for p in parts) + "\ncoords" + ",x,y,likelihood" * len(parts)
    traces = {
        "v1DLC_a.csv": lay("point1", "point0") + "\n0,2,3,0.9,5,6,0.8\n",
        "v2DLC_a.csv": lay("point0", "point1") + "\n0,5,6,0.8,2,3,0.9\n",
        "v3DLC_a.csv": lay("tail", "head", "paw") + "\n4.0,1,1,1,2,2,1,,,\n",
    }
    for name, text in traces.items():
        (tmp_path / name).write_text(text)
    got = {(r.video, r.label): (r.frame, r.x, r.y, r.likelihood) for r in files.read_predictions_csv(spark, str(tmp_path)).collect()}
    assert got == {
        ("v1", "0"): (0, 5.0, 6.0, 0.8), ("v1", "1"): (0, 2.0, 3.0, 0.9), ("v2", "0"): (0, 5.0, 6.0, 0.8),
        ("v2", "1"): (0, 2.0, 3.0, 0.9), ("v3", "0"): (4, 2.0, 2.0, 1.0), ("v3", "2"): (4, 1.0, 1.0, 1.0),
    }
