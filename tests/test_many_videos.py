"""What is written for many videos: whole, and not in files or folders for each of them."""

import os

import numpy as np

from trackspark.catalog import filing
from trackspark.operators import vectors
from trackspark.schema import PRED
from trackspark.sources import files
from trackspark.sources.layer_files import write_layer_files
from trackspark.streaming.arrivals import read_results, stream_predictions

POINTS = "video string, layer string, label string, frame long, x double, y double"


def written(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.startswith((".", "_"))]


def test_sidecar_of_many_videos(spark, tmp_path):
    rows = [(f"v{i}", "a b" if i % 2 else "", str(label), f, float(i), 2.0) for i in range(150) for f in range(3) for label in range(1 + f % 2)]
    target = str(tmp_path / "dropped")
    files.write_dropped_sidecar(spark.createDataFrame(rows, POINTS), target, ["0", "1"])
    assert len(written(target)) <= 12
    got = sorted((r.video, r.layer, r.frame, r.present) for r in files.read_dropped_sidecar(spark, target).collect())
    assert got == sorted((f"v{i}", "a b" if i % 2 else "", f, f'{{"0":[{float(i)},2.0]}}') for i in range(150) for f in (0, 2))
    assert files.discover_layers(spark, target).count() == 0


def test_results_of_many_videos(spark, tmp_path):
    deliver = lambda n, rows: spark.createDataFrame(rows, PRED).write.parquet(f"{tmp_path}/in/{n}")
    low = {"low": lambda df: df.where("likelihood < 0.5").select("video", "frame")}
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def stream(checkpoint):
        stream_predictions(spark, source, target, low, checkpoint=str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r.video, r.frame) for r in read_results(spark, target, "low").collect())

    deliver("a", [(f"v{i}", "0", f, 0.0, 0.0, 0.1 + 0.6 * (f % 2)) for i in range(150) for f in range(3)])
    assert stream("one") == sorted((f"v{i}", f) for i in range(150) for f in (0, 2))
    assert len(written(target)) <= 12
    deliver("b", [("v1", "0", 1, 0.0, 0.0, 0.9), ("v2", "0", 7, 0.0, 0.0, 0.2)])
    want = sorted([(f"v{i}", f) for i in range(150) if i not in (1, 2) for f in (0, 2)] + [("v2", 7)])
    assert stream("one") == want
    (tmp_path / "in").rename(tmp_path / "before")
    deliver("c", [("v3", "0", 5, 0.0, 0.0, 0.2)])  # another stream starts with micro-batch 0 again
    assert stream("two") == sorted([r for r in want if r[0] != "v3"] + [("v3", 5)])


def test_neighbours_write_a_row_only_once(spark, tmp_path, monkeypatch):
    """Rows and queries are stored once, however many pieces of a cell they meet."""
    x = np.random.default_rng(5).normal(size=(1500, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(vectors, "scratch_dir", lambda _, name: str(tmp_path / name))
    got = vectors.knn(df, df, 3, query_limit=10, cells=2, rows=5).orderBy("query_id", "rank").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [r.id for r in got] == np.argsort(-(unit @ unit.T), axis=1)[:, :3].ravel().tolist()
    stored = spark.read.parquet(str(tmp_path / "cells"))
    assert stored.count() == 1500 and len(written(tmp_path / "cells")) <= 40


def test_layers_of_many_videos(spark, tmp_path):
    points = spark.createDataFrame([(f"v{i}", "a b", "0", f, float(i), None) for i in range(150) for f in range(2)], POINTS)
    declared = points.select("video", "layer", "label").distinct()
    files.write_layers(points, declared, str(tmp_path / "layers"))
    assert len(written(tmp_path / "layers")) <= 12
    back, labels = files.read_written_layers(spark, str(tmp_path / "layers"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, points.collect())) and labels.count() == 150


def test_listing_beside_a_sidecar(spark, tmp_path):
    points = spark.createDataFrame([(f"v{i}", "one", "0", 3, float(i), 2.0) for i in range(60)], POINTS)
    target = str(tmp_path / "project")
    write_layer_files(points, points.select("video", "layer", "label").distinct(), target)
    files.write_dropped_sidecar(points, f"{target}/dropped", ["0", "1"])
    assert len(written(target)) <= 60 + 12
    listed = files.discover_layers(spark, target).collect()
    assert sorted(r.video for r in listed) == sorted(f"v{i}" for i in range(60)) and {r.layer for r in listed} == {"one"}


def test_training_tables_of_many_videos(spark, tmp_path):
    points = spark.createDataFrame([(f"v{i}", "one", "0", f, float(i), 2.0) for i in range(150) for f in range(2)], POINTS)
    files.write_training_feed(points, ["0", "1"], str(tmp_path / "training"))
    found = written(tmp_path / "training")
    assert len(found) <= 12 and all(open(f).readline().startswith("scorer,") for f in found)
    back = files.read_training_csv(spark, str(tmp_path / "training"), file_glob="*.txt")
    assert sorted((r.video, r.frame, r.x) for r in back.collect()) == sorted((f"v{i}", f, float(i)) for i in range(150) for f in range(2))


def test_traces_of_many_videos(spark, tmp_path):
    named = lambda i: ("scorer", 'a, "b"\\', " c ")[i] if i < 3 else f"v{i}"
    rows = [(named(i), "1", f, float(i), None, 0.5) for i in range(150) for f in range(2)]
    files.write_predictions_csv(spark.createDataFrame(rows, PRED), ["0", "1"], str(tmp_path / "traces"))
    assert len(written(tmp_path / "traces")) <= 12
    back = files.read_predictions_csv(spark, str(tmp_path / "traces"), file_glob="*.txt", with_video=True)
    assert sorted((r.video, r.label, r.frame, r.x, r.y, r.likelihood) for r in back.collect()) == sorted(rows)


def test_listing_makes_its_points_once(spark, monkeypatch):
    made = []
    real = filing.src.manual_layer
    monkeypatch.setattr(filing.src, "manual_layer", lambda *a: made.append(a) or real(*a))
    monkeypatch.setattr(filing, "settle", lambda df: made.append("settled") or df)
    listed = filing.layer_file_listing(spark, "/root/testdata/sf0.001")
    assert len(made) == 2 and made[1] == "settled" and listed.where("manual").count() == listed.count() > 0
