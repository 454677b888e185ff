"""Layer files that are written all or none, and traces that arrive in parts."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackspark.operators import detect
from trackspark.schema import PRED
from trackspark.sources import files, layer_files
from trackspark.streaming.parts import GAP, gaps_in_parts

POINTS = "video string, layer string, label string, frame long, x double, y double"


def test_one_file_for_each_layer(spark, tmp_path):
    points = spark.createDataFrame([("a", "one", "0", 3, 1.5, 2.0), ("a", "one", "1", 12, 0.25, -1.0), ("b", "", "0", 0, 7.0, 8.0)], POINTS)
    declared = spark.createDataFrame([("a", "one", n) for n in ("0", "1", "2")] + [("b", "", "0"), ("c", "none", "5")], "video string, layer string, label string")
    target = str(tmp_path / "layers")
    layer_files.write_layer_files(points, declared, target)
    found = {f: os.path.join(d, f) for d, _, names in os.walk(target) for f in names if f.endswith(".json")}
    assert set(found) == {"a_annotations_one.json", "b_annotations.json", "c_annotations_none.json"}
    with open(found["a_annotations_one.json"]) as f:
        assert json.load(f) == {"0": {"3": [1.5, 2.0]}, "1": {"12": [0.25, -1.0]}, "2": {}}
    back, labels = layer_files.read_layer_files(spark, target)
    assert back.where("layer = 'one'").count() == 2 and back.count() == 3
    assert {(r.video, r.label) for r in labels.collect()} == {("a", "0"), ("a", "1"), ("a", "2"), ("b", "0"), ("c", "5")}
    layer_files.write_layer_files(points.where("video = 'b'"), declared.where("video = 'b'"), target)  # a delivery more
    assert layer_files.read_layer_files(spark, target)[0].count() == 4
    assert len([d for d in os.listdir(target) if d.startswith("delivery-")]) == 2
    layer_files.write_layer_files(points.where("false"), declared.where("false"), str(tmp_path / "nothing"))


@pytest.mark.parametrize("name", ["a_annotations_one.h5", "x/a_annotations_one.json"])
def test_a_refused_name_leaves_nothing(spark, tmp_path, name):
    rows = spark.createDataFrame([(f"v{i}_annotations.json", "{}") for i in range(20)] + [(name, "{}")], "file string, document string").repartition(4)
    spark.dataSource.register(layer_files.LayerFiles)
    target = tmp_path / "refused"
    with pytest.raises(Exception, match="layer files end|has no folder"):
        rows.write.format("layer_files").mode("append").save(str(target))
    assert not target.exists() or not os.listdir(target)
    with pytest.raises(ValueError):
        files.check_layer_path("a.h5")


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_in_parts_equal_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, parts = [], []
    for video in "abcdef":
        part = 0
        for f in range(rng.choice([30, 70, 150])):
            r = rng.random()
            likelihood = None if r < 0.03 else 0.1 + r if r < 0.25 else 0.95
            likelihood = 0.2 if video == "f" and 20 <= f < 75 else likelihood  # longer than any gap
            part += rng.random() < 0.04
            rows.append((video, "0", f, float(f), -float(f), likelihood))
            parts.append(min(part, 3))
    df = spark.createDataFrame([(*r, p) for r, p in zip(rows, parts, strict=True)], "video string, label string, frame long, x double, y double, likelihood double, part int")
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    for number in range(4):
        df.where(F.col("part") <= number).where(F.col("part") >= number - (number == 2)).drop("part").write.parquet(f"{source}/{number}")  # one part comes twice
        stream = spark.readStream.schema(PRED).option("recursiveFileLookup", "true").parquet(source)
        out = gaps_in_parts(stream, bracket=2, max_gap=9).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        out.outputMode("append").trigger(availableNow=True).start(target).awaitTermination()
    got = sorted(map(str, spark.read.schema(GAP).parquet(target).collect()))
    want = detect.find_gaps(df.drop("part"), bracket=2, max_gap=9, dense=True)
    assert got == sorted(map(str, want.select(*[f.name for f in spark.createDataFrame([], GAP).schema]).collect())) and len(got) > 15


class _Held:
    """State of one trace, and a stream that gives back the function it is asked to run."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value

    def select(self, *_):
        return self

    groupBy = select

    def applyInPandasWithState(self, step, *_):
        return step


def test_parts_without_gaps_make_no_tables():
    part = lambda frames, low=(): pd.DataFrame({
        "frame": frames, "x": [float(f) for f in frames], "y": [None] * len(frames), "likelihood": [0.1 if f in low else 0.99 for f in frames],
    })
    state = _Held()
    step = gaps_in_parts(state, bracket=2, max_gap=9)
    assert list(step(("v", "0"), iter([part([3, 1, 2, 0]), part([2, 4, 5], {5})]), state)) == []
    assert state.get[0] == [3, 4, 5] and state.get[2] == [None] * 3
    found = list(step(("v", "0"), iter([part([7, 5, 6, 8])]), state))
    assert [(r.start, r.end, r.ax0, r.ax1) for f in found for r in f.itertuples()] == [(5, 5, 4.0, 6.0)]
