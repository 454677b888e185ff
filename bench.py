"""Time the headline operators on track tables derived from the test data.

The track tables are written to Parquet first, as a cohort would store them, and those that ordered operators read also in
blocks (`sources.layout`); that step is reported as ``setup`` and is not part of the value.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from trackspark.functions.blocks import BLOCK
from trackspark.operators import asof, detect, flow, layers, quality, repair, select, smooth, vectors
from trackspark.session import build_session
from trackspark.sources import adapters as src
from trackspark.sources.layout import store_blocks

STEP = ["video", "label", "frame"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    only = sys.argv[1:]
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.log.level": "ERROR",
        },
    )
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    start = time.perf_counter()

    def stored(name, df):
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    pred = stored("pred", src.predictions(spark, sf_dir))
    step = stored("flow", src.flow(spark, sf_dir))
    previous = stored("previous", src.previous_predictions(spark, sf_dir))
    manual = stored("manual", src.manual_layer(spark, sf_dir))
    patch = stored("patch", src.patch_layer_points(spark, sf_dir))
    dense = stored("dense", src.dense_layer(spark, sf_dir))
    landed = stored("landed", flow.flow_layer(pred, step))
    lines = stored("lines", src.line_tracks(spark, sf_dir))
    line_flow = stored("line_flow", src.line_flow(spark, sf_dir))
    line_videos = stored("line_videos", src.line_videos(spark, sf_dir))
    features = stored("features", src.embeddings(spark, sf_dir))

    def in_blocks(name, df, context):
        return store_blocks(df, f"bench_{name}", context=context)

    spark.sparkContext.setCheckpointDir(f"{root}/checkpoints")
    pred_b, step_b, landed_b = (in_blocks(n, df, 5) for n, df in (("pred", pred), ("flow", step), ("landed", landed)))
    lines_b, line_flow_b = (in_blocks(n, df, 36) for n, df in (("lines", lines), ("line_flow", line_flow)))
    short = long = BLOCK
    severe = stored(
        "severe",
        detect.uncertain_runs(pred, dense=True, block=short).where(
            "coalesce(reason, '') <> 'not_severe' AND ax0 IS NOT NULL AND ax1 IS NOT NULL"
        ),
    )
    repaired = stored("repaired", repair.repair_gaps(severe, step, block=short))
    setup = time.perf_counter() - start

    queries = {
        "find_gaps": lambda: detect.find_gaps(pred_b, max_gap=2, dense=True, block=short),
        "find_gaps_long_tracks": lambda: detect.uncertain_runs(lines_b, bracket=1, max_gap=12, dense=True, block=long),
        "disagreement_blips": lambda: detect.disagreement_blips(pred_b, landed_b, block=short),
        "flow_layer": lambda: flow.flow_layer(pred, step),
        "flow_residual": lambda: flow.flow_residual(pred_b, step_b, block=short),
        "repair_gaps": lambda: repair.repair_gaps(severe, step, block=short),
        "smooth_moving_average_w37": lambda: smooth.smooth_moving_average(
            lines_b, line_flow_b, line_videos, n_window=37, block=long
        ),
        "low_confidence_frames": lambda: detect.low_confidence_frames(pred, 0.6, max_frames=200),
        "merge_layers": lambda: layers.merge_layers(
            dense.unionByName(patch), F.when(F.col("layer") == "patch", 1).otherwise(0)
        ),
        "patch_layer": lambda: layers.patch_layer(dense, patch),
        "diff_layers": lambda: layers.diff_layers(dense, dense.withColumn("x", F.col("x") + (F.col("frame") % 7 == 0).cast("int"))),
        "keep_complete_frames": lambda: layers.keep_complete_frames(manual, src.declared_pair(manual)),
        "quality_issues": lambda: quality.quality_issues(manual, required=["0", "1"]),
        "neighbour_frames": lambda: asof.neighbour_frames(manual, pred.select(*STEP), block=short),
        "nudge_labels": lambda: asof.nudge_labels(manual, pred, previous),
        "select_across_videos": lambda: select.select_across_videos(repaired, n=200, n_videos=1500),
        "complete_frames": lambda: repair.complete_frames(
            repaired.where("label = '0' AND frame % 3 = 0").select(*STEP, "x", "y"), pred, step, block=short
        ),
        "lowpass": lambda: smooth.lowpass_intervals(
            lines, line_videos.select("video", F.lit("0").alias("label"), F.lit(50).cast("long").alias("start"), (F.col("n_frames") - 50).alias("end")),
            period=21, block=long,
        ),
        "knn": lambda: vectors.knn(features, features.where("id % 4 = 0"), 10),
        "farthest_point_sample": lambda: vectors.farthest_point_sample(features, 200, return_radii=True),
    }
    times = {}
    for name, build in queries.items():
        if only and name not in only:
            continue
        best = None
        for _ in range(repeats):
            t = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "trajectory_operators_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").split("sf")[-1],
                "setup": round(setup, 2),
                "points": {"events": pred.count(), "lines": lines.count()},
            }
        )
    )


if __name__ == "__main__":
    main()
