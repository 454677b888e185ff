"""Look-ups along the frame axis, frame selections and iteration pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.blocks import BLOCK, scan, spread
from trackspark.functions.geometry import distance
from trackspark.functions.names import label_from_bodypart
from trackspark.schema import TRACE


def neighbour_frames(
    frames: DataFrame, probes: DataFrame, *, keys: Sequence[str] = TRACE, block: int | None = BLOCK
) -> DataFrame:
    """Nearest, previous and next annotated frame of each probe frame.

    ``frames`` and ``probes`` carry the keys and ``frame``; pass ``("video",)``
    as keys for frames under any label or frames of interest. Previous and next
    lie strictly before and after and default to the probe itself. Of two
    equally near frames the later one counts.
    """
    keys = list(keys)
    marks = frames.select(*keys, "frame", F.lit(True).alias("_f"), F.lit(False).alias("_p"))
    marks = marks.unionByName(probes.select(*keys, "frame", F.lit(False).alias("_f"), F.lit(True).alias("_p")))
    axis = marks.groupBy(*keys, "frame").agg(F.bool_or("_f").alias("_f"), F.bool_or("_p").alias("_p"))
    at = F.when(F.col("_f"), F.col("frame"))
    seen = scan(axis, keys, {"_b": ("prev", at), "_a": ("next", at)}, block=block).where("_p")
    after_wins = F.col("_a") - F.col("frame") <= F.col("frame") - F.col("_b")
    nearest = F.when(F.col("_f"), F.col("frame")).otherwise(
        F.coalesce(F.when(after_wins, F.col("_a")), F.col("_b"), F.col("_a"))
    )
    return seen.select(
        *keys,
        "frame",
        nearest.alias("nearest"),
        F.coalesce("_b", "frame").alias("previous"),
        F.coalesce("_a", "frame").alias("next"),
    )


def common_nearest_frame(points: DataFrame, probes: DataFrame, **params) -> DataFrame:
    """The nearest annotated frame of each probe (video, frame), where all labels agree on it."""
    labels = points.select("video", "label").distinct()
    near = neighbour_frames(points, probes.join(labels, "video"), **params)
    return (
        near.groupBy("video", "frame")
        .agg(F.min("nearest").alias("nearest"), F.max("nearest").alias("_max"))
        .where(F.col("nearest") == F.col("_max"))
        .drop("_max")
    )


def select_frames(predictions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Predictions at listed frames, in list order and with repeats.

    ``wanted``: (video, pos, frame, n_frames). A frame outside its video raises.
    """
    outside = (F.col("frame") < 0) | (F.col("frame") >= F.col("n_frames"))
    checked = wanted.withColumn(
        "frame",
        F.when(
            outside, F.raise_error(F.concat(F.lit("frame outside the video: "), F.col("frame"))).cast("long")
        ).otherwise(F.col("frame")),
    )
    return checked.select("video", "pos", "frame").join(predictions, ["video", "frame"], "left")


def select_range(
    predictions: DataFrame, videos: DataFrame, start: int, end: int, *, step: int = 1
) -> DataFrame:
    """Predictions at ``start .. min(end, last frame)`` in steps, per video."""
    if start < 0 or step < 1 or end < start:
        raise ValueError(f"no frames in {start}..{end} by {step}")
    last = F.least(F.lit(end), F.col("n_frames") - 1)
    chosen = videos.select("video", "n_frames").withColumn(
        "_last",
        F.when(last < start, F.raise_error(F.lit("the range starts after the last frame")).cast("long")).otherwise(last),
    )
    # One row per video and thousand steps before single frames.
    stride = 1024 * step
    coarse = chosen.withColumn("_from", F.explode(F.sequence(F.lit(start), F.col("_last"), F.lit(stride))))
    fine = spread(coarse, "video", "_from").withColumn(
        "frame",
        F.explode(F.sequence("_from", F.least(F.col("_from") + stride - 1, F.col("_last")), F.lit(step))),
    )
    wanted = fine.select(
        "video", ((F.col("frame") - start) / step).cast("long").alias("pos"), F.col("frame").cast("long").alias("frame"), "n_frames"
    )
    return select_frames(predictions, wanted)


def to_annotation(predictions: DataFrame, source_declared: DataFrame | None = None, *, layer: str = "predicted") -> tuple[DataFrame, DataFrame]:
    """Predictions as a layer: points, and declared labels joined with those of a source layer.

    ``predictions`` carries ``bodypart``; likelihood is dropped.
    """
    named = label_from_bodypart(predictions, file="video", bodypart="bodypart")
    points = named.where(F.col("x").isNotNull() | F.col("y").isNotNull()).select(
        "video", F.lit(layer).alias("layer"), "label", "frame", "x", "y"
    )
    labels = named.select("video", "label")
    if source_declared is not None:
        labels = labels.unionByName(source_declared.select("video", "label"))
    return points, labels.distinct().select("video", F.lit(layer).alias("layer"), "label")


def pair_iterations(labels: DataFrame, latest: DataFrame, previous: DataFrame) -> DataFrame:
    """Labelled points with what the latest and the previous model say there."""
    key = [*TRACE, "frame"]
    now = latest.select(*key, F.col("x").alias("now_x"), F.col("y").alias("now_y"), F.col("likelihood").alias("now_lik"))
    was = previous.select(*key, F.col("x").alias("was_x"), F.col("y").alias("was_y"))
    return labels.select(*key, "x", "y").join(now, key, "left").join(was, key, "left")


def nudge_labels(
    labels: DataFrame,
    latest: DataFrame,
    previous: DataFrame,
    *,
    high: float = 0.9,
    converge_tol: float = 1.0,
    nudge_min: float = 1.0,
    nudge_max: float = 8.0,
    alpha: float = 1.0,
) -> DataFrame:
    """Move labels towards a prediction that two iterations agree on.

    ``status``: ``unconverged``, ``on_target`` (closer than ``nudge_min``),
    ``flagged`` (farther than ``nudge_max``, not moved) or ``nudged``.
    """
    rows = pair_iterations(labels, latest, previous)
    shift = distance("now_x", "now_y", "was_x", "was_y")
    settled = F.coalesce((F.col("now_lik") >= high) & (shift <= converge_tol), F.lit(False))
    d = distance("x", "y", "now_x", "now_y")
    status = (
        F.when(~settled, "unconverged")
        .when(d < nudge_min, "on_target")
        .when(d > nudge_max, "flagged")
        .otherwise("nudged")
    )
    rows = rows.withColumn("status", status)
    moved = lambda c: F.when(
        F.col("status") == "nudged", F.col(c) + alpha * (F.col(f"now_{c}") - F.col(c))
    ).otherwise(F.col(c))
    return rows.select(*TRACE, "frame", moved("x").alias("x"), moved("y").alias("y"), "status")


def nudge_tally(nudged: DataFrame) -> DataFrame:
    return nudged.groupBy("video", "status").agg(F.count(F.lit(1)).alias("n"))
