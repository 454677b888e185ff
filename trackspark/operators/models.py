"""Figures about trained models, traces and images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.schema import TRACE


def best_snapshots(
    iterations: DataFrame, evaluation: DataFrame, snapshots: DataFrame, *, prefer_best: bool = False
) -> DataFrame:
    """Best snapshot, its test error and its index, per model iteration.

    ``iterations(iteration)``, ``evaluation(iteration, row_no, step, test_error)``,
    ``snapshots(iteration, snapshot, step)``. The step of lowest test error
    wins, the first of equals. Without an evaluation it is the latest snapshot
    and the error is -1. With ``prefer_best`` a snapshot named *best* wins.
    """
    judged = evaluation.groupBy("iteration").agg(
        F.min_by("step", F.struct("test_error", "row_no")).alias("_step"),
        F.min("test_error").alias("_err"),
    )
    named = F.contains(F.col("snapshot"), F.lit("best"))
    entry = F.struct(named.alias("named"), F.col("step").alias("step"), F.col("snapshot").alias("snapshot"))
    listed = snapshots.groupBy("iteration").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    rows = iterations.select("iteration").join(judged, "iteration", "left").join(listed, "iteration", "left")
    plain = F.filter("_all", lambda s: ~s["named"])
    best = F.filter("_all", lambda s: s["named"])
    latest = F.try_element_at(F.transform(plain, lambda s: s["step"]), F.lit(-1))
    step = F.coalesce("_step", latest)
    if prefer_best:
        step = F.coalesce(F.try_element_at(F.transform(best, lambda s: s["step"]), F.lit(-1)), step)
    steps = F.transform("_all", lambda s: s["step"])
    out = rows.withColumn("best_step", step)
    if prefer_best:
        named_at = F.array_position(F.transform("_all", lambda s: s["named"]), F.lit(True))
        at = F.when(named_at > 0, named_at).otherwise(F.array_position(steps, F.col("best_step")))
    else:
        at = F.array_position(steps, F.col("best_step"))
    return out.select(
        "iteration",
        "best_step",
        F.coalesce("_err", F.lit(-1.0)).alias("test_error"),
        F.when(at > 0, at - 1).alias("best_index"),
    )


def latest_trained_iteration(iterations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: the highest iteration with a snapshot, or -1."""
    trained = iterations.select("iteration").join(snapshots.select("iteration").distinct(), "iteration", "left_semi")
    return trained.agg(F.coalesce(F.max("iteration"), F.lit(-1)).alias("latest_trained"))


def next_layer_name(iterations: DataFrame, snapshots: DataFrame, current: int) -> DataFrame:
    """One row: ``iteration-<N+1>`` if iteration N is trained, else ``iteration-<N>``."""
    trained = iterations.where(F.col("iteration") == current).join(
        snapshots.select("iteration").distinct(), "iteration", "left_semi"
    )
    n = F.when(F.count(F.lit(1)) > 0, current + 1).otherwise(current)
    return trained.agg(F.concat(F.lit("iteration-"), n.cast("string")).alias("layer"))


def trace_extent(points: DataFrame, keys: Sequence[str] = TRACE) -> DataFrame:
    """Axis limits of each label: 5 % padding, or half a pixel around a flat trace."""
    span = points.groupBy(*keys).agg(
        *[f(c).alias(f"_{c}{n}") for c in ("x", "y") for f, n in ((F.min, 0), (F.max, 1))]
    )

    def limits(c: str):
        lo, hi = F.col(f"_{c}0"), F.col(f"_{c}1")
        pad = F.when(hi == lo, F.greatest(F.abs(lo) * 0.05, F.lit(0.5))).otherwise((hi - lo) * 0.05)
        return [(lo - pad).alias(f"{c}_lo"), (hi + pad).alias(f"{c}_hi")]

    return span.select(*keys, *limits("x"), *limits("y"))


def full_extent(points: DataFrame, keys: Sequence[str] = ("video",)) -> DataFrame:
    """Axis limits over all layers: 0.9 of the minimum to 1.1 of the maximum."""
    return points.groupBy(*keys).agg(
        *[(F.min(c) * 0.9).alias(f"{c}_lo") for c in ("x", "y")],
        *[(F.max(c) * 1.1).alias(f"{c}_hi") for c in ("x", "y")],
    )


def contrast_params(
    pixels: DataFrame,
    *,
    clip_range: tuple[float, float] = (1.0, 4.0),
    gamma_range: tuple[float, float] = (1.0, 2.0),
    spread_target: float = 75.0,
    dark_target: float = 25.0,
) -> DataFrame:
    """Contrast settings of each frame from its intensity percentiles.

    ``pixels(video, frame, intensity)``; one frame is one image. Equal
    intensities are counted first, so a group holds its distinct values only.
    """
    counts = pixels.groupBy("video", "frame", "intensity").agg(F.count(F.lit(1)).alias("_c"))
    at = lambda p: F.percentile("intensity", F.lit(p), F.col("_c"))
    shape = counts.groupBy("video", "frame").agg(
        at(0.05).alias("p5"), at(0.5).alias("p50"), at(0.95).alias("p95")
    )
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    flat = unit((spread_target - (F.col("p95") - F.col("p5"))) / spread_target)
    dark = unit((dark_target - F.col("p50")) / dark_target)
    scale = lambda bounds, share: F.lit(bounds[0]) + (bounds[1] - bounds[0]) * share
    return shape.select(
        "video", "frame", "p5", "p50", "p95",
        scale(clip_range, flat).alias("clip"), scale(gamma_range, dark).alias("gamma"),
    )
