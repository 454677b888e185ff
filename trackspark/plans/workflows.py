"""Whole workflows made of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.blocks import BLOCK
from trackspark.functions.names import is_dense
from trackspark.operators.asof import common_nearest_frame
from trackspark.operators.detect import attach_min_likelihood, disagreement_blips, find_gaps, points_in_runs
from trackspark.operators.layers import patch_layer
from trackspark.operators.repair import complete_frames, interpolate_runs, propagate, repair_gaps
from trackspark.operators.select import error_frames, sample_gaps, select_across_videos, union_sources
from trackspark.operators.vectors import review_selection
from trackspark.schema import TRACE
from trackspark.session import settle

STEP = [*TRACE, "frame"]


def deblip_source(layers: DataFrame, layer: str) -> DataFrame:
    """The points of a dense layer; sparse layers and own results are refused by being empty."""
    own = F.startswith(F.col("layer"), F.lit("deblip")) | F.startswith(F.col("layer"), F.lit("blips"))
    return layers.where((F.col("layer") == layer) & is_dense("layer") & ~own)


def deblip(
    layers: DataFrame,
    layer: str,
    flow_positions: DataFrame,
    flow: DataFrame,
    *,
    block: int | None = BLOCK,
    **blip_params,
) -> dict[str, DataFrame]:
    """Find blips of a dense layer, interpolate them, and give both result layers.

    ``blips``: the runs; ``corrections``: the new points; ``blips_layer``: what
    the model said there; ``deblip_layer``: the corrected trace.
    """
    source = deblip_source(layers, layer)
    found = disagreement_blips(source.select(*STEP, "x", "y"), flow_positions, block=block, **blip_params)
    # Few runs, read by every result.
    blips = settle(found)
    corrections = interpolate_runs(blips, flow, block=block)
    return {
        "blips": blips,
        "corrections": corrections,
        "blips_layer": points_in_runs(source, blips).withColumn("layer", F.lit(f"blips_{layer}")),
        "deblip_layer": patch_layer(source, corrections, f"deblip_{layer}"),
    }


def refine_cohort(
    predictions: DataFrame,
    flow: DataFrame,
    *,
    flow_positions: DataFrame | None = None,
    gaps_per_video: int | None = None,
    n: int = 20,
    n_videos: int | None = None,
    max_gap: int = 45,
    block: int | None = BLOCK,
) -> DataFrame:
    """Find, repair, choose and complete training frames over all videos.

    The budget is shared by ``n_videos``, by default all videos of ``predictions``, repaired or not.
    """
    if n_videos is None:
        n_videos = predictions.select("video").distinct().count()
    gaps = find_gaps(predictions, max_gap=max_gap, block=block).select(*TRACE, "start", "end", "ax0", "ay0", "ax1", "ay1")
    if flow_positions is not None:
        blips = attach_min_likelihood(disagreement_blips(predictions, flow_positions, block=block), predictions)
        gaps = gaps.unionByName(blips.where(F.col("reason").isNull()).select(*gaps.columns))
    if gaps_per_video is not None:
        gaps = sample_gaps(settle(gaps), gaps_per_video, block=block)
    # A frame may lie in a gap and in a blip; the better repair counts.
    best = F.min_by(F.struct("x", "y", "disagreement"), "disagreement").alias("_r")
    repaired = repair_gaps(gaps, flow, block=block).groupBy(*STEP).agg(best).select(*STEP, "_r.*")
    chosen = select_across_videos(settle(repaired), n=n, n_videos=n_videos)
    return complete_frames(chosen.select(*STEP, "x", "y"), predictions, flow, max_gap=max_gap, block=block)


def curate_frames(
    labeled: DataFrame,
    predictions: DataFrame,
    flow: DataFrame,
    features: DataFrame,
    *,
    threshold: float = 0.6,
    block: int | None = BLOCK,
) -> DataFrame:
    """Diverse frames out of labelled and erroneous ones.

    ``labeled(video, image)``; ``features(video, frame, image, id, embedding)``
    give one embedding per candidate. Fewer than eight candidates give nothing.
    """
    errors = error_frames(predictions, flow, threshold=threshold, block=block).select("video", "frame").distinct()
    errors = errors.select("video", F.lit(None).cast("string").alias("image"), "frame")
    known = labeled.select("video", "image", F.lit(None).cast("long").alias("frame"))
    pool = settle(union_sources(known, errors))
    by_frame = pool.where(F.col("frame").isNotNull()).select("video", "frame")
    by_image = pool.where(F.col("frame").isNull()).select("video", "image")
    have = features.join(by_frame, ["video", "frame"], "left_semi").unionByName(
        features.join(by_image, ["video", "image"], "left_semi")
    ).dropDuplicates(["id"])
    have = settle(have)
    return have.join(review_selection(have.select("id", "embedding")), "id", "left_semi").select("video", "image", "frame", "id")


def predict_from_nearest(
    points: DataFrame, probes: DataFrame, flow: DataFrame, *, mode: str = "full", block: int | None = BLOCK
) -> DataFrame:
    """Follow the flow to each probe frame (video, frame) from the nearest labelled one.

    Only where the nearest labelled frame is the same for all labels of the
    video. ``full`` gives all frames on the way, ``direct`` the probe frame.
    """
    start = common_nearest_frame(points, probes, block=block)
    anchors = points.select(*STEP, "x", "y").join(
        start.select("video", F.col("nearest").alias("frame"), F.col("frame").alias("to")), ["video", "frame"]
    )
    return propagate(anchors, flow, mode=mode, block=block)
