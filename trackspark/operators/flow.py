"""Optical-flow landings and residuals from a table of per-step displacements.

``flow`` holds, per (video, label, frame), the displacement into the frame
from the one before (``_fwd``) and from the one after (``_rev``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.blocks import (
    BLK, BLOCK, OWN, halo_window, layout_of, own_rows, plain_rows, with_halo,
)
from trackspark.functions.geometry import distance
from trackspark.schema import TRACE

STEP = [*TRACE, "frame"]


def complete_points(positions: DataFrame) -> DataFrame:
    return positions.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def flow_layer(positions: DataFrame, flow: DataFrame) -> DataFrame:
    """Where the flow lands from the model's point one frame earlier.

    A frame is empty if any label of the video lacks a point one frame
    earlier; so is the first frame.
    """
    n_labels = positions.select("video", "label").distinct().groupBy("video").agg(
        F.count(F.lit(1)).alias("_labels")
    )
    # All labels of one frame: at most one row per label of the video.
    frames = complete_points(positions).groupBy("video", "frame").agg(
        F.collect_list(F.struct("label", "x", "y")).alias("_all")
    )
    seeds = (
        frames.join(n_labels, "video")
        .where(F.size("_all") == F.col("_labels"))
        .select("video", (F.col("frame") + 1).alias("frame"), F.explode("_all").alias("_p"))
        .select("video", "_p.label", "frame", F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"))
    )
    steps = flow.where(F.col("dx_fwd").isNotNull() & F.col("dy_fwd").isNotNull())
    return seeds.join(steps, STEP).select(
        *STEP, (F.col("_x") + F.col("dx_fwd")).alias("x"), (F.col("_y") + F.col("dy_fwd")).alias("y")
    )


def flow_residual(
    positions: DataFrame, flow: DataFrame, *, frames: DataFrame | None = None, block: int | None = BLOCK
) -> DataFrame:
    """How far each point is from what the flow says on both sides.

    Needs points on the frame and both neighbours. ``frames`` (video, frame)
    restricts the work to those frames and their neighbours.
    """
    stored = layout_of(positions)
    in_place = frames is None and stored is not None and layout_of(flow) is not None and stored == (block, max(1, stored[1]))
    step = [*STEP, *([BLK, OWN] if in_place else [])]
    if not in_place:
        positions, flow = plain_rows(positions), plain_rows(flow)
    rows = complete_points(positions).select(*step, "x", "y")
    if frames is not None:
        wanted = frames.select("video", "frame").distinct()
        near = wanted.withColumn("frame", F.explode(F.sequence(F.col("frame") - 1, F.col("frame") + 1)))
        rows = rows.join(near.distinct(), ["video", "frame"], "left_semi").select(*STEP, "x", "y")
    rows = rows.join(flow.drop(OWN) if in_place else flow, [c for c in step if c != OWN], "left")
    rows = rows if in_place else with_halo(rows, before=1, after=1, block=block)
    w = halo_window(TRACE, block=block)
    here = F.struct("frame", "x", "y")
    rows = own_rows(rows.withColumns({"_b": F.lag(here).over(w), "_a": F.lead(here).over(w)}))
    adjacent = (F.col("_b.frame") == F.col("frame") - 1) & (F.col("_a.frame") == F.col("frame") + 1)
    rows = rows.where(adjacent)
    if frames is not None:
        rows = rows.join(wanted, ["video", "frame"], "left_semi")
    rows = rows.select(
        *STEP, "x", "y",
        (F.col("_b.x") + F.col("dx_fwd")).alias("fx"),
        (F.col("_b.y") + F.col("dy_fwd")).alias("fy"),
        (F.col("_a.x") + F.col("dx_rev")).alias("rx"),
        (F.col("_a.y") + F.col("dy_rev")).alias("ry"),
    )
    return rows.select(
        *STEP,
        (F.lit(0.5) * (distance("x", "y", "fx", "fy") + distance("x", "y", "rx", "ry"))).alias("residual"),
        (F.lit(0.5) * (F.col("fx") + F.col("rx"))).alias("est_x"),
        (F.lit(0.5) * (F.col("fy") + F.col("ry"))).alias("est_y"),
        distance("fx", "fy", "rx", "ry").alias("agreement"),
    ).where(F.col("residual").isNotNull())


def paired_flow_layer(layers: DataFrame, layer: str, videos: DataFrame, flow: DataFrame) -> DataFrame:
    """The stored flow layer that belongs to a prediction layer.

    ``dlc_<name>`` pairs with ``lk_<name>``. Frames outside the video are
    ignored; videos without the stored layer get it computed.
    """
    stored_name = "lk_" + layer.removeprefix("dlc_")
    stored = (
        layers.where(F.col("layer") == stored_name)
        .join(videos.select("video", "n_frames"), "video")
        .where(F.col("frame").between(0, F.col("n_frames") - 1))
        .select(*STEP, "x", "y")
    )
    have = layers.where(F.col("layer") == stored_name).select("video").distinct()
    todo = layers.where(F.col("layer") == layer).join(have, "video", "left_anti")
    return stored.unionByName(flow_layer(todo.select(*STEP, "x", "y"), flow))
