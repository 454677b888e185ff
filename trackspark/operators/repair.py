"""Filling stretches by blending forward and reverse tracks between anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.blocks import (
    BLK, BLOCK, block_of, scan, spread, top_per_group,
)
from trackspark.functions.geometry import blend, distance, forward_weight
from trackspark.functions.ranks import IN_ORDER, percentiles
from trackspark.operators.detect import HIGH, MAX_GAP, confident, nearest_confident
from trackspark.operators.layers import patch_layer
from trackspark.schema import TRACE
from trackspark.session import settle

STEP = [*TRACE, "frame"]
RUN = [*TRACE, "start", "end"]
ANCHORS = ["ax0", "ay0", "ax1", "ay1"]
# Fixed value: default limit on how far forward and reverse tracks may differ.
MAX_DISAGREEMENT = 5.0


def run_frames(runs: DataFrame, *, block: int | None = BLOCK) -> DataFrame:
    """All frames ``start .. end`` of each run; long runs grow block by block."""
    if block is None:
        return spread(runs, *RUN).withColumn("frame", F.explode(F.sequence("start", "end")))
    cut = runs.withColumn(
        BLK, F.explode(F.sequence(block_of("start", block), block_of("end", block)))
    )
    lo = F.greatest(F.col("start"), F.col(BLK) * block)
    hi = F.least(F.col("end"), F.col(BLK) * block + (block - 1))
    return spread(cut, *RUN, BLK).withColumn("frame", F.explode(F.sequence(lo, hi))).drop(BLK)


def with_run_figures(frames: DataFrame, figures: dict[str, Column], *, block: int | None = BLOCK) -> DataFrame:
    """Add aggregates over all frames of a run to each of its frames.

    Runs longer than a block are aggregated apart and joined block by block.
    """
    if block is None:
        whole = Window.partitionBy(*RUN)
        return frames.withColumns({name: figure.over(whole) for name, figure in figures.items()})
    totals = [figure.alias(name) for name, figure in figures.items()]
    per_run = frames.groupBy(*RUN).agg(*totals).withColumn(
        BLK, F.explode(F.sequence(block_of("start", block), block_of("end", block)))
    )
    return frames.withColumn(BLK, block_of("frame", block)).join(per_run, [*RUN, BLK]).drop(BLK)


def tracked_paths(runs: DataFrame, flow: DataFrame, *, block: int | None = BLOCK) -> DataFrame:
    """Forward path from the first anchor and reverse path from the last one.

    ``runs`` are anchored at ``start`` and ``end`` themselves. ``n_missing``
    marks the frames whose step the flow table lacks.
    """
    rows = run_frames(runs.select(*RUN, *ANCHORS), block=block).join(
        flow.select(*STEP, "dx_fwd", "dy_fwd", "dx_rev", "dy_rev"), STEP, "left"
    )
    ahead, back = F.col("frame") > F.col("start"), F.col("frame") < F.col("end")
    hole = (ahead & (F.col("dx_fwd").isNull() | F.col("dy_fwd").isNull())) | (
        back & (F.col("dx_rev").isNull() | F.col("dy_rev").isNull())
    )
    rows = rows.withColumn("n_missing", F.when(hole, 1).otherwise(0))
    step = lambda on, c: F.when(on, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    rows = scan(
        rows,
        RUN,
        {
            "_fx": ("sum", step(ahead, "dx_fwd")),
            "_fy": ("sum", step(ahead, "dy_fwd")),
            "_rx": ("rsum", step(back, "dx_rev")),
            "_ry": ("rsum", step(back, "dy_rev")),
        },
        block=block,
    )
    return rows.select(
        *RUN, "frame", *ANCHORS, "n_missing",
        (F.col("ax0") + F.col("_fx")).alias("fwd_x"),
        (F.col("ay0") + F.col("_fy")).alias("fwd_y"),
        (F.col("ax1") + F.col("_rx")).alias("rev_x"),
        (F.col("ay1") + F.col("_ry")).alias("rev_y"),
    )


def blend_paths(paths: DataFrame) -> DataFrame:
    """Blend both paths: all forward at ``start``, all reverse at ``end``."""
    w = forward_weight("frame", "start", "end")
    return paths.withColumns(
        {
            "x": blend("fwd_x", "rev_x", w),
            "y": blend("fwd_y", "rev_y", w),
            "disagreement": distance("fwd_x", "fwd_y", "rev_x", "rev_y"),
        }
    )


def blend_tracks(runs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Blend paths an external tracker gave, one ``run_id`` per run."""
    bounds = runs.select("run_id", "start", "end", *ANCHORS)
    return blend_paths(tracks.join(bounds, "run_id").withColumn("n_missing", F.lit(0)))


def endpoint_drift(paths: DataFrame, limit: float = 1e-3) -> DataFrame:
    """Blended run ends that miss their anchor by more than ``limit``."""
    at_start = F.when(F.col("frame") == F.col("start"), distance("x", "y", "ax0", "ay0"))
    at_end = F.when(F.col("frame") == F.col("end"), distance("x", "y", "ax1", "ay1"))
    drift = F.coalesce(at_start, at_end)
    return paths.withColumn("drift", drift).where(F.col("drift") > limit).select(*RUN, "frame", "drift")


def rstc_blend(
    runs: DataFrame,
    flow: DataFrame,
    *,
    target_frame: str | None = None,
    return_paths: bool = False,
    block: int | None = BLOCK,
) -> DataFrame:
    """Blended path of every anchored run, ends included.

    Runs with a missing flow step are refused as a whole. ``target_frame``
    names a column of ``runs`` with the one frame to return.
    """
    paths = blend_paths(tracked_paths(runs.where(F.col("end") > F.col("start")), flow, block=block))
    paths = with_run_figures(paths, {"_holes": F.sum("n_missing")}, block=block)
    paths = paths.where(F.col("_holes") == 0).drop("_holes", "n_missing")
    if target_frame is not None:
        targets = runs.select(*RUN, F.col(target_frame).alias("frame")).distinct()
        paths = paths.join(targets, [*RUN, "frame"], "left_semi")
    kept = [*RUN, "frame", "x", "y"]
    if return_paths:
        kept += ["fwd_x", "fwd_y", "rev_x", "rev_y", "disagreement"]
    return paths.select(*kept)


def _anchored(runs: DataFrame) -> DataFrame:
    """Widen runs of bad frames to the good frame on each side."""
    return runs.withColumns({"start": F.col("start") - 1, "end": F.col("end") + 1})


def _interior(paths: DataFrame) -> DataFrame:
    inside = paths.where((F.col("frame") > F.col("start")) & (F.col("frame") < F.col("end")))
    return inside.withColumns({"start": F.col("start") + 1, "end": F.col("end") - 1})


def interpolate_runs(blips: DataFrame, flow: DataFrame, *, block: int | None = BLOCK) -> DataFrame:
    """Replacement points for the frames of each blip."""
    return _interior(rstc_blend(_anchored(blips), flow, block=block)).select(*STEP, "x", "y")


def _judged(gaps: DataFrame, flow: DataFrame, max_disagreement: float, block: int | None) -> DataFrame:
    paths = blend_paths(tracked_paths(_anchored(gaps), flow, block=block))
    inside = (F.col("frame") > F.col("start")) & (F.col("frame") < F.col("end"))
    # Every gap has at least one frame inside.
    worst = F.max(F.when(inside, F.col("disagreement")))
    rows = with_run_figures(paths, {"_holes": F.sum("n_missing"), "worst": worst}, block=block)
    reason = F.when(F.col("_holes") > 0, "flow_missing").when(F.col("worst") > max_disagreement, "untrusted")
    return rows.withColumn("reason", reason).drop("_holes")


def repair_gaps(
    gaps: DataFrame, flow: DataFrame, *, max_disagreement: float = MAX_DISAGREEMENT, block: int | None = BLOCK
) -> DataFrame:
    """All frames of the gaps whose tracks agree everywhere, with their disagreement."""
    rows = _judged(gaps, flow, max_disagreement, block).where(F.col("reason").isNull())
    return _interior(rows).select(*RUN, "frame", "x", "y", "disagreement")


def gap_verdicts(
    gaps: DataFrame, flow: DataFrame, *, max_disagreement: float = MAX_DISAGREEMENT, block: int | None = BLOCK
) -> DataFrame:
    """The worst disagreement of each gap, and why it is not repaired.

    ``reason`` is NULL for a trusted gap, else ``flow_missing`` or ``untrusted``.
    """
    rows = _judged(gaps, flow, max_disagreement, block).where(F.col("frame") == F.col("start"))
    return rows.select(
        *TRACE, (F.col("start") + 1).alias("start"), (F.col("end") - 1).alias("end"), "worst", "reason"
    )


def repair_report(
    frames: DataFrame, keys: tuple[str, ...] = ("video",), *, trusted_at: float = 2.0, in_order: int = IN_ORDER
) -> DataFrame:
    """Distribution of the disagreement over repaired frames."""
    d = F.col("disagreement")
    share = lambda px: F.avg(F.when(d <= px, 1.0).otherwise(0.0)).alias(f"within_{px}")
    frames = settle(frames.select(*keys, "disagreement"))
    shape = percentiles(frames, keys, "disagreement", {"median": 0.5, "p90": 0.9}, in_order=in_order)
    counts = frames.groupBy(*keys).agg(
        share(1), share(2), share(5), F.count_if(d <= trusted_at).alias("n_trusted")
    )
    return shape.join(counts, list(keys)).select(
        *keys, F.col("n").alias("n_frames"), "median", "p90", F.col("v_max").alias("max"),
        "within_1", "within_2", "within_5", "n_trusted",
    )


def interpolate_intervals(
    current: DataFrame,
    overlay: DataFrame,
    intervals: DataFrame,
    flow: DataFrame,
    name: str = "iteration-0",
    *,
    block: int | None = BLOCK,
) -> DataFrame:
    """Blend between the overlay points at both ends of each interval, over the current layer.

    Both ends are written too. Intervals without both anchors change nothing.
    """
    at = lambda which, a, b: overlay.select(
        *TRACE, F.col("frame").alias(which), F.col("x").alias(a), F.col("y").alias(b)
    )
    runs = (
        intervals.select(*RUN).distinct()
        .join(at("start", "ax0", "ay0"), [*TRACE, "start"])
        .join(at("end", "ax1", "ay1"), [*TRACE, "end"])
    )
    # Intervals of one label may overlap; the one that starts last wins.
    new = rstc_blend(runs, flow, block=block).groupBy(*STEP).agg(
        F.max_by(F.struct("x", "y"), F.struct("start", "end")).alias("_xy")
    )
    return patch_layer(current, new.select(*STEP, "_xy.x", "_xy.y"), name)


def propagate(
    anchors: DataFrame, flow: DataFrame, *, mode: str = "full", block: int | None = BLOCK
) -> DataFrame:
    """Follow the flow from one anchor per row: ``(video, label, frame, to, x, y)``.

    Forward when ``to`` lies after the anchor frame, else backward. ``full``
    gives every frame on the way, ``direct`` the last one. Refused where a
    step is missing.
    """
    if mode not in ("full", "direct"):
        raise ValueError(f"unknown mode {mode!r}")
    lo, hi = F.least("frame", "to"), F.greatest("frame", "to")
    runs = anchors.select(
        *TRACE, lo.alias("start"), hi.alias("end"), (F.col("to") >= F.col("frame")).alias("_fwd"),
        F.col("x").alias("ax0"), F.col("y").alias("ay0"), F.col("x").alias("ax1"), F.col("y").alias("ay1"),
    )
    rows = run_frames(runs, block=block).join(
        flow.select(*STEP, "dx_fwd", "dy_fwd", "dx_rev", "dy_rev"), STEP, "left"
    )
    moving = F.when(F.col("_fwd"), F.col("frame") > F.col("start")).otherwise(F.col("frame") < F.col("end"))
    dx = F.when(F.col("_fwd"), F.col("dx_fwd")).otherwise(F.col("dx_rev"))
    dy = F.when(F.col("_fwd"), F.col("dy_fwd")).otherwise(F.col("dy_rev"))
    rows = rows.withColumns(
        {
            "_dx": F.when(moving, F.coalesce(dx, F.lit(0.0))).otherwise(0.0),
            "_dy": F.when(moving, F.coalesce(dy, F.lit(0.0))).otherwise(0.0),
            "_hole": F.when(moving & (dx.isNull() | dy.isNull()), 1).otherwise(0),
        }
    )
    keys = [*RUN, "_fwd"]
    rows = scan(
        rows,
        keys,
        {
            "_ux": ("sum", F.col("_dx")), "_uy": ("sum", F.col("_dy")),
            "_vx": ("rsum", F.col("_dx")), "_vy": ("rsum", F.col("_dy")),
            "_h": ("sum", F.col("_hole")), "_g": ("rsum", F.col("_hole")),
        },
        block=block,
    )
    # Sums from both sides make up the number of holes of the whole run.
    rows = rows.where(F.col("_h") + F.col("_g") - F.col("_hole") == 0)
    x = F.col("ax0") + F.when(F.col("_fwd"), F.col("_ux")).otherwise(F.col("_vx"))
    y = F.col("ay0") + F.when(F.col("_fwd"), F.col("_uy")).otherwise(F.col("_vy"))
    if mode == "direct":
        rows = rows.where(F.col("frame") == F.when(F.col("_fwd"), F.col("end")).otherwise(F.col("start")))
    return rows.select(*STEP, x.alias("x"), y.alias("y"))


def interpolate_between_labels(
    points: DataFrame,
    flow: DataFrame,
    *,
    mode: str = "all",
    label: str | None = None,
    frame: int | None = None,
    name: str = "buffer",
    block: int | None = BLOCK,
) -> DataFrame:
    """Blend between every two neighbouring labelled frames.

    ``all`` labels, the ``current`` one, or ``minimal``: only between the two
    labelled frames before and the two at or after ``frame``.
    """
    if mode not in ("all", "current", "minimal"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode != "all":
        points = points.where(F.col("label") == label)
    pts = points.select(*STEP, "x", "y")
    if mode == "minimal":
        before = top_per_group(
            pts.where(F.col("frame") < frame), TRACE, [F.desc("frame")], 2, salt_on=["frame"]
        )
        after = top_per_group(pts.where(F.col("frame") >= frame), TRACE, [F.col("frame")], 2, salt_on=["frame"])
        pts = before.unionByName(after).drop("rank")
    here = F.struct("frame", "x", "y")
    linked = scan(pts, TRACE, {"_n": ("next", here), "_b": ("prev", F.col("frame"))}, block=block)
    runs = linked.where(F.col("_n").isNotNull()).select(
        *TRACE, F.col("frame").alias("start"), F.col("_n.frame").alias("end"),
        F.col("x").alias("ax0"), F.col("y").alias("ay0"), F.col("_n.x").alias("ax1"), F.col("_n.y").alias("ay1"),
    )
    inner = rstc_blend(runs, flow, block=block).where(F.col("frame") < F.col("end")).select(*STEP, "x", "y")
    # The last labelled frame ends the last blend and equals its own point.
    last = linked.where(F.col("_n").isNull() & F.col("_b").isNotNull()).select(*STEP, "x", "y")
    done = inner.unionByName(last)
    return done.select("video", F.lit(name).alias("layer"), "label", "frame", "x", "y")


# Frames that are looked at together around a selected one.
NEAR = 256


def complete_frames(
    selected: DataFrame,
    predictions: DataFrame,
    flow: DataFrame,
    *,
    high: float = HIGH,
    max_gap: int = MAX_GAP,
    max_disagreement: float = MAX_DISAGREEMENT,
    block: int | None = BLOCK,
) -> DataFrame:
    """Give every selected frame all labels of its video, or drop the frame.

    A missing label is taken from a confident prediction, else from a blend
    between the nearest confident frames. ``source`` tells which.
    """
    frames = selected.select("video", "frame").distinct()
    labels = predictions.select("video", "label").distinct()
    spine = frames.join(labels, "video")
    # Only rows within reach of a selected frame can fill it; blocks of such rows are all that is looked at.
    reach = F.sequence(F.floor((F.col("frame") - max_gap) / NEAR), F.floor((F.col("frame") + max_gap) / NEAR))
    wanted = frames.select("video", F.explode(reach).alias("_near")).distinct()
    predictions = predictions.withColumn("_near", F.floor(F.col("frame") / NEAR)).join(wanted, ["video", "_near"], "left_semi").drop("_near")
    given = selected.select(*STEP, F.struct("x", "y").alias("_given"))
    around = nearest_confident(predictions, high=high, block=block).select(
        *STEP, F.struct("x", "y").alias("_pred"), confident(high).alias("_ok"), "before", "after"
    )
    rows = spine.join(given, STEP, "left").join(around, STEP, "left")
    need = F.col("_given").isNull() & ~F.coalesce(F.col("_ok"), F.lit(False))
    reachable = F.col("after.frame") - F.col("before.frame") <= max_gap
    runs = rows.where(need & reachable).select(
        *TRACE, F.col("before.frame").alias("start"), F.col("after.frame").alias("end"), "frame",
        F.col("before.x").alias("ax0"), F.col("before.y").alias("ay0"),
        F.col("after.x").alias("ax1"), F.col("after.y").alias("ay1"),
    )
    blended = rstc_blend(
        runs.drop("frame").distinct(), flow, return_paths=True, block=block
    ).where(F.col("disagreement") <= max_disagreement)
    filled = runs.select(*RUN, "frame").join(
        blended.select(*RUN, "frame", F.struct("x", "y").alias("_flow")), [*RUN, "frame"]
    ).select(*STEP, "_flow")
    rows = rows.join(filled, STEP, "left")
    by_pred = F.when(F.col("_ok"), F.col("_pred"))
    rows = rows.select(
        *STEP,
        F.coalesce(F.col("_given"), by_pred, F.col("_flow")).alias("_xy"),
        F.when(F.col("_given").isNotNull(), "given").when(F.col("_ok"), "prediction").otherwise("flow").alias("source"),
    )
    whole = rows.groupBy("video", "frame").agg(
        F.bool_and(F.col("_xy").isNotNull()).alias("_whole"),
        F.collect_list(F.struct("label", "_xy", "source")).alias("_all"),
    )
    return (
        whole.where("_whole")
        .select("video", "frame", F.explode("_all").alias("_r"))
        .select("video", "_r.label", "frame", "_r._xy.x", "_r._xy.y", "_r.source")
    )


def completion_tally(selected: DataFrame, completed: DataFrame) -> DataFrame:
    """Frames kept and dropped, and where the labels of kept frames came from."""
    n_in = selected.select("video", "frame").distinct().groupBy("video").agg(F.count(F.lit(1)).alias("_in"))
    by = lambda s: F.count_if(F.col("source") == s)
    per_frame = completed.groupBy("video", "frame").agg(
        by("given").alias("g"), by("prediction").alias("p"), by("flow").alias("f")
    )
    out = per_frame.groupBy("video").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("g").alias("given"),
        F.sum("p").alias("by_prediction"), F.sum("f").alias("by_flow"),
    )
    joined = n_in.join(out, "video", "left").na.fill(0, ["kept", "given", "by_prediction", "by_flow"])
    return joined.select(
        "video", "kept", (F.col("_in") - F.col("kept")).alias("dropped"), "given", "by_prediction", "by_flow"
    )

