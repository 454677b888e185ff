"""Layer algebra: projections, label schema, merges, overlays and differences.

A layer is the set of rows of one (video, layer) in a table of track points;
labels that are declared but hold no points live in ``declared`` tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.blocks import BLOCK, halo_window, own_rows, spread, with_halo
from trackspark.schema import LAYER, LAYER_TRACE

POINT = [*LAYER_TRACE, "frame"]
INTERVAL_BLOCK = 1024


# --- filters -----------------------------------------------------------------

def clip_frames(points: DataFrame, start: int, end: int) -> DataFrame:
    """Keep frames ``start .. end``, both included."""
    return points.where(F.col("frame").between(start, end))


def normalize_intervals(intervals: DataFrame, videos: DataFrame) -> DataFrame:
    """Clamp intervals to their video and put their ends in order."""
    joined = intervals.join(videos.select("video", "n_frames"), "video")
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("n_frames") - 1)
    lo, hi = clamp("start"), clamp("end")
    kept = [c for c in intervals.columns if c not in ("start", "end")]
    return joined.select(*kept, F.least(lo, hi).alias("start"), F.greatest(lo, hi).alias("end"))


def _interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on interval containment, as an equi-join on frame blocks."""
    blk = lambda c: F.floor(F.col(c) / INTERVAL_BLOCK).cast("long")
    spans = intervals.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    spans = spans.withColumn(
        "_ib", F.explode(F.sequence(F.floor(F.col("_s") / INTERVAL_BLOCK), F.floor(F.col("_e") / INTERVAL_BLOCK)))
    )
    left = points.withColumn("_ib", blk("frame")).alias("p")
    right = spans.alias("i")
    on = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*keys, "_ib"]]
    on.append(F.col("p.frame").between(F.col("i._s"), F.col("i._e")))
    return left.join(right, on, how).drop("_ib")


def in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("video", "label")) -> DataFrame:
    return _interval_join(points, intervals, keys, "left_semi")


def remove_intervals(
    points: DataFrame,
    intervals: DataFrame,
    *,
    all_labels: bool = False,
    overlay_declared: DataFrame | None = None,
) -> DataFrame:
    """Delete points inside inclusive intervals.

    ``all_labels`` applies an interval to every label of its video; with an
    overlay that means the labels the overlay declares.
    """
    if not all_labels:
        return _interval_join(points, intervals, ["video", "label"], "left_anti")
    spans = intervals.select("video", "start", "end").distinct()
    if overlay_declared is None:
        return _interval_join(points, spans, ["video"], "left_anti")
    labels = overlay_declared.select("video", "label").distinct()
    return _interval_join(points, spans.join(labels, "video"), ["video", "label"], "left_anti")


def points_at_frame(points: DataFrame, declared: DataFrame, frame: int) -> DataFrame:
    """One row per declared label; coordinates are NULL where it has no point."""
    here = points.where(F.col("frame") == frame).select(*LAYER_TRACE, "x", "y")
    return (
        declared.select(*LAYER_TRACE)
        .join(here, list(LAYER_TRACE), "left")
        .select(*LAYER_TRACE, F.lit(frame).cast("long").alias("frame"), "x", "y")
    )


def layer_frames(points: DataFrame) -> DataFrame:
    """Annotated frames of each layer, over all labels."""
    return points.select(*LAYER, "frame").distinct()


def layer_summary(points: DataFrame, declared: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Labels, annotated frames, points and frame count of each layer."""
    per_frame = points.groupBy(*LAYER, "frame").agg(F.count(F.lit(1)).alias("_n"))
    data = per_frame.groupBy(*LAYER).agg(
        F.count(F.lit(1)).alias("n_annotated_frames"),
        F.sum("_n").alias("n_points"),
        (F.max("frame") + 1).alias("_n_seen"),
    )
    labels = declared.groupBy(*LAYER).agg(F.count(F.lit(1)).alias("n_labels"))
    out = labels.join(data, list(LAYER), "full").na.fill(0, ["n_labels", "n_annotated_frames", "n_points"])
    if videos is None:
        return out.withColumn("n_frames", F.coalesce("_n_seen", F.lit(0))).drop("_n_seen")
    out = out.join(videos.select("video", F.col("n_frames").alias("_n_video")), "video", "left")
    return out.withColumn("n_frames", F.coalesce("_n_video", "_n_seen", F.lit(0))).drop("_n_seen", "_n_video")


def _complete_frames(points: DataFrame, declared: DataFrame) -> DataFrame:
    wanted = declared.groupBy(*LAYER).agg(F.count(F.lit(1)).alias("_wanted"))
    present = points.join(declared.select(*LAYER_TRACE), list(LAYER_TRACE), "left_semi")
    present = present.groupBy(*LAYER, "frame").agg(F.count(F.lit(1)).alias("_n"))
    return present.join(wanted, list(LAYER)).where(F.col("_n") == F.col("_wanted")).select(*LAYER, "frame")


def _keep_frames(points: DataFrame, keep: DataFrame) -> DataFrame:
    """Keep the given frames; a layer that would lose everything stays as it is."""
    kept = keep.select(*LAYER, "frame").distinct().withColumn("_kept", F.lit(True))
    some = keep.select(*LAYER).distinct().withColumn("_some", F.lit(True))
    rows = points.join(kept, [*LAYER, "frame"], "left").join(some, list(LAYER), "left")
    return rows.where(F.col("_kept").isNotNull() | F.col("_some").isNull()).select(*points.columns)


def keep_complete_frames(points: DataFrame, declared: DataFrame) -> DataFrame:
    """Keep frames where every declared label has a point."""
    return _keep_frames(points, _complete_frames(points, declared))


def keep_complete_runs(points: DataFrame, declared: DataFrame, *, block: int | None = BLOCK) -> DataFrame:
    """Keep complete frames that have a complete direct neighbour."""
    rows = with_halo(_complete_frames(points, declared), before=1, after=1, block=block)
    w = halo_window(LAYER, block=block)
    beside = (F.lag("frame").over(w) == F.col("frame") - 1) | (F.lead("frame").over(w) == F.col("frame") + 1)
    rows = rows.withColumn("_near", F.coalesce(beside, F.lit(False)))
    # `beside` is NULL-or-true logic: one missing side must not hide the other.
    return _keep_frames(points, own_rows(rows.where("_near")).select(*LAYER, "frame"))


def densify(
    points: DataFrame,
    declared: DataFrame,
    videos: DataFrame,
    *,
    on_out_of_range: str = "ignore",
    block: int = BLOCK,
) -> DataFrame:
    """Every frame of the video for every declared label, with time in seconds.

    Points outside the video are ignored, or raise with ``on_out_of_range='error'``.
    """
    if on_out_of_range not in ("ignore", "error"):
        raise ValueError(f"unknown on_out_of_range {on_out_of_range!r}")
    spans = declared.select(*LAYER_TRACE).join(videos, "video").where(F.col("n_frames") > 0)
    # The first frames of the blocks are spread out before they grow into rows.
    starts = spans.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1, F.lit(block))))
    starts = spread(starts, *LAYER_TRACE, "_from")
    stop = F.least(F.col("_from") + block - 1, F.col("n_frames") - 1)
    spine = starts.withColumn("frame", F.explode(F.sequence(F.col("_from"), stop)))
    joined = spine.join(points.select(*POINT, "x", "y"), POINT, "left")
    if on_out_of_range == "error":
        inside = points.select(*POINT, "x", "y").join(videos.select("video", "n_frames", "fps"), "video")
        bad = inside.where(~F.col("frame").between(0, F.col("n_frames") - 1)).select(
            *POINT,
            F.raise_error(F.concat(F.lit("frame outside the video: "), F.col("frame"))).cast("double").alias("x"),
            "y",
            "fps",
        )
        joined = joined.select(*POINT, "x", "y", "fps").unionByName(bad)
    return joined.select(*POINT, "x", "y", (F.col("frame") / F.col("fps")).alias("t"))


def order_points(points: DataFrame) -> DataFrame:
    """Labels by number, frames ascending."""
    return points.orderBy("video", "layer", F.col("label").cast("int"), "frame")


# --- label schema ------------------------------------------------------------

def _labels_with_points(points: DataFrame) -> DataFrame:
    return points.select(*LAYER_TRACE).distinct()


def number_labels(declared: DataFrame) -> DataFrame:
    """Set label positions by label number."""
    w = Window.partitionBy(*LAYER).orderBy(F.col("label").cast("int"), "label")
    return declared.select(*LAYER_TRACE).withColumn("pos", F.row_number().over(w) - 1)


def remove_empty_labels(declared: DataFrame, points: DataFrame) -> DataFrame:
    return declared.join(_labels_with_points(points), list(LAYER_TRACE), "left_semi")


def clip_trailing_empty_labels(declared: DataFrame, points: DataFrame) -> DataFrame:
    """Drop empty labels after the last filled one; the first label always stays."""
    filled = _labels_with_points(points).withColumn("_filled", F.lit(True))
    w = Window.partitionBy(*LAYER)
    marked = declared.join(filled, list(LAYER_TRACE), "left")
    last = F.max(F.when(F.col("_filled"), F.col("pos"))).over(w)
    first = F.min("pos").over(w)
    return (
        marked.withColumn("_keep", F.col("pos") <= F.coalesce(last, first))
        .where("_keep").drop("_keep", "_filled")
    )


def add_label(declared: DataFrame, label: str | None = None) -> DataFrame:
    """Declare one more label in every layer; by default its number of labels.

    A label that exists already is left alone.
    """
    if label is not None and not label.isdigit():
        raise ValueError("labels are numbers written as text")
    counted = declared.groupBy(*LAYER).agg(F.count(F.lit(1)).cast("string").alias("label"))
    new = counted if label is None else counted.withColumn("label", F.lit(label))
    return number_labels(declared.select(*LAYER_TRACE).unionByName(new.select(*LAYER_TRACE)).distinct())


def union_labels_across_layers(declared: DataFrame) -> DataFrame:
    """Give every layer of a video the labels of all its layers."""
    layers = declared.select(*LAYER).distinct()
    labels = declared.select("video", "label").distinct()
    return number_labels(layers.join(labels, "video").select(*LAYER_TRACE))


def reset_empty_layer_labels(
    declared: DataFrame, points: DataFrame, labels: Sequence[str], is_manual: Column
) -> DataFrame:
    """Give the project labels to manual layers without any point."""
    empty = declared.where(is_manual).select(*LAYER).distinct().join(
        points.select(*LAYER).distinct(), list(LAYER), "left_anti"
    )
    fresh = empty.withColumn("label", F.explode(F.array(*[F.lit(v) for v in labels])))
    kept = declared.select(*LAYER_TRACE).join(empty, list(LAYER), "left_anti")
    return number_labels(kept.unionByName(fresh.select(*LAYER_TRACE)))


def ensure_labels(declared: DataFrame, wanted: DataFrame) -> DataFrame:
    """Declare the labels of ``wanted`` (video, layer, label) where missing."""
    return number_labels(
        declared.select(*LAYER_TRACE).unionByName(wanted.select(*LAYER_TRACE)).distinct()
    )


# --- edits and layer lifecycle -------------------------------------------------

def apply_edits(points: DataFrame, edits: DataFrame) -> DataFrame:
    """Replay an edit log ``(video, layer, label, frame, x, y, op, seq)``.

    ``op`` is ``add`` (also overwrites) or ``delete``; the highest ``seq`` of a
    point decides. Deleting an absent point does nothing.
    """
    state = F.struct("x", "y", "op")
    log = points.select(*POINT, "x", "y", F.lit("add").alias("op"), F.lit(-1).cast("long").alias("seq"))
    log = log.unionByName(edits.select(*POINT, "x", "y", "op", F.col("seq").cast("long").alias("seq")))
    final = log.groupBy(*POINT).agg(F.max_by(state, "seq").alias("_s")).where(F.col("_s.op") != "delete")
    return final.select(*POINT, "_s.x", "_s.y")


def rename_layer(table: DataFrame, declared: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a layer in a table that has a ``layer`` column.

    The old layer must exist in a video and the new one must not; rows of a
    video that breaks this raise an error.
    """
    names = declared.where(F.col("layer").isin(old, new)).select(*LAYER).distinct()
    clash = names.groupBy("video").agg(F.count_if(F.col("layer") == new).alias("_clash"))
    joined = table.join(clash, "video", "left")
    renamed = F.when(
        (F.col("layer") == old) & (F.col("_clash") > 0),
        F.raise_error(F.lit(f"layer {new} exists already")).cast("string"),
    ).when(F.col("layer") == old, F.lit(new)).otherwise(F.col("layer"))
    return joined.withColumn("layer", renamed).select(*table.columns)


def drop_layer(table: DataFrame, declared: DataFrame, name: str) -> DataFrame:
    """Drop a layer, except where it is the only one besides ``buffer``."""
    others = declared.where(~F.col("layer").isin(name, "buffer")).select("video").distinct()
    gone = others.withColumn("layer", F.lit(name))
    return table.join(gone, list(LAYER), "left_anti")


def toggle_frames(toggles: DataFrame) -> DataFrame:
    """Frames of interest: marked an odd number of times."""
    marks = toggles.groupBy("video", "frame").agg(F.count(F.lit(1)).alias("_n"))
    return marks.where(F.col("_n") % 2 == 1).select("video", "frame")


# --- merges --------------------------------------------------------------------

def merge_layers(points: DataFrame, priority: Column | str, name: str = "merged") -> DataFrame:
    """Union of layers of a video; the row of highest priority wins per point."""
    keys = ["video", "label", "frame"]
    ranked = points.withColumn("_p", F.col(priority) if isinstance(priority, str) else priority)
    best = ranked.groupBy(*keys).agg(F.max_by(F.struct("x", "y"), "_p").alias("_xy"))
    return best.select("video", F.lit(name).alias("layer"), "label", "frame", "_xy.x", "_xy.y")


def merge_declared(declared: DataFrame, name: str = "merged") -> DataFrame:
    return number_labels(declared.select("video", F.lit(name).alias("layer"), "label").distinct())


def patch_layer(source: DataFrame, patch: DataFrame, name: str = "patched") -> DataFrame:
    """Lay a sparse patch over a layer; the patch wins, both sides are kept.

    Presence decides, not the value: a patch row replaces the source row even
    where its coordinates are NULL.
    """
    keys = ["video", "label", "frame"]
    old = source.select(*keys, F.struct("x", "y").alias("_old"))
    new = patch.select(*keys, F.struct("x", "y").alias("_new"))
    xy = F.coalesce(F.col("_new"), F.col("_old"))
    return (
        old.join(new, keys, "full_outer")
        .select("video", F.lit(name).alias("layer"), "label", "frame", xy.alias("_xy"))
        .select("video", "layer", "label", "frame", "_xy.x", "_xy.y")
    )


def splice_corrections(
    source: DataFrame, corrections: DataFrame, declared: DataFrame, name: str = "spliced"
) -> DataFrame:
    """Overwrite or add corrected points, for labels the source declares."""
    labels = declared.select("video", "label").distinct()
    return patch_layer(source, corrections.join(labels, ["video", "label"], "left_semi"), name)


def copy_from_overlay(
    current: DataFrame,
    overlay: DataFrame,
    declared: DataFrame,
    *,
    frames: DataFrame | None = None,
    intervals: DataFrame | None = None,
    existing: bool = False,
    name: str = "iteration-0",
) -> DataFrame:
    """Copy overlay points into the current layer, for the labels it declares.

    Give one selection: ``frames`` (video, frame[, label]), ``intervals``
    (video, start, end[, label]), or ``existing=True`` for the frames the
    current layer has under any label. Holes in the overlay are skipped.
    """
    if sum((frames is not None, intervals is not None, existing)) != 1:
        raise ValueError("give one of frames, intervals, existing")
    labels = declared.select("video", "label").distinct()
    picked = overlay.join(labels, ["video", "label"], "left_semi")
    if frames is not None:
        on = [c for c in ("video", "label", "frame") if c in frames.columns]
        picked = picked.join(frames.select(*on).distinct(), on, "left_semi")
    elif intervals is not None:
        on = [c for c in ("video", "label") if c in intervals.columns]
        picked = in_intervals(picked, intervals, on)
    else:
        picked = picked.join(current.select("video", "frame").distinct(), ["video", "frame"], "left_semi")
    return patch_layer(current, picked, name)


def average_with_overlay(
    current: DataFrame, overlay: DataFrame, intervals: DataFrame, name: str = "iteration-0"
) -> DataFrame:
    """Inside the intervals, replace points both layers have by their mean."""
    keys = ["video", "label", "frame"]
    inside = in_intervals(current, intervals, [c for c in ("video", "label") if c in intervals.columns])
    other = overlay.select(*keys, F.col("x").alias("_ox"), F.col("y").alias("_oy"))
    mean = inside.join(other, keys).select(
        *keys, ((F.col("x") + F.col("_ox")) / 2).alias("x"), ((F.col("y") + F.col("_oy")) / 2).alias("y")
    )
    return patch_layer(current, mean, name)


def diff_layers(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """Points added, removed or modified between two states of the layers."""
    new = memory.select(*POINT, F.struct("x", "y").alias("_new"))
    old = disk.select(*POINT, F.struct("x", "y").alias("_old"))
    status = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(~F.col("_new").eqNullSafe(F.col("_old")), "modified")
    )
    return (
        new.join(old, POINT, "full_outer")
        .withColumn("status", status)
        .where(F.col("status").isNotNull())
        .select(*POINT, "status")
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """Changed points per layer; unchanged layers do not appear."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return diff.groupBy(*LAYER).agg(count("added"), count("removed"), count("modified"))
