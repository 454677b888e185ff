"""Completeness and consistency of manual layers before training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.names import is_manual
from trackspark.operators.layers import diff_layers
from trackspark.schema import LAYER, LAYER_TRACE
from trackspark.session import settle


def _text_array(values: Sequence[str]):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def incomplete_frames(points: DataFrame, required: Sequence[str] | None = None) -> DataFrame:
    """Annotated frames that lack a required label, with the missing labels.

    Without a list, the labels of a layer that hold any point are required.
    Frames of any label count as annotated.
    """
    present = points.groupBy(*LAYER, "frame").agg(F.collect_set("label").alias("_has"))
    if required is None:
        labels = points.select(*LAYER_TRACE).distinct().groupBy(*LAYER).agg(
            F.array_sort(F.collect_list(F.struct(F.col("label").cast("int").alias("n"), "label"))).alias("_l")
        )
        present = present.join(labels, list(LAYER))
        wanted = F.transform("_l", lambda s: s["label"])
    else:
        wanted = _text_array(required)
    missing = F.array_except(wanted, F.col("_has"))
    return (
        present.withColumn("missing", missing)
        .where(F.size("missing") > 0)
        .select(*LAYER, "frame", "missing")
    )


def stray_labels(points: DataFrame, required: Sequence[str] | None) -> DataFrame:
    """Points under labels outside the required list, one row per frame.

    No list means no strays; an empty list makes every label a stray.
    """
    strays = points.select(*LAYER_TRACE, "frame")
    if required is None:
        return strays.where(F.lit(False))
    return strays.where(~F.array_contains(_text_array(required), F.col("label")))


def has_strays(points: DataFrame, required: Sequence[str] | None) -> DataFrame:
    """Whether each layer has a stray label."""
    stray = F.lit(False) if required is None else ~F.array_contains(_text_array(required), F.col("label"))
    return points.groupBy(*LAYER).agg(F.bool_or(stray).alias("has_strays"))


def quality_issues(
    memory: DataFrame, disk: DataFrame | None = None, required: Sequence[str] | None = None
) -> DataFrame:
    """All issues of the manual layers: ``(video, layer, issue, label, frame)``."""
    memory = memory.where(is_manual("layer"))
    lacking = incomplete_frames(memory, required).select(
        *LAYER, F.lit("incomplete").alias("issue"), F.explode("missing").alias("label"), "frame"
    )
    strays = stray_labels(memory, required).select(*LAYER, F.lit("stray").alias("issue"), "label", "frame")
    out = lacking.unionByName(strays)
    if disk is not None:
        changed = diff_layers(memory, disk.where(is_manual("layer")))
        out = out.unionByName(changed.select(*LAYER, F.col("status").alias("issue"), "label", "frame"))
    return out


def quality_report(issues: DataFrame) -> DataFrame:
    """Issue counts per layer with a line of text; clean layers do not appear."""
    n = lambda kind: F.col(f"n_{kind}")
    kinds = ["added", "removed", "modified", "stray"]
    # Several labels may be missing in one frame; the frame counts once.
    per_frame = issues.groupBy(*LAYER, "issue", "frame").agg(F.count(F.lit(1)).alias("_n"))
    totals = per_frame.groupBy(*LAYER).agg(
        F.count_if(F.col("issue") == "incomplete").alias("n_incomplete_frames"),
        *[F.sum(F.when(F.col("issue") == k, F.col("_n")).otherwise(0)).alias(f"n_{k}") for k in kinds],
    )
    text = F.concat_ws(
        "; ",
        F.when(
            n("added") + n("removed") + n("modified") > 0,
            F.concat(
                F.lit("unsaved: +"), n("added").cast("string"), F.lit(" -"), n("removed").cast("string"),
                F.lit(" ~"), n("modified").cast("string"),
            ),
        ),
        F.when(
            F.col("n_incomplete_frames") > 0,
            F.concat(F.lit("incomplete frames: "), F.col("n_incomplete_frames").cast("string")),
        ),
        F.when(n("stray") > 0, F.concat(F.lit("stray points: "), n("stray").cast("string"))),
    )
    return totals.withColumn("summary", text)


def incomplete_breakdown(incomplete: DataFrame) -> DataFrame:
    """How many frames lack each label."""
    return (
        incomplete.select(*LAYER, F.explode("missing").alias("label"))
        .groupBy(*LAYER_TRACE)
        .agg(F.count(F.lit(1)).alias("n_frames"))
    )


def remediate(
    points: DataFrame, required: Sequence[str] | None = None, *, strip_strays: bool = True
) -> DataFrame:
    """Drop incomplete frames of manual layers, and stray labels unless told not to."""
    manual = points.where(is_manual("layer"))
    bad = incomplete_frames(manual, required).select(*LAYER, "frame")
    kept = points.join(bad, [*LAYER, "frame"], "left_anti")
    if required is None or not strip_strays:
        return kept
    inside = F.array_contains(_text_array(required), F.col("label"))
    return kept.where(inside | ~is_manual("layer"))


def dropped_points(points: DataFrame, required: Sequence[str] | None = None) -> DataFrame:
    """The points present at the frames `remediate` drops."""
    manual = points.where(is_manual("layer"))
    bad = incomplete_frames(manual, required).select(*LAYER, "frame")
    return manual.join(bad, [*LAYER, "frame"], "left_semi")


def has_trainable_labels(points: DataFrame, labeled: DataFrame | None = None) -> DataFrame:
    """One row: is there any point to train on?"""
    rows = points.where(is_manual("layer")).select(F.lit(1).alias("_r"))
    if labeled is not None:
        rows = rows.unionByName(labeled.select(F.lit(1).alias("_r")))
    return rows.agg((F.count(F.lit(1)) > 0).alias("has_trainable_labels"))


def check_label_schema(declared: DataFrame) -> DataFrame:
    """Whether all videos declare the same labels, and the body parts that follow.

    One row: label counts agree, names agree, labels some video lacks, and the
    ``point<label>`` names in text order. Videos without labels are no part of it.
    """
    pairs = settle(declared.select("video", "label").distinct())
    n_labels = pairs.groupBy("video").agg(F.count(F.lit(1)).alias("k"))
    videos, fewest, most = n_labels.agg(F.count(F.lit(1)), F.min("k"), F.max("k")).first()
    # A label that every video declares is counted as often as there are videos; one row per label is left.
    by_label = pairs.groupBy("label").agg((F.count(F.lit(1)) < videos).alias("_missing"))
    listed = lambda value: F.sort_array(F.collect_list(value))
    return by_label.agg(
        F.lit(videos).cast("long").alias("n_videos"),
        F.lit(fewest == most).alias("same_count"),
        (F.count_if("_missing") == 0).alias("same_names"),
        listed(F.when(F.col("_missing"), F.col("label"))).alias("missing_somewhere"),
        listed(F.concat(F.lit("point"), F.col("label"))).alias("bodyparts"),
    )
