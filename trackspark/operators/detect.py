"""Where a model is unsure, and where it is sure but wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.blocks import (
    BLK, BLOCK, OWN, block_of, halo_window, layout_columns, layout_of, own_rows, plain_rows, position, scan, top_per_group,
    with_halo,
)
from trackspark.functions.geometry import distance
from trackspark.functions.intervals import inside, meet
from trackspark.functions.ranks import IN_ORDER
from trackspark.operators.runs import by_block, robust_threshold, runs
from trackspark.schema import TRACE
from trackspark.session import settle

# Fixed default values.
LOW, HIGH, BRACKET, MAX_GAP = 0.6, 0.9, 5, 45


def confident(high: float = HIGH):
    """A missing likelihood is not a confident one."""
    return F.coalesce(F.col("likelihood") >= high, F.lit(False))


def uncertain_runs(
    predictions: DataFrame,
    *,
    low: float = LOW,
    high: float = HIGH,
    bracket: int = BRACKET,
    max_gap: int = MAX_GAP,
    labels: Sequence[str] | None = None,
    dense: bool = False,
    block: int | None = BLOCK,
) -> DataFrame:
    """Every stretch of unconfident rows with the verdict on it.

    ``reason`` is NULL for a gap worth repairing, else the first failed test:
    ``not_severe``, ``too_long``, ``at_video_edge`` or ``bracket_too_short``.
    Tests count rows; ``dense=True`` states that every frame of a trace has a
    row, so that frame numbers serve as row positions.
    """
    if labels is not None:
        predictions = predictions.where(F.col("label").isin(list(labels)))
    if not dense:
        predictions = plain_rows(predictions)
    rows = predictions.select("video", "label", "frame", "x", "y", "likelihood", *layout_columns(predictions))
    rows = rows.withColumn("pos", F.col("frame")) if dense else position(rows, TRACE, block=block)
    rows = with_halo(rows.withColumn("ok", confident(high)), before=bracket, after=bracket, order="pos", block=block)
    w = halo_window(TRACE, "pos", block)
    ahead, behind = w.rowsBetween(-bracket, -1), w.rowsBetween(1, bracket)
    n_ok = F.sum(F.col("ok").cast("int"))
    seen = rows.select(
        "*",
        F.count(F.lit(1)).over(ahead).alias("rows_before"),
        F.count(F.lit(1)).over(behind).alias("rows_after"),
        F.coalesce(n_ok.over(ahead), F.lit(0)).alias("ok_before"),
        F.coalesce(n_ok.over(behind), F.lit(0)).alias("ok_after"),
        F.struct(F.lag("x").over(w).alias("x"), F.lag("y").over(w).alias("y")).alias("before"),
        F.struct(F.lead("x").over(w).alias("x"), F.lead("y").over(w).alias("y")).alias("after"),
    )
    missing = F.col("likelihood").isNull().cast("int")
    found = runs(
        own_rows(seen, keep_block=True).where(~F.col("ok")),
        order="pos",
        mins={"min_likelihood": "likelihood"},
        sums={"n_missing": missing},
        first={"s_frame": "frame", "before": "before", "rows_before": "rows_before", "ok_before": "ok_before"},
        last={"e_frame": "frame", "after": "after", "rows_after": "rows_after", "ok_after": "ok_after"},
        block=block,
    )
    reason = (
        F.when((F.col("n_missing") == 0) & (F.col("min_likelihood") > low), "not_severe")
        .when(F.col("length") > max_gap, "too_long")
        .when((F.col("rows_before") < bracket) | (F.col("rows_after") < bracket), "at_video_edge")
        .when((F.col("ok_before") < bracket) | (F.col("ok_after") < bracket), "bracket_too_short")
    )
    return found.select(
        "video",
        "label",
        F.col("s_frame").alias("start"),
        F.col("e_frame").alias("end"),
        "length",
        F.col("before.x").alias("ax0"),
        F.col("before.y").alias("ay0"),
        F.col("after.x").alias("ax1"),
        F.col("after.y").alias("ay1"),
        F.when(F.col("n_missing") == 0, F.col("min_likelihood")).alias("min_likelihood"),
        reason.alias("reason"),
    )


def find_gaps(predictions: DataFrame, **params) -> DataFrame:
    """Repairable gaps with their anchors."""
    return uncertain_runs(predictions, **params).where(F.col("reason").isNull()).drop("reason")


def rejected_runs(predictions: DataFrame, **params) -> DataFrame:
    return (
        uncertain_runs(predictions, **params)
        .where(F.col("reason").isNotNull())
        .select("video", "label", "start", "end", "length", "reason")
    )


def gap_label_stats(
    predictions: DataFrame, *, low: float = LOW, high: float = HIGH, **params
) -> DataFrame:
    """Likelihood and gap counts per label."""
    lik = F.col("likelihood")
    per_row = predictions.groupBy(*TRACE).agg(
        F.count_if(lik <= low).alias("n_low"),
        F.count_if(~confident(high)).alias("n_unconfident"),
        F.avg("likelihood").alias("mean_likelihood"),
    )
    gap = F.col("reason").isNull()
    per_run = uncertain_runs(predictions, low=low, high=high, **params).groupBy(*TRACE).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(gap).alias("n_gaps"),
        F.sum(F.when(gap, F.col("length")).otherwise(0)).alias("n_gap_frames"),
    )
    counted = per_row.join(per_run, list(TRACE), "left")
    return counted.na.fill(0, ["n_runs", "n_gaps", "n_gap_frames"])


def rejected_summary(run_table: DataFrame) -> DataFrame:
    """Declined runs and the frames they cover, per reason."""
    return (
        run_table.where(F.col("reason").isNotNull())
        .groupBy("video", "reason")
        .agg(F.count(F.lit(1)).alias("n_runs"), F.sum("length").alias("n_frames"))
    )


def disagreement(positions: DataFrame, flow_positions: DataFrame) -> DataFrame:
    """Distance between the model and the flow landing; NULL where one is missing.

    Tables stored in blocks are joined in place, and the block number stays.
    """
    both = layout_of(positions), layout_of(flow_positions)
    in_place = both[0] is not None and both[1] is not None and both[0][0] == both[1][0]
    if in_place:
        positions, flow_positions = (df.where(F.col(OWN)) for df in (positions, flow_positions))
    else:
        positions, flow_positions = plain_rows(positions), plain_rows(flow_positions)
    step = [*TRACE, *([BLK] if in_place else []), "frame"]
    landed = flow_positions.select(*step, F.col("x").alias("fx"), F.col("y").alias("fy"))
    seen = positions.select(*step, "x", "y").join(landed, step, "left")
    return seen.withColumn("d", distance("x", "y", "fx", "fy"))


def disagreement_runs(
    positions: DataFrame,
    flow_positions: DataFrame,
    *,
    threshold_factor: float = 5.0,
    max_gap: int = 1,
    max_blip_length: int | None = None,
    in_order: int = IN_ORDER,
    block: int = BLOCK,
) -> DataFrame:
    """Runs where the model and the flow disagree beyond a robust threshold.

    ``reason`` is NULL for an accepted blip, ``long`` above the length cap and
    ``edge`` without a point on both sides. Distances are settled: thresholds,
    hits and the points next to the runs are all taken from them.
    """
    stored = layout_of(positions)
    block = stored[0] if stored else block
    seen = settle(disagreement(positions, flow_positions))
    limits = robust_threshold(seen, "d", factor=threshold_factor, in_order=in_order, block=block)
    limits = by_block(limits.select(*TRACE, "threshold"), seen, block=block)
    rows = seen if BLK in seen.columns else seen.withColumn(BLK, block_of("frame", block))
    hits = rows.join(limits, [*TRACE, BLK]).where(F.col("d") > F.col("threshold"))
    found = runs(hits, max_gap=max_gap, mins={"threshold": "threshold"}, block=block)
    # An anchor must sit on the very next frame and be complete.
    complete = seen.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    sides = F.array(
        F.struct((F.col("start") - 1).alias("frame"), F.lit(True).alias("ahead")),
        F.struct((F.col("end") + 1).alias("frame"), F.lit(False).alias("ahead")),
    )
    asked = found.select(*TRACE, "start", "end", "length", "threshold", F.explode(sides).alias("_s"))
    asked = asked.select("*", F.col("_s.frame").alias("frame"), F.col("_s.ahead").alias("_ahead")).drop("_s")
    met = asked.join(complete.select(*TRACE, "frame", F.struct("x", "y").alias("_p")), [*TRACE, "frame"], "left")
    side = lambda ahead: F.max(F.when(F.col("_ahead") == ahead, F.col("_p")))
    found = met.groupBy(*TRACE, "start", "end", "length", "threshold").agg(
        side(True).alias("before"), side(False).alias("after")
    )
    too_long = F.lit(False) if max_blip_length is None else F.col("length") > max_blip_length
    reason = F.when(too_long, "long").when(F.col("before").isNull() | F.col("after").isNull(), "edge")
    return found.select(
        *TRACE,
        "start",
        "end",
        "length",
        F.col("before.x").alias("ax0"),
        F.col("before.y").alias("ay0"),
        F.col("after.x").alias("ax1"),
        F.col("after.y").alias("ay1"),
        "threshold",
        reason.alias("reason"),
    )


def disagreement_blips(positions: DataFrame, flow_positions: DataFrame, **params) -> DataFrame:
    return disagreement_runs(positions, flow_positions, **params).where(F.col("reason").isNull()).drop("reason")


def blip_label_stats(run_table: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Threshold figures and accepted / skipped run counts per label."""
    counts = run_table.groupBy(*TRACE).agg(
        F.count_if(F.col("reason").isNull()).alias("n_blips"),
        F.count_if(F.col("reason") == "edge").alias("n_edge"),
        F.count_if(F.col("reason") == "long").alias("n_long"),
    )
    return thresholds.join(counts, list(TRACE), "left").na.fill(0, ["n_blips", "n_edge", "n_long"])


def length_histogram(blips: DataFrame) -> DataFrame:
    return blips.groupBy("length").agg(F.count(F.lit(1)).alias("n_blips"))


def min_coverage(points: DataFrame, videos: DataFrame, declared: DataFrame) -> DataFrame:
    """The smallest share of frames any declared label covers, per video."""
    present = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    present = present.groupBy("video", "label").agg(F.count(F.lit(1)).alias("n"))
    return (
        declared.select("video", "label").distinct()
        .join(present, ["video", "label"], "left")
        .groupBy("video")
        .agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
        .join(videos.select("video", "n_frames"), "video")
        .select(
            "video",
            F.when(F.col("n_frames") > 0, F.col("n") / F.col("n_frames")).otherwise(0.0).alias("coverage"),
        )
    )


def points_in_runs(points: DataFrame, run_table: DataFrame) -> DataFrame:
    """The original points at every frame of the given runs."""
    return inside(points, run_table)


def attach_min_likelihood(
    blips: DataFrame,
    predictions: DataFrame | None,
    *,
    confident_only: bool = True,
    high: float = HIGH,
) -> DataFrame:
    """Blips as gaps: their lowest likelihood, and which ones the likelihood already shows.

    Blips of a label without predictions keep a NULL likelihood and are kept.
    """
    if predictions is None:
        return blips.withColumns({"min_likelihood": F.lit(None).cast("double"), "reason": F.lit(None).cast("string")})
    run = [*TRACE, "start"]
    lows = (
        meet(predictions.select(*TRACE, "frame", "likelihood"), blips.select(*run, "end").distinct())
        .groupBy(*run)
        .agg(
            F.min("likelihood").alias("_min"),
            F.count_if(F.col("likelihood").isNull()).alias("_holes"),
        )
    )
    out = blips.join(lows, run, "left").withColumn(
        "min_likelihood", F.when(F.col("_holes") == 0, F.col("_min"))
    )
    shown = F.lit(confident_only) & (F.col("min_likelihood") < high)
    return out.drop("_min", "_holes").withColumn("reason", F.when(shown, "also_low_likelihood"))


def low_confidence_frames(
    predictions: DataFrame, threshold: float, *, max_frames: int | None = None
) -> DataFrame:
    """Frames whose worst label is below ``threshold``, most uncertain first.

    A frame with any missing likelihood has no worst value and is left out.
    """
    n_labels = predictions.select("video", "label").distinct().groupBy("video").agg(
        F.count(F.lit(1)).alias("n_labels")
    )
    worst = (
        predictions.groupBy("video", "frame")
        .agg(F.min("likelihood").alias("worst"), F.count("likelihood").alias("n"))
        .where(F.col("worst") < threshold)
        .join(n_labels, "video")
        .where(F.col("n") == F.col("n_labels"))
        .select("video", "frame", "worst")
    )
    if max_frames is None:
        return worst
    return top_per_group(
        worst, ["video"], [F.col("worst"), F.col("frame")], max_frames, salt_on=["frame"]
    )


def nearest_confident(predictions: DataFrame, *, high: float = HIGH, block: int | None = BLOCK) -> DataFrame:
    """The closest confident frames strictly before and after each row."""
    at = F.when(confident(high), F.struct("frame", "x", "y"))
    return scan(predictions, TRACE, {"before": ("prev", at), "after": ("next", at)}, block=block)
