"""Smoothing and thinning along traces, and shapes made of labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.blocks import (
    BLK, BLOCK, block_of, halo_window, layout_columns, layout_of, meet_blocks, own_rows, plain_rows, scan, with_halo,
)
from trackspark.functions.geometry import EPSILON, polygon_area
from trackspark.operators.layers import _interval_join, in_intervals
from trackspark.operators.quality import incomplete_frames
from trackspark.operators.repair import RUN, STEP
from trackspark.schema import LAYER, TRACE
from trackspark.session import settle

# The filter periods in frames, one per level.
LADDER = [5, 8, 13, 21, 34, 55, 89, 144]
MIN_CONTEXT_POINTS = 8

# A block that holds any trace.
ONE_BLOCK = 1 << 40
STEPS = ("dx_fwd", "dy_fwd", "dx_rev", "dy_rev")
_TEXT, _LONG, _REAL = pa.string(), pa.int64(), pa.float64()
SMOOTHED = pa.schema(
    [("video", _TEXT), ("label", _TEXT), (BLK, _LONG), ("frame", _LONG), ("x", _REAL), ("y", _REAL)]
    + [(c, _LONG) for c in ("n_points", "n_fwd", "n_rev", "n_frames")]
)
PASSED = pa.schema(
    [("video", _TEXT), ("label", _TEXT), ("start", _LONG), ("end", _LONG), (BLK, _LONG), ("frame", _LONG), ("x", _REAL), ("y", _REAL), ("n_near", _LONG)]
)


def window_frames(seconds: float, fps: float) -> int:
    """Frames of a smoothing window; halves round to even."""
    return round(seconds * fps)


def _blend_weights(n: int) -> list[float]:
    """Forward weights over a window of ``n`` frames."""
    steep, centre = 2.0 * math.log(1.0 / EPSILON - 1.0) / (n - 1), (n - 1) / 2.0
    return [
        (1.0 / (1.0 + math.exp(steep * (o - centre))) - 0.5) / (1.0 - 2.0 * EPSILON) + 0.5 for o in range(n)
    ]


def smoothing_coverage(points: DataFrame, flow: DataFrame, videos: DataFrame) -> DataFrame:
    """Which labels can be smoothed, and why not: every frame of the video needs a point, every step inside it a flow.

    Rows outside of frames 0 to n_frames - 1 do not count.
    """
    lengths = videos.select("video", "n_frames")
    frame, last = F.col("frame"), F.col("n_frames") - 1
    has = F.col("x").isNotNull() & F.col("y").isNotNull() & frame.between(0, last)
    have = points.join(lengths, "video").groupBy(*TRACE, "n_frames").agg(
        F.count_distinct(F.when(has, frame)).alias("n_points")
    )
    forth = F.col("dx_fwd").isNotNull() & F.col("dy_fwd").isNotNull() & frame.between(1, last)
    back = F.col("dx_rev").isNotNull() & F.col("dy_rev").isNotNull() & frame.between(0, last - 1)
    steps = flow.join(lengths, "video").groupBy(*TRACE).agg(
        F.count_distinct(F.when(forth, frame)).alias("_f"), F.count_distinct(F.when(back, frame)).alias("_r")
    )
    joined = have.join(steps, list(TRACE), "left")
    whole_flow = (F.coalesce("_f", F.lit(0)) >= last) & (F.coalesce("_r", F.lit(0)) >= last)
    reason = F.when(F.col("n_points") < F.col("n_frames"), "holes").when(~whole_flow, "flow_missing")
    return joined.select(*TRACE, "n_points", "n_frames", reason.alias("reason"))


def _joined_steps(
    points: DataFrame, flow: DataFrame, videos: DataFrame, n_window: int, block: int | None
) -> DataFrame:
    """Points with their flow steps, in blocks with a window of context on each side."""
    if n_window < 2:
        raise ValueError("a smoothing window needs at least two frames")
    good = smoothing_coverage(points, flow, videos).where(F.col("reason").isNull())
    good = good.where(F.col("n_frames") >= n_window).select(*TRACE, "n_frames")
    steps = flow.select(
        *STEP, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dx_fwd", "dy_fwd", "dx_rev", "dy_rev")]
    )
    rows = points.select(*STEP, "x", "y").join(steps, STEP).join(good, list(TRACE))
    rows = rows.where(F.col("frame").between(0, F.col("n_frames") - 1))
    return with_halo(rows, before=n_window - 1, after=n_window - 1, block=block)


def _windowed(
    points: DataFrame, flow: DataFrame, videos: DataFrame, n_window: int, block: int | None
) -> DataFrame:
    k = n_window - 1
    rows = _joined_steps(points, flow, videos, n_window, block)
    w = halo_window(TRACE, block=block)
    # Only differences of the sums inside one window matter, so they may start
    # anywhere in the block. The reverse step into a frame belongs to the pair
    # (frame, frame + 1); summed from the left it is counted up to frame - 1.
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "_Fx": F.sum("dx_fwd").over(run), "_Fy": F.sum("dy_fwd").over(run),
            "_Rx": -F.coalesce(F.sum("dx_rev").over(before), F.lit(0.0)),
            "_Ry": -F.coalesce(F.sum("dy_rev").over(before), F.lit(0.0)),
        }
    )
    from_start = F.struct((F.col("x") - F.col("_Fx")).alias("x"), (F.col("y") - F.col("_Fy")).alias("y"))
    from_end = F.struct((F.col("x") - F.col("_Rx")).alias("x"), (F.col("y") - F.col("_Ry")).alias("y"))
    rows = rows.withColumns(
        {
            "_u": F.collect_list(from_start).over(w.rowsBetween(-k, 0)),
            "_v": F.collect_list(from_end).over(w.rowsBetween(0, k)),
        }
    )
    rows = own_rows(rows)
    t, n = F.col("frame"), F.col("n_frames")
    first = F.greatest(F.lit(0), t - k)
    # Windows that cover this frame: those starting at first .. last.
    last = F.least(t, n - n_window)
    count = (last - first + 1).cast("int")
    cut = lambda array, at: F.slice(array, at.cast("int"), count)
    weights = F.array(*[F.lit(v) for v in reversed(_blend_weights(n_window))])
    return rows.select(
        *STEP, "_Fx", "_Fy", "_Rx", "_Ry",
        first.alias("_first"),
        cut(F.col("_u"), F.lit(1)).alias("_u"),
        cut(F.col("_v"), first + k - t + 1).alias("_v"),
        cut(weights, k - (t - first) + 1).alias("_w"),
    )


def _per_window(axis: str) -> Column:
    """Blended coordinate of the current frame in every window that covers it."""
    ends = F.zip_with("_u", "_v", lambda u, v: F.struct(u[axis].alias("u"), v[axis].alias("v")))
    return F.zip_with(
        ends,
        "_w",
        lambda p, w: w * (p["u"] + F.col(f"_F{axis}")) + (F.lit(1.0) - w) * (p["v"] + F.col(f"_R{axis}")),
    )


def smooth_moving_average(
    points: DataFrame,
    flow: DataFrame,
    videos: DataFrame,
    *,
    n_window: int,
    strict: bool = False,
    block: int | None = BLOCK,
) -> DataFrame:
    """Average of the blended paths of all windows that cover a frame.

    Every window of ``n_window`` frames is anchored at its first and last
    point. Labels with holes are left out; `smoothing_coverage` names them.
    ``strict`` raises at once if no label at all is complete. Points and flow
    of a block are read once, together; the same pass counts what a label lacks.
    """
    if strict and not smoothing_coverage(points, flow, videos).where(F.col("reason").isNull()).head(1):
        raise ValueError("no label covers all frames of its video")
    if n_window < 2:
        raise ValueError("a smoothing window needs at least two frames")
    k, block = n_window - 1, block or ONE_BLOCK
    ahead = np.array(_blend_weights(n_window))
    rows = with_halo(points.select(*STEP, "x", "y", *layout_columns(points)), before=k, after=k, block=block)
    steps = with_halo(flow.select(*STEP, *STEPS, *layout_columns(flow)), before=k, after=k, block=block)
    # The length of a video, for each of its blocks.
    ends = videos.where("n_frames > 0").select("video", "n_frames").withColumn(
        BLK, F.explode(F.sequence(F.lit(0).cast("long"), block_of(F.col("n_frames") - 1, block)))
    )
    kept = layout_of(rows)
    rows = rows.join(ends, ["video", BLK])
    if kept is not None:
        rows = rows.withMetadata(BLK, {"block": kept[0], "context": kept[1]})

    def average(key: tuple, points_: pa.Table, steps_: pa.Table) -> pa.Table:
        """The averages of a block's own frames, and a row that counts its points and steps."""
        video, label, blk = (k_.as_py() for k_ in key)
        if not len(points_):
            return SMOOTHED.empty_table()
        n = points_.column("n_frames")[0].as_py()
        low, high = max(0, blk * block - k), min(n, (blk + 1) * block + k) - 1
        own = slice(blk * block - low, min(n, (blk + 1) * block) - low)
        frames = np.arange(low, high + 1)

        def line(table: pa.Table, name: str) -> np.ndarray:
            at = table.column("frame").to_numpy()
            out, use = np.full(len(frames), np.nan), (at >= low) & (at <= high)
            out[at[use] - low] = table.column(name).to_numpy()[use]
            return out

        x, y = line(points_, "x"), line(points_, "y")
        fx, fy, rx, ry = (line(steps_, c) for c in STEPS)
        point = ~np.isnan(x) & ~np.isnan(y)
        forth, back = ~np.isnan(fx) & ~np.isnan(fy) & (frames > 0), ~np.isnan(rx) & ~np.isnan(ry) & (frames < n - 1)
        counts = [int(c[own].sum()) for c in (point, forth, back)]
        fill = lambda value, size: pa.array([value] * size)
        named = lambda size: [fill(video, size).cast(pa.string()), fill(label, size).cast(pa.string()), fill(blk, size).cast(pa.int64())]
        summary = pa.Table.from_arrays(
            [*named(1), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), *[pa.array([c]) for c in (*counts, n)]], schema=SMOOTHED
        )
        if len(frames) < n_window or not (point.all() and forth[1:].all() and back[:-1].all()):
            return summary
        ones = np.ones(len(frames) - k)
        share, rest = np.convolve(ones, ahead), np.convolve(ones, 1.0 - ahead)
        smooth = []
        for at, forward, backward in ((x, fx, rx), (y, fy, ry)):
            # Sums of steps up to each frame; only their differences count.
            fwd = np.cumsum(np.where(np.isnan(forward), 0.0, forward))
            rev = np.where(np.isnan(backward), 0.0, backward)
            rev = rev - np.cumsum(rev)
            total = np.convolve((at - fwd)[: len(ones)], ahead) + np.convolve((at - rev)[k:], 1.0 - ahead)
            smooth.append(pa.array(((total + fwd * share + rev * rest) / (share + rest))[own]))
        size = len(smooth[0])
        done = pa.Table.from_arrays([*named(size), pa.array(frames[own]), *smooth, *[pa.nulls(size, pa.int64())] * 4], schema=SMOOTHED)
        return pa.concat_tables([summary, done])

    schema = f"video string, label string, {BLK} long, frame long, x double, y double, n_points long, n_fwd long, n_rev long, n_frames long"
    done = settle(meet_blocks(rows, steps, average, schema, keys=TRACE))
    counted = done.where("frame is null")
    whole = counted.groupBy(*TRACE).agg(*[F.sum(c).alias(c) for c in ("n_points", "n_fwd", "n_rev")], F.first("n_frames").alias("n_frames"))
    whole = whole.where(f"n_points = n_frames AND n_fwd >= n_frames - 1 AND n_rev >= n_frames - 1 AND n_frames >= {n_window}")
    whole = counted.select(*TRACE, BLK).join(whole.select(*TRACE), list(TRACE))
    return done.where("frame is not null").join(whole, [*TRACE, BLK]).select(*STEP, "x", "y")


def moving_average_windows(
    points: DataFrame, flow: DataFrame, videos: DataFrame, *, n_window: int, block: int | None = BLOCK
) -> DataFrame:
    """The blended path of every single window, before averaging."""
    rows = _windowed(points, flow, videos, n_window, block)
    pairs = F.arrays_zip(_per_window("x").alias("x"), _per_window("y").alias("y"))
    return rows.select(*STEP, "_first", F.posexplode(pairs)).select(
        *STEP, (F.col("_first") + F.col("pos")).alias("window_start"), "col.x", "col.y"
    )


def decimate_intervals(points: DataFrame, intervals: DataFrame, *, block: int | None = BLOCK) -> DataFrame:
    """Inside the intervals, drop incomplete frames, then every second frame left.

    ``intervals``: (video, start, end), not overlapping. All labels go together.
    """
    inside = in_intervals(points, intervals, ["video"])
    bad = incomplete_frames(points).select(*LAYER, "frame")
    frames = inside.select(*LAYER, "frame").distinct().join(bad, [*LAYER, "frame"], "left_anti")
    blk = lambda c: F.floor(F.col(c) / 1024).cast("long")
    spans = intervals.select("video", "start", "end").distinct().withColumn(
        "_ib", F.explode(F.sequence(blk("start"), blk("end")))
    )
    frames = frames.withColumn("_ib", blk("frame")).join(spans, ["video", "_ib"]).where(
        F.col("frame").between(F.col("start"), F.col("end"))
    )
    order = scan(frames.drop("_ib"), [*LAYER, "start", "end"], {"_n": ("sum", F.lit(1))}, block=block)
    keep = order.where(F.col("_n") % 2 == 1).select(*LAYER, "frame")
    outside = _interval_join(points, intervals.select("video", "start", "end"), ["video"], "left_anti")
    return outside.unionByName(inside.join(keep, [*LAYER, "frame"], "left_semi"))


def lowpass_taps(period: int) -> list[float]:
    """Hann-windowed sinc of ``2 * period + 1`` taps, cut off at ``1 / period``, unit gain at zero."""
    cutoff = 2.0 / period
    taps = []
    for i in range(-period, period + 1):
        arg = math.pi * cutoff * i
        sinc = 1.0 if i == 0 else math.sin(arg) / arg
        taps.append(cutoff * sinc * 0.5 * (1.0 + math.cos(math.pi * i / period)))
    gain = sum(taps)
    return [t / gain for t in taps]


def _lowpassed(points: DataFrame, spans: DataFrame, reach: int, block: int | None) -> DataFrame:
    """The filtered points of the intervals, each with its own ``period`` of ``reach`` frames at most, in one pass."""
    block = block or ONE_BLOCK
    here = F.struct("frame", "x", "y")
    known = plain_rows(points).where(F.col("x").isNotNull()).select(*STEP, "x", "y")
    # A gap may be longer than any context, so points know their neighbours.
    known = scan(known, TRACE, {"_b": ("prev", here), "_a": ("next", here)}, block=block)
    rows = with_halo(known, before=reach, after=reach, block=block)
    first, last = F.col("start") - F.col("period"), F.col("end") + F.col("period")
    spans = spans.select(*RUN, "period").distinct().withColumn(BLK, F.explode(F.sequence(block_of(first, block), block_of(last, block))))

    def smoothed(key: tuple, points_: pa.Table, spans_: pa.Table) -> pa.Table:
        """Filtered points of a block, and for each interval how many points the block has in its reach."""
        video, label, blk = (k.as_py() for k in key)
        points_ = points_.sort_by("frame")
        at = points_.column("frame").to_numpy()
        parts = [PASSED.empty_table()]
        for span in spans_.to_pylist():
            start, end, period = span["start"], span["end"], span["period"]
            lows, highs = max(start - period, blk * block), min(end + period, (blk + 1) * block - 1)
            known_here = int(np.searchsorted(at, highs, "right") - np.searchsorted(at, lows))
            if not known_here:
                continue
            head = {"video": video, "label": label, "start": start, "end": end, BLK: blk}
            parts.append(pa.Table.from_pylist([{**head, "frame": None, "x": None, "y": None, "n_near": known_here}], schema=PASSED))
            low, high = max(start - period, blk * block - period), min(end + period, (blk + 1) * block - 1 + period)
            i, j = int(np.searchsorted(at, low)), int(np.searchsorted(at, high, "right"))
            i0, j0 = int(np.searchsorted(at, max(start, blk * block))), int(np.searchsorted(at, min(end, (blk + 1) * block - 1), "right"))
            if i0 >= j0:
                continue
            before, after = points_.column("_b")[i].as_py(), points_.column("_a")[j - 1].as_py()
            before = before if before and before["frame"] >= start - period else None
            after = after if after and after["frame"] <= end + period else None
            frames, own = np.arange(low, high + 1), at[i0:j0]
            anchors = [*([before["frame"]] if before else []), *at[i:j], *([after["frame"]] if after else [])]
            n = end - start + 1
            ramp = min(n // 4, max(3, min(period // 3, 20)))
            rise = lambda k, ramp=ramp: 0.5 * (1.0 - np.cos(np.pi * (k + 1) / (ramp + 1)))
            step = own - start
            # The rear ramp is written last, so it wins should both ramps meet.
            weight = np.where(step >= n - ramp, rise(n - 1 - step), np.where(step < ramp, rise(step), 1.0))
            taps, new = np.array(lowpass_taps(period)), []
            for c in ("x", "y"):
                given = points_.column(c).to_numpy()
                values = [*([before[c]] if before else []), *given[i:j], *([after[c]] if after else [])]
                line = np.convolve(np.interp(frames, anchors, values), taps)[period : period + len(frames)]
                new.append(given[i0:j0] + weight * (line[own - low] - given[i0:j0]))
            columns = [pa.array([head[f.name]] * len(own), f.type) for f in PASSED if f.name in head]
            parts.append(pa.Table.from_arrays([*columns, pa.array(own), *map(pa.array, new), pa.nulls(len(own), pa.int64())], schema=PASSED))
        return pa.concat_tables(parts)

    schema = f"video string, label string, start long, end long, {BLK} long, frame long, x double, y double, n_near long"
    found = settle(meet_blocks(rows, spans, smoothed, schema, keys=TRACE))
    counted = found.where("frame is null")
    enough = counted.groupBy(*RUN).agg(F.sum("n_near").alias("n")).where(F.col("n") >= MIN_CONTEXT_POINTS)
    enough = counted.select(*RUN, BLK).join(enough.select(*RUN), RUN)
    found = found.where("frame is not null").join(enough, [*RUN, BLK])
    return found.select(*STEP, F.col("x").alias("_x"), F.col("y").alias("_y"))


def _overwrite(points: DataFrame, new: DataFrame) -> DataFrame:
    out = points.join(new, STEP, "left")
    return out.withColumns({"x": F.coalesce("_x", "x"), "y": F.coalesce("_y", "y")}).select(*points.columns)


def lowpass_intervals(
    points: DataFrame, intervals: DataFrame, *, period: int, block: int | None = BLOCK
) -> DataFrame:
    """Low-pass the points inside each interval, faded in and out at its ends.

    ``points`` and ``intervals`` carry (video, label). Gaps are bridged for the
    filter only; frames without a point stay without one. Intervals with fewer
    than 8 points in reach are left alone. Intervals of one label must not overlap.
    """
    spans = intervals.withColumn("period", F.lit(period).cast("long"))
    return _overwrite(points, _lowpassed(points, spans, period, block))


def lowpass_level(
    points: DataFrame, intervals: DataFrame, *, level: int, block: int | None = BLOCK
) -> DataFrame:
    """Low-pass at a level of the ladder; short intervals get the highest one they allow.

    Every level starts from the given points.
    """
    length = F.col("end") - F.col("start") + 1
    top = F.greatest(F.lit(1), F.size(F.filter(F.array(*[F.lit(p) for p in LADDER]), lambda p: p * 2 <= length)))
    if level < 1:
        return points
    level = min(level, len(LADDER))
    period = F.element_at(F.array(*[F.lit(p).cast("long") for p in LADDER]), F.least(top, F.lit(level)).cast("int"))
    spans = intervals.withColumn("period", period)
    return _overwrite(points, _lowpassed(points, spans, LADDER[level - 1], block))


def polygon_areas(
    points: DataFrame, labels: str | Sequence[str], *, lowpass: int | None = None, by: Sequence[str] = ("video",)
) -> DataFrame:
    """Area of the polygon through the labels in the given order, per frame.

    ``"023"`` stands for labels 0, 2, 3. NULL where a corner is missing.
    ``lowpass`` smooths all points with that filter period first.
    """
    order = list(labels)
    pts = points.where(F.col("label").isin(order))
    if lowpass is not None:
        whole = pts.groupBy(*TRACE).agg(F.min("frame").alias("start"), F.max("frame").alias("end"))
        pts = lowpass_intervals(pts, whole, period=lowpass)
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("label"))
    corner = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct(pos.alias("pos"), "x", "y"))
    # One frame holds at most one row per label.
    frames = pts.groupBy(*by, "frame").agg(F.array_sort(F.collect_list(corner)).alias("_c"))
    area = F.when(F.size("_c") == len(order), polygon_area("_c"))
    return frames.select(*by, "frame", area.alias("area"))
