"""Choosing training frames under budgets."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.functions.blocks import (
    BLK, BLOCK, apply_groups, block_of, scan, top_per_group,
)
from trackspark.functions.intervals import inside
from trackspark.operators.detect import HIGH, LOW, disagreement_blips, low_confidence_frames
from trackspark.operators.flow import flow_layer
from trackspark.operators.layers import _complete_frames
from trackspark.schema import LAYER, TRACE
from trackspark.session import settle

STEP = [*TRACE, "frame"]


def is_even_pick(pos: str, n: str, share: Column) -> Column:
    """Is row ``pos`` of ``n`` one of ``share`` evenly spaced picks?

    Picks lie at ``i * (n-1) / (share-1)`` rounded half to even. Only the two
    or three picks closest to the row are tested.
    """
    pos, n = F.col(pos), F.col(n)
    step = (n - 1) / F.greatest(share - 1, F.lit(1))
    guess = F.round(pos / F.greatest(step, F.lit(1e-9))).cast("long")
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        i = guess + shift
        at = F.when(i == share - 1, n - 1).otherwise(F.bround(i * step).cast("long"))
        hit = hit | (i.between(0, share - 1) & (at == pos))
    return F.when(n <= share, True).when(share == 1, pos == 0).otherwise(hit)


def _ranked(df: DataFrame, keys: list[str], order: str, block: int) -> DataFrame:
    """Zero-based position and group size along ``order``, without a join."""
    one = F.lit(1).cast("long")
    out = scan(df, keys, {"_up": ("sum", one), "_down": ("rsum", one)}, order=order, block=block)
    return out.withColumns({"_pos": F.col("_up") - 1, "_n": F.col("_up") + F.col("_down") - 1}).drop("_up", "_down")


def sample_gaps(gaps: DataFrame, max_gaps: int, *, block: int | None = BLOCK) -> DataFrame:
    """At most about ``max_gaps`` gaps per video, spread evenly over each label."""
    per_label = gaps.groupBy(*TRACE).agg(F.count(F.lit(1)).alias("_c"))
    totals = per_label.groupBy("video").agg(
        F.sum("_c").alias("_total"), F.count(F.lit(1)).alias("_labels")
    )
    ranked = _ranked(gaps, list(TRACE), "start", block).join(totals, "video")
    share = F.greatest(F.lit(1), F.floor(F.lit(max_gaps) / F.col("_labels"))).cast("long")
    keep = (F.col("_total") <= max_gaps) | is_even_pick("_pos", "_n", share)
    return ranked.where(keep).select(*gaps.columns)


# --- greedy spacing along frames ------------------------------------------------

def _fold(frames: Sequence[int], spacing: int, last: float) -> tuple[list[int], float]:
    """Positions kept by the walk over ascending frames, and the last kept frame."""
    at = np.asarray(frames)
    keep: list[int] = []
    k = int(np.searchsorted(at, last + spacing))
    while k < len(at):
        keep.append(k)
        last = int(at[k])
        k = int(np.searchsorted(at, last + spacing))
    return keep, last


def spaced_frames(
    df: DataFrame, spacing: int, *, keys: tuple[str, ...] = TRACE, block: int | None = BLOCK
) -> DataFrame:
    """Walk along each trace and keep a row if it is ``spacing`` frames after the last kept one.

    A block can only be influenced by how far before its start the last kept
    frame lies, which is one of ``spacing`` cases. Blocks are folded for every
    case in parallel, the cases are chained over the blocks of a trace, and
    each block is folded once more with its true start. Frames are unique per
    trace.
    """
    keys = list(keys)
    spacing = max(1, spacing)
    far = float("-inf")
    key_fields = [f for f in df.schema if f.name in keys]
    columns = df.columns

    def final(rows_: pa.Table) -> pa.Table:
        rows_ = rows_.sort_by("frame")
        last = rows_.column("_last")[0].as_py() if "_last" in rows_.column_names else None
        keep, _ = _fold(rows_.column("frame").to_pylist(), spacing, far if last is None else last)
        return rows_.select(columns).take(pa.array(keep, pa.int64()))

    if block is None:
        return apply_groups(df, keys, final, df.schema)

    def cases(rows_: pa.Table) -> pa.Table:
        frames = sorted(rows_.column("frame").to_pylist())
        start = rows_.column(BLK)[0].as_py() * block
        ends = [_fold(frames, spacing, far if d == spacing else start - d)[1] for d in range(1, spacing + 1)]
        # A case that keeps nothing leaves the earlier frame standing.
        ends = [None if e < start else int(e) for e in ends]
        return rows_.select([*keys, BLK]).slice(0, 1).append_column("_ends", pa.array([ends], pa.list_(pa.int64())))

    def chain(rows_: pa.Table) -> pa.Table:
        rows_ = rows_.sort_by(BLK)
        last, seen = None, []
        for blk, ends in zip(rows_.column(BLK).to_pylist(), rows_.column("_ends").to_pylist()):
            seen.append(last)
            gap = spacing if last is None else min(spacing, blk * block - last)
            last = last if ends[gap - 1] is None else ends[gap - 1]
        return rows_.select([*keys, BLK]).append_column("_last", pa.array(seen, pa.int64()))

    blk, last = T.StructField(BLK, T.LongType()), T.StructField("_last", T.LongType())
    ends = T.StructField("_ends", T.ArrayType(T.LongType()))
    rows = df.withColumn(BLK, block_of("frame", block))
    folded = apply_groups(rows.select(*keys, BLK, "frame"), [*keys, BLK], cases, T.StructType([*key_fields, blk, ends]))
    # One row per block of a trace.
    starts = apply_groups(folded, keys, chain, T.StructType([*key_fields, blk, last]))
    return apply_groups(rows.join(starts, [*keys, BLK]), [*keys, BLK], final, df.schema)


def select_training_frames(
    repaired: DataFrame,
    *,
    max_disagreement: float = 2.0,
    per_gap: int = 2,
    max_frames: int | None = 150,
    min_spacing: int = 10,
    block: int | None = BLOCK,
) -> DataFrame:
    """Trusted repaired frames: a few per gap, spaced apart, capped per video.

    ``repaired``: (video, label, start, end, frame, x, y, disagreement).
    """
    trusted = repaired.where(F.col("disagreement") <= max_disagreement)
    in_gap = _ranked(trusted, [*TRACE, "start", "end"], "frame", block)
    picks = in_gap.where(is_even_pick("_pos", "_n", F.lit(per_gap).cast("long"))).drop("_pos", "_n")
    kept = spaced_frames(picks.select(*STEP, "x", "y", "disagreement"), min_spacing, block=block)
    if max_frames is None:
        return kept
    # A few frames per gap, read for the totals and for the ranks.
    kept = settle(kept)
    ranked = _ranked(kept, list(TRACE), "frame", block)
    totals = kept.groupBy("video").agg(F.count(F.lit(1)).alias("_total"))
    ranked = ranked.join(totals, "video")
    share = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(max_frames) / F.col("_total"))).cast("long")
    keep = (F.col("_total") <= max_frames) | is_even_pick("_pos", "_n", share)
    return ranked.where(keep).select(*STEP, "x", "y", "disagreement")


# --- greedy choice across videos --------------------------------------------------

def _free(near: list[int], frame: int, spacing: int) -> bool:
    """Whether a sorted list of frames has none closer than ``spacing``; the frame is put in if so."""
    k = bisect.bisect_left(near, frame)
    if (k and frame - near[k - 1] < spacing) or (k < len(near) and near[k] - frame < spacing):
        return False
    near.insert(k, frame)
    return True


def _greedy(rows_: pa.Table, spacing: int, cap: int) -> pa.Table:
    """The best ``cap`` rows by rank that keep their distance; rows flagged ``_kept`` stand beforehand and count."""
    fixed = rows_.filter(pc.field("_kept")).select(STEP).to_pylist()
    near: dict[tuple, list[int]] = {}
    for r in fixed:
        bisect.insort(near.setdefault((r["video"], r["label"]), []), r["frame"])
    open_ = rows_.filter(~pc.field("_kept")).sort_by("_rank")
    room = max(0, cap - len(fixed))
    fits = (
        i for i, r in enumerate(open_.select(STEP).to_pylist())
        if _free(near.setdefault((r["video"], r["label"]), []), r["frame"], spacing)
    )
    return open_.take(pa.array(list(itertools.islice(fits, room)), pa.int64()))


def _select_ranked(
    pool: DataFrame, score: str, *, largest: bool, n: int, n_videos: int, spacing: int, cap: int | None
) -> DataFrame:
    spacing = max(1, spacing)
    cap = cap or math.ceil(n / n_videos)
    way = (lambda c: F.col(c).desc()) if largest else (lambda c: F.col(c).asc())
    order = [way(c) for c in (score, "video", "label", "frame")]
    shaped = pool.select(*STEP, "x", "y", F.col(score).cast("double").alias(score))
    front = top_per_group(shaped, ["video"], order, cap * _reach(spacing), salt_on=STEP, name="_rank")
    columns = shaped.columns
    capped = apply_groups(
        front.withColumn("_kept", F.lit(False)), ["video"], lambda rows_: _greedy(rows_, spacing, cap).select(columns), shaped.schema
    )
    # At most n rows, read for the answer and as the start of the second walk.
    first = settle(capped.orderBy(*order).limit(n))
    room = n - first.count()
    return first if room <= 0 else first.unionByName(_fill(shaped, first, score, order, largest, room, spacing, cap))


def _reach(spacing: int) -> int:
    """Rows that a pick rules out at most, itself included: a walk to k picks never looks beyond k times that many."""
    return 2 * spacing - 1


def _offers(spacing: int, most: int, columns: list[str]):
    def walk(rows_: pa.Table) -> pa.Table:
        return _greedy(rows_, spacing, rows_.filter(pc.field("_kept")).num_rows + most).select(columns)

    return walk


#: Picks a trace may offer at first for the room that is left.
OFFERED = 16


def _fill(
    shaped: DataFrame, first: DataFrame, score: str, order: list[Column], largest: bool, room: int, spacing: int, cap: int
) -> DataFrame:
    """The best ``room`` rows of any video that keep their distance to each other and to the rows of ``first``.

    Only rows of one trace rule each other out, so every trace walks by itself and the best offers of all are taken. A trace
    offers a few picks; only one whose whole offer was taken may hold more that belong among the best, so just those
    traces walk again with a longer offer, until no offer was taken whole. No group holds more than one trace's best rows.
    """
    columns, offer = shaped.columns, OFFERED
    place = F.struct(score, *STEP)
    worst = F.min if largest else F.max
    kept = first.withColumns({"_rank": F.lit(0), "_kept": F.lit(True)})
    todo = shaped.join(first.select(*STEP), STEP, "left_anti")
    done = None
    while True:
        # The caps bound how many rows of a trace stand already.
        rows = top_per_group(todo, TRACE, order, (offer + cap) * _reach(spacing), salt_on=["frame"], name="_rank")
        standing = kept if done is None else kept.join(again, list(TRACE), "left_semi")
        rows = rows.withColumn("_kept", F.lit(False)).unionByName(standing.select(*columns, "_rank", "_kept"))
        offers = apply_groups(rows, TRACE, _offers(spacing, offer, columns), shaped.schema)
        if done is not None:
            offers = offers.unionByName(done.join(again, list(TRACE), "left_anti"))
        done = settle(offers)
        best = done.orderBy(*order).limit(room)
        cut = best.agg(worst(place).alias("p"), F.count(F.lit(1)).alias("n")).select("p.*", "n").first()
        per_trace = done.groupBy(*TRACE).agg(F.count(F.lit(1)).alias("_n"), worst(place).alias("_last"))
        whole = F.col("_n") >= offer
        if cut["n"] == room:
            last = F.struct(*[F.lit(cut[c]).cast(shaped.schema[c].dataType) for c in (score, *STEP)])
            whole = whole & ((F.col("_last") >= last) if largest else (F.col("_last") <= last))
        again = settle(per_trace.where(whole).select(*TRACE))
        if again.isEmpty():
            return best
        offer *= 4
        todo = shaped.join(again, list(TRACE), "left_semi").join(first.select(*STEP), STEP, "left_anti")


def select_across_videos(
    repaired: DataFrame,
    *,
    n: int = 20,
    max_disagreement: float = 4.0,
    min_spacing: int = 10,
    per_video_cap: int | None = None,
    n_videos: int | None = None,
) -> DataFrame:
    """The ``n`` most trusted repaired frames, spread over videos and frames.

    A video gives at most its share first; what others leave is then filled
    from any video. ``(video, label, frame)`` must be unique.
    """
    if n_videos is None:
        n_videos = repaired.select("video").distinct().count()
    pool = repaired.where(F.col("disagreement") <= max_disagreement)
    return _select_ranked(
        pool, "disagreement", largest=False, n=n, n_videos=max(1, n_videos), spacing=min_spacing, cap=per_video_cap
    )


def select_flow_blips(
    residuals: DataFrame,
    *,
    n: int = 20,
    min_residual: float = 0.0,
    min_spacing: int = 10,
    per_video_cap: int | None = None,
    n_videos: int | None = None,
) -> DataFrame:
    """The ``n`` worst residuals, chosen as in `select_across_videos`."""
    if n_videos is None:
        n_videos = residuals.select("video").distinct().count()
    pool = residuals.where(F.col("residual") >= min_residual)
    return _select_ranked(
        pool, "residual", largest=True, n=n, n_videos=max(1, n_videos), spacing=min_spacing, cap=per_video_cap
    )


# --- sources of candidate frames ----------------------------------------------------

def error_frames(
    predictions: DataFrame,
    flow: DataFrame,
    *,
    kinds: tuple[str, ...] = ("low_confidence", "blip"),
    threshold: float = LOW,
    max_frames: int = 200,
    high: float = HIGH,
    **blip_params,
) -> DataFrame:
    """Frames the model gets wrong, with a position for every label.

    Low-confidence frames carry the model's points. Blip frames count where the
    blipped label is confident and carry the flow's point for that label. A
    frame that is both comes once, as a blip frame.
    """
    labels = predictions.select("video", "label").distinct()
    model = predictions.select(*STEP, F.col("x").alias("mx"), F.col("y").alias("my"))
    parts = []
    if "low_confidence" in kinds:
        low = low_confidence_frames(predictions, threshold, max_frames=max_frames).select("video", "frame")
        parts.append(
            low.join(labels, "video").join(model, STEP, "left").select(
                *STEP, F.col("mx").alias("x"), F.col("my").alias("y"), F.lit("low_confidence").alias("kind")
            )
        )
    if "blip" in kinds:
        landed = flow_layer(predictions, flow)
        sure = predictions.where(F.col("likelihood") >= high).select(*STEP)
        flagged = inside(sure, disagreement_blips(predictions, landed, **blip_params)).distinct()
        at = landed.select(*STEP, F.struct("x", "y").alias("_f"))
        fixed = flagged.join(at, STEP, "left").select(*STEP, F.lit(True).alias("_hit"), "_f")
        spine = flagged.select("video", "frame").distinct().join(labels, "video")
        rows = spine.join(model, STEP, "left").join(fixed, STEP, "left")
        pick = lambda c, m: F.when(F.col("_hit"), F.coalesce(F.col(f"_f.{c}"), F.col(m))).otherwise(F.col(m))
        parts.append(
            rows.select(*STEP, pick("x", "mx").alias("x"), pick("y", "my").alias("y"), F.lit("blip").alias("kind"))
        )
    if not parts:
        raise ValueError("no kind of error frames asked for")
    if len(parts) == 1:
        return parts[0]
    low, blip = parts
    return low.join(blip.select("video", "frame").distinct(), ["video", "frame"], "left_anti").unionByName(blip)


def union_sources(*sources: DataFrame, min_rows: int = 8) -> DataFrame:
    """Candidate frames of several sources; the first source wins per frame.

    Each source: (video, image, frame, ...). Rows with a NULL frame match on
    the image alone. Fewer than ``min_rows`` frames give an empty result.
    """
    ranked = None
    for i, source in enumerate(sources):
        part = source.withColumn("_prio", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part)
    columns = [c for c in ranked.columns if c not in ("video", "image", "frame", "_prio")]
    best = ranked.groupBy("video", "image", "frame").agg(F.min_by(F.struct("_prio", *columns), "_prio").alias("_b"))
    best = settle(best.select("video", "image", "frame", *[F.col(f"_b.{c}").alias(c) for c in columns]).select(*sources[0].columns))
    return best if best.limit(min_rows).count() >= min_rows else best.where("false")


def complete_frame_entries(points: DataFrame, declared: DataFrame) -> DataFrame:
    """Frames where all declared labels exist, with all positions in label order."""
    keep = _complete_frames(points, declared)
    rows = points.join(declared.select(*LAYER, "label"), [*LAYER, "label"], "left_semi").join(
        keep, [*LAYER, "frame"], "left_semi"
    )
    entry = F.struct(F.col("label").cast("int").alias("n"), "label", "x", "y")
    return rows.groupBy(*LAYER, "frame").agg(F.array_sort(F.collect_list(entry)).alias("_e")).select(
        *LAYER, "frame", F.transform("_e", lambda e: F.struct(e["label"], e["x"], e["y"])).alias("points")
    )


def free_layer_name(layers: DataFrame, base: str) -> DataFrame:
    """Per video the first unused name among ``base``, ``base2``, ``base3``, ..."""
    number = F.when(F.col("layer") == base, 1).when(
        F.col("layer").rlike(f"^{base}[0-9]+$"), F.substring(F.col("layer"), len(base) + 1, 1 << 30).try_cast("long")
    )
    used = layers.select("video", number.alias("_n")).groupBy("video").agg(F.collect_set("_n").alias("_u"))
    # Among the first size+1 numbers one is always free.
    free = F.array_min(F.array_except(F.sequence(F.lit(1).cast("long"), F.size("_u").cast("long") + 1), "_u"))
    return used.select(
        "video", F.when(free == 1, F.lit(base)).otherwise(F.concat(F.lit(base), free.cast("string"))).alias("layer")
    )


def materialize_selection(points: DataFrame, kept: DataFrame, layers: DataFrame, source: str) -> DataFrame:
    """The kept frames (video, frame) of a layer as a new layer; the source stays."""
    chosen = points.where(F.col("layer") == source).join(
        kept.select("video", "frame").distinct(), ["video", "frame"], "left_semi"
    )
    name = free_layer_name(layers, f"{source}_diverse")
    return chosen.drop("layer").join(name, "video").select("video", "layer", "label", "frame", "x", "y")

