"""Queries over uncertain stretches and outliers."""

import uuid

from pyspark.sql import functions as F

from trackspark.catalog.base import BLIPS, EVENTS, FLOW, LINES, query
from trackspark.functions.blocks import plain_rows
from trackspark.operators import detect, flow, runs
from trackspark.session import settle
from trackspark.sources import adapters as src
from trackspark.sources.layout import store_blocks

RUNS = """
conf AS (SELECT *, coalesce(likelihood >= 0.9, false) AS ok,
           row_number() OVER (PARTITION BY video, label ORDER BY frame) - 1 AS pos FROM {t}),
ctx AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS by_, lead(x) OVER w AS nx_, lead(y) OVER w AS ny_,
           coalesce(sum(CAST(ok AS INT)) OVER (w ROWS BETWEEN {bracket} PRECEDING AND 1 PRECEDING), 0) AS ok_b,
           coalesce(sum(CAST(ok AS INT)) OVER (w ROWS BETWEEN 1 FOLLOWING AND {bracket} FOLLOWING), 0) AS ok_a,
           count(*) OVER (PARTITION BY video, label) AS n
         FROM conf WINDOW w AS (PARTITION BY video, label ORDER BY pos)),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY video, label ORDER BY pos) AS g FROM ctx WHERE NOT ok),
urun AS (SELECT video, label, min(frame) AS "start", max(frame) AS "end", count(*) AS length,
           min(pos) AS s, max(pos) AS e, max(n) AS n, min(likelihood) AS min_likelihood,
           arg_min(bx, pos) AS ax0, arg_min(by_, pos) AS ay0, arg_max(nx_, pos) AS ax1, arg_max(ny_, pos) AS ay1,
           arg_min(ok_b, pos) AS ok_b, arg_max(ok_a, pos) AS ok_a
         FROM isl GROUP BY video, label, g),
judged AS (SELECT *, CASE WHEN min_likelihood > 0.6 THEN 'not_severe'
             WHEN length > {max_gap} THEN 'too_long'
             WHEN s - {bracket} < 0 OR e + {bracket} >= n THEN 'at_video_edge'
             WHEN ok_b < {bracket} OR ok_a < {bracket} THEN 'bracket_too_short' END AS reason FROM urun)
"""
GAPS = EVENTS + "," + RUNS.format(t="pred", max_gap=2, bracket=5)
GAP_COLUMNS = """video, label, "start", "end", length, round(ax0, 6) AS ax0, round(ay0, 6) AS ay0,
    round(ax1, 6) AS ax1, round(ay1, 6) AS ay1"""


@query(
    f"WITH {GAPS} SELECT {GAP_COLUMNS}, round(min_likelihood, 6) AS min_likelihood FROM judged WHERE reason IS NULL"
)
def find_gaps(spark, d):
    return detect.find_gaps(src.predictions(spark, d), max_gap=2, dense=True, block=src.event_block(spark, d))


@query(
    f"""WITH {LINES}, {RUNS.format(t="lines", max_gap=12, bracket=1)}
    SELECT {GAP_COLUMNS}, round(min_likelihood, 6) AS min_likelihood FROM judged WHERE reason IS NULL"""
)
def find_gaps_long_tracks(spark, d):
    return detect.find_gaps(src.line_tracks(spark, d), bracket=1, max_gap=12, block=src.line_block(spark, d))


@query(f"""WITH {GAPS} SELECT video, label, "start", "end", length, reason FROM judged WHERE reason IS NOT NULL""")
def rejected_runs(spark, d):
    return detect.rejected_runs(src.predictions(spark, d), max_gap=2, dense=True, block=src.event_block(spark, d))


@query(
    f"""WITH {GAPS} SELECT video, reason, count(*) AS n_runs, CAST(sum(length) AS BIGINT) AS n_frames
    FROM judged WHERE reason IS NOT NULL GROUP BY video, reason"""
)
def rejected_summary(spark, d):
    return detect.rejected_summary(detect.uncertain_runs(src.predictions(spark, d), max_gap=2, dense=True, block=src.event_block(spark, d)))


@query(
    f"""WITH {GAPS},
    a AS (SELECT video, label, count(*) FILTER (likelihood <= 0.6) AS n_low,
            count(*) FILTER (NOT coalesce(likelihood >= 0.9, false)) AS n_unconfident,
            avg(likelihood) AS mean_likelihood FROM pred GROUP BY video, label),
    b AS (SELECT video, label, count(*) AS n_runs, count(*) FILTER (reason IS NULL) AS n_gaps,
            CAST(coalesce(sum(length) FILTER (reason IS NULL), 0) AS BIGINT) AS n_gap_frames FROM judged GROUP BY video, label)
    SELECT a.video, a.label, n_low, n_unconfident, round(mean_likelihood, 6) AS mean_likelihood,
      coalesce(n_runs, 0) AS n_runs, coalesce(n_gaps, 0) AS n_gaps, coalesce(n_gap_frames, 0) AS n_gap_frames
    FROM a LEFT JOIN b ON a.video = b.video AND a.label = b.label"""
)
def gap_label_stats(spark, d):
    return detect.gap_label_stats(src.predictions(spark, d), max_gap=2, dense=True, block=src.event_block(spark, d))


@query(
    f"""WITH {EVENTS},
    h AS (SELECT *, frame - lag(frame) OVER (PARTITION BY video, label ORDER BY frame) - 1 AS gap FROM pred WHERE likelihood < 0.9),
    g AS (SELECT *, sum(CASE WHEN gap <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY video, label ORDER BY frame) AS g FROM h)
    SELECT video, label, min(frame) AS "start", max(frame) AS "end", max(frame) - min(frame) + 1 AS length,
      count(*) AS n_hits FROM g GROUP BY video, label, g"""
)
def runs_with_gap(spark, d):
    return runs.runs(src.predictions(spark, d).where(F.col("likelihood") < 0.9), max_gap=2, block=src.event_block(spark, d))


THRESHOLDS = f"""WITH {BLIPS} SELECT video, label, n, round(med, 6) AS med, round(mad, 6) AS mad,
    round(threshold, 6) AS threshold FROM thr"""


@query(THRESHOLDS)
def robust_threshold(spark, d):
    return runs.robust_threshold(settle(_disagreement(spark, d)), "d")


@query(THRESHOLDS)
def robust_threshold_all_rounds(spark, d):
    """No bucket is put in order, so every bit is narrowed down."""
    return runs.robust_threshold(settle(_disagreement(spark, d)), "d", in_order=0)


def _disagreement(spark, d):
    pred = src.predictions(spark, d)
    return detect.disagreement(pred, flow.flow_layer(pred, src.flow(spark, d)))


def _blip_runs(spark, d):
    pred = src.predictions(spark, d)
    return detect.disagreement_runs(pred, flow.flow_layer(pred, src.flow(spark, d)), block=src.event_block(spark, d))


def _blips(spark, d):
    return _blip_runs(spark, d).where(F.col("reason").isNull()).drop("reason")


BLIP_ROWS = f"WITH {BLIPS} SELECT {GAP_COLUMNS}, round(threshold, 6) AS threshold FROM blips"


@query(BLIP_ROWS)
def disagreement_blips(spark, d):
    return _blips(spark, d)


def in_storage(df, context=0):
    """The table written in blocks, under a name of its own."""
    return store_blocks(df, f"tracks_{uuid.uuid4().hex}", context=context)


@query(BLIP_ROWS)
def disagreement_blips_stored(spark, d):
    """Points and landings written in blocks first, then compared where they lie."""
    pred = in_storage(src.predictions(spark, d))
    landed = in_storage(flow.flow_layer(plain_rows(pred), src.flow(spark, d)))
    return detect.disagreement_blips(pred, landed)


@query(
    f"""WITH {BLIPS},
    c AS (SELECT video, label, count(*) FILTER (reason IS NULL) AS n_blips, count(*) FILTER (reason = 'edge') AS n_edge,
            count(*) FILTER (reason = 'long') AS n_long FROM judged_blips GROUP BY video, label)
    SELECT thr.video, thr.label, n, round(med, 6) AS med, round(mad, 6) AS mad, round(threshold, 6) AS threshold,
      coalesce(n_blips, 0) AS n_blips, coalesce(n_edge, 0) AS n_edge, coalesce(n_long, 0) AS n_long
    FROM thr LEFT JOIN c ON thr.video = c.video AND thr.label = c.label"""
)
def blip_label_stats(spark, d):
    thresholds = runs.robust_threshold(settle(_disagreement(spark, d)), "d")
    return detect.blip_label_stats(_blip_runs(spark, d), thresholds)


@query(
    f"""WITH {BLIPS} SELECT video, label, "start", "end", length, CASE WHEN length > 1 THEN 'long' ELSE reason END AS reason FROM judged_blips"""
)
def blip_runs_capped(spark, d):
    """Runs of more than one frame are too long for a blip."""
    pred = src.predictions(spark, d)
    found = detect.disagreement_runs(pred, flow.flow_layer(pred, src.flow(spark, d)), max_blip_length=1)
    return found.select("video", "label", "start", "end", "length", "reason")


@query(f"WITH {BLIPS} SELECT length, count(*) AS n_blips FROM blips GROUP BY length")
def blip_length_histogram(spark, d):
    return detect.length_histogram(_blips(spark, d))


@query(
    f"""WITH {EVENTS}, m AS (SELECT * FROM pred WHERE frame % 5 = 0 AND (label = '0' OR k >= 20)),
    n AS (SELECT video, max(frame) + 1 AS n_frames FROM pred GROUP BY video),
    lab AS (SELECT video, l.label FROM n CROSS JOIN (VALUES ('0'), ('1')) l(label)),
    c AS (SELECT lab.video, lab.label, count(m.frame) AS c FROM lab
          LEFT JOIN m ON m.video = lab.video AND m.label = lab.label GROUP BY lab.video, lab.label)
    SELECT c.video, round(min(c * 1.0 / n_frames), 6) AS coverage FROM c JOIN n ON c.video = n.video GROUP BY c.video"""
)
def min_coverage(spark, d):
    manual = src.manual_layer(spark, d)
    return detect.min_coverage(manual, src.event_videos(spark, d), src.declared_pair(manual))


@query(
    f"""WITH {BLIPS} SELECT p.video, p.label, p.frame, round(p.x, 6) AS x, round(p.y, 6) AS y, round(p.likelihood, 6) AS likelihood
    FROM pred p WHERE EXISTS (SELECT 1 FROM blips b WHERE b.video = p.video AND b.label = p.label
      AND p.frame BETWEEN b."start" AND b."end")"""
)
def points_in_blips(spark, d):
    return detect.points_in_runs(src.predictions(spark, d), _blips(spark, d))


@query(
    f"""WITH {BLIPS},
    q AS (SELECT b.*, m.min_likelihood FROM blips b JOIN (
        SELECT b.video, b.label, b."start", min(p.likelihood) AS min_likelihood FROM blips b JOIN pred p
          ON p.video = b.video AND p.label = b.label AND p.frame BETWEEN b."start" AND b."end"
        GROUP BY b.video, b.label, b."start") m
      ON m.video = b.video AND m.label = b.label AND m."start" = b."start")
    SELECT {GAP_COLUMNS}, round(threshold, 6) AS threshold, round(min_likelihood, 6) AS min_likelihood,
      CASE WHEN min_likelihood < 0.9 THEN 'also_low_likelihood' END AS reason FROM q"""
)
def gaps_from_blips(spark, d):
    return detect.attach_min_likelihood(_blips(spark, d), src.predictions(spark, d))


@query(
    f"""WITH {EVENTS}, w AS (SELECT video, frame, min(likelihood) AS worst FROM pred GROUP BY video, frame),
    r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY worst, frame) AS rank FROM w WHERE worst < 0.6)
    SELECT video, frame, round(worst, 6) AS worst, rank FROM r WHERE rank <= 5"""
)
def low_confidence_frames(spark, d):
    return detect.low_confidence_frames(src.predictions(spark, d), 0.6, max_frames=5)


@query(
    f"""WITH {EVENTS}, c AS (SELECT *, CASE WHEN likelihood >= 0.9 THEN frame END AS cf FROM pred)
    SELECT video, label, frame,
      max(cf) OVER (PARTITION BY video, label ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_frame,
      min(cf) OVER (PARTITION BY video, label ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_frame
    FROM c"""
)
def nearest_confident(spark, d):
    return detect.nearest_confident(src.predictions(spark, d), block=src.event_block(spark, d)).select(
        "video", "label", "frame", F.col("before.frame").alias("before_frame"), F.col("after.frame").alias("after_frame")
    )


@query(f"WITH {FLOW} SELECT video, label, frame, round(x, 6) AS x, round(y, 6) AS y FROM lk")
def flow_layer(spark, d):
    return flow.flow_layer(src.predictions(spark, d), src.flow(spark, d))


RESIDUAL = FLOW + """,
land AS (SELECT p.video, p.label, p.frame, p.x, p.y, b.x + f.dx_fwd AS fx, b.y + f.dy_fwd AS fy,
           a.x + f.dx_rev AS rx, a.y + f.dy_rev AS ry
         FROM pred p JOIN flow f ON f.video = p.video AND f.label = p.label AND f.frame = p.frame
         JOIN pred b ON b.video = p.video AND b.label = p.label AND b.frame = p.frame - 1
         JOIN pred a ON a.video = p.video AND a.label = p.label AND a.frame = p.frame + 1),
resid AS (SELECT video, label, frame,
    0.5 * (sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) + sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry))) AS residual,
    0.5 * (fx + rx) AS est_x, 0.5 * (fy + ry) AS est_y,
    sqrt((fx - rx) * (fx - rx) + (fy - ry) * (fy - ry)) AS agreement FROM land)
"""
RESIDUAL_COLUMNS = """video, label, frame, round(residual, 6) AS residual, round(est_x, 6) AS est_x,
    round(est_y, 6) AS est_y, round(agreement, 6) AS agreement"""


@query(f"WITH {RESIDUAL} SELECT {RESIDUAL_COLUMNS} FROM resid")
def flow_residual(spark, d):
    return flow.flow_residual(src.predictions(spark, d), src.flow(spark, d), block=src.event_block(spark, d))


@query(f"WITH {RESIDUAL} SELECT {RESIDUAL_COLUMNS} FROM resid WHERE frame % 9 = 4")
def flow_residual_at_frames(spark, d):
    pred = src.predictions(spark, d)
    return flow.flow_residual(pred, src.flow(spark, d), frames=pred.where(F.col("frame") % 9 == 4), block=src.event_block(spark, d))


@query(f"WITH {FLOW} SELECT video, label, frame, round(x, 6) AS x, round(y, 6) AS y FROM lk")
def paired_flow_layer(spark, d):
    """Half of the videos have the stored layer, the others get it computed."""
    layers = src.dense_layer(spark, d)
    steps = src.flow(spark, d)
    even = F.substring("video", 2, 20).cast("long") % 2 == 0
    stored = flow.flow_layer(layers.where(even).select("video", "label", "frame", "x", "y"), steps)
    stored = stored.withColumn("layer", F.lit("lk_iteration-0_100")).select(layers.columns)
    return flow.paired_flow_layer(
        layers.unionByName(stored), "dlc_iteration-0_100", src.event_videos(spark, d), steps
    )
