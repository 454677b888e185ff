"""Queries that fill, smooth and measure tracks."""

import math
import uuid

from pyspark.sql import functions as F

from trackspark.catalog.base import BLIPS, EVENTS, FLOW, INTERVALS, MANUAL, query
from trackspark.catalog.detection import RUNS
from trackspark.operators import detect, flow, repair, smooth
from trackspark.plans import workflows
from trackspark.sources import adapters as src
from trackspark.sources.layout import store_blocks

XY = "round(x, 6) AS x, round(y, 6) AS y"
# Blending of runs (video, label, "start", "end", ax0, ay0, ax1, ay1) anchored at their own ends.
STEEP = f"{2.0 * math.log(1.0 / 0.01 - 1.0)!r}::DOUBLE"
BLEND = """
steps AS (SELECT r.*, f.frame,
    CASE WHEN f.frame > r."start" THEN coalesce(f.dx_fwd, 0) ELSE 0 END AS fx, CASE WHEN f.frame > r."start" THEN coalesce(f.dy_fwd, 0) ELSE 0 END AS fy,
    CASE WHEN f.frame < r."end" THEN coalesce(f.dx_rev, 0) ELSE 0 END AS rx, CASE WHEN f.frame < r."end" THEN coalesce(f.dy_rev, 0) ELSE 0 END AS ry
  FROM {runs} r JOIN flow f ON f.video = r.video AND f.label = r.label AND f.frame BETWEEN r."start" AND r."end"
  WHERE r."end" > r."start"),
paths AS (SELECT *,
    ax0 + sum(fx) OVER up AS fwd_x, ay0 + sum(fy) OVER up AS fwd_y, ax1 + sum(rx) OVER down AS rev_x, ay1 + sum(ry) OVER down AS rev_y
  FROM steps WINDOW up AS (PARTITION BY video, label, "start", "end" ORDER BY frame),
    down AS (PARTITION BY video, label, "start", "end" ORDER BY frame DESC)),
weighted AS (SELECT *, (1.0::DOUBLE / (1.0::DOUBLE + exp({steep} / ("end" - "start") * (frame - ("start" + "end") / 2.0))) - 0.5) / 0.98::DOUBLE + 0.5 AS w FROM paths),
blended AS (SELECT *, fwd_x * w + rev_x * (1 - w) AS x, fwd_y * w + rev_y * (1 - w) AS y,
    sqrt((fwd_x - rev_x) * (fwd_x - rev_x) + (fwd_y - rev_y) * (fwd_y - rev_y)) AS disagreement FROM weighted)
"""
# All severe uncertain runs with an anchor on both sides.
SEVERE = FLOW + "," + RUNS.format(t="pred", max_gap=45, bracket=5) + """,
severe AS (SELECT * FROM urun WHERE min_likelihood <= 0.6 AND s > 0 AND e < n - 1),
wide AS (SELECT video, label, "start" - 1 AS "start", "end" + 1 AS "end", ax0, ay0, ax1, ay1 FROM severe),
""" + BLEND.format(runs="wide", steep=STEEP) + """,
verdict AS (SELECT video, label, "start" + 1 AS "start", "end" - 1 AS "end",
    max(disagreement) FILTER (frame > "start" AND frame < "end") AS worst FROM blended GROUP BY video, label, "start", "end"),
repaired AS (SELECT b.video, b.label, b."start" + 1 AS "start", b."end" - 1 AS "end", b.frame, b.x, b.y, b.disagreement
  FROM blended b JOIN verdict v ON v.video = b.video AND v.label = b.label AND v."start" = b."start" + 1
  WHERE v.worst <= 5.0 AND b.frame > b."start" AND b.frame < b."end")
"""


def severe_runs(spark, d):
    found = detect.uncertain_runs(src.predictions(spark, d), dense=True, block=src.event_block(spark, d))
    anchored = F.col("ax0").isNotNull() & F.col("ax1").isNotNull()
    return found.where((F.coalesce("reason", F.lit("")) != "not_severe") & anchored)


@query(
    f"""WITH {SEVERE} SELECT video, label, "start", "end", frame, {XY}, round(disagreement, 6) AS disagreement FROM repaired"""
)
def repair_gaps(spark, d):
    return repair.repair_gaps(severe_runs(spark, d), src.flow(spark, d), block=src.event_block(spark, d))


@query(
    f"""WITH {SEVERE} SELECT video, label, "start", "end", round(worst, 6) AS worst,
    CASE WHEN worst > 5.0 THEN 'untrusted' END AS reason FROM verdict"""
)
def gap_verdicts(spark, d):
    return repair.gap_verdicts(severe_runs(spark, d), src.flow(spark, d), block=src.event_block(spark, d))


REPORT = f"""WITH {SEVERE} SELECT video, count(*) AS n_frames, round(median(disagreement), 6) AS median,
    round(quantile_cont(disagreement, 0.9), 6) AS p90, round(max(disagreement), 6) AS max,
    round(avg(CASE WHEN disagreement <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_1,
    round(avg(CASE WHEN disagreement <= 2 THEN 1.0 ELSE 0.0 END), 6) AS within_2,
    round(avg(CASE WHEN disagreement <= 5 THEN 1.0 ELSE 0.0 END), 6) AS within_5,
    count(*) FILTER (disagreement <= 2) AS n_trusted FROM repaired GROUP BY video"""


@query(REPORT)
def repair_report(spark, d):
    return repair.repair_report(repair.repair_gaps(severe_runs(spark, d), src.flow(spark, d), block=src.event_block(spark, d)))


@query(REPORT)
def repair_report_all_rounds(spark, d):
    """No bucket is put in order, so every bit is narrowed down."""
    repaired = repair.repair_gaps(severe_runs(spark, d), src.flow(spark, d), block=src.event_block(spark, d))
    return repair.repair_report(repaired, in_order=0)


SPAN_RUNS = FLOW + "," + INTERVALS + """,
sruns AS (SELECT s.video, s.label, s."start", s."end", a.x AS ax0, a.y AS ay0, b.x AS ax1, b.y AS ay1 FROM spans s
  JOIN pred a ON a.video = s.video AND a.label = s.label AND a.frame = s."start"
  JOIN pred b ON b.video = s.video AND b.label = s.label AND b.frame = s."end"),
""" + BLEND.format(runs="sruns", steep=STEEP)


def _span_runs(spark, d):
    pred = src.predictions(spark, d)
    at = lambda c, a, b: pred.select("video", "label", F.col("frame").alias(c), F.col("x").alias(a), F.col("y").alias(b))
    return (
        src.intervals(spark, d)
        .join(at("start", "ax0", "ay0"), ["video", "label", "start"])
        .join(at("end", "ax1", "ay1"), ["video", "label", "end"])
    )


@query(
    f"""WITH {SPAN_RUNS} SELECT video, label, "start", "end", frame, {XY}, round(fwd_x, 6) AS fwd_x, round(fwd_y, 6) AS fwd_y,
    round(rev_x, 6) AS rev_x, round(rev_y, 6) AS rev_y, round(disagreement, 6) AS disagreement FROM blended"""
)
def rstc_blend(spark, d):
    return repair.rstc_blend(_span_runs(spark, d), src.flow(spark, d), return_paths=True, block=src.event_block(spark, d))


@query(
    f"""WITH {SPAN_RUNS} SELECT video, label, "start", "end", frame, {XY} FROM blended WHERE frame = "start" + 3"""
)
def rstc_blend_one_frame(spark, d):
    spans = _span_runs(spark, d).withColumn("target", F.col("start") + 3)
    return repair.rstc_blend(spans, src.flow(spark, d), target_frame="target", block=src.event_block(spark, d))


@query(
    f"""WITH {SPAN_RUNS} SELECT video, label, "start", "end", frame, {XY}, round(disagreement, 6) AS disagreement FROM blended"""
)
def blend_tracker_paths(spark, d):
    """The same blend from paths an external tracker stored per run."""
    spans = _span_runs(spark, d).withColumn("run_id", F.concat_ws("/", "video", "label", "start"))
    paths = repair.tracked_paths(spans, src.flow(spark, d), block=src.event_block(spark, d)).withColumn("run_id", F.concat_ws("/", "video", "label", "start"))
    tracks = paths.select("run_id", "video", "label", "frame", "fwd_x", "fwd_y", "rev_x", "rev_y")
    return repair.blend_tracks(spans, tracks).select("video", "label", "start", "end", "frame", "x", "y", "disagreement")


@query(
    f"""WITH {SPAN_RUNS}, new AS (SELECT video, label, frame, x, y FROM blended), manual AS (
      SELECT video, label, frame, x, y FROM pred WHERE frame % 5 = 0 AND (label = '0' OR k >= 20)
      UNION ALL SELECT video, '9', frame, x, y FROM pred WHERE frame % 20 = 0 AND label = '0')
    SELECT coalesce(n.video, m.video) AS video, 'iteration-0' AS layer, coalesce(n.label, m.label) AS label,
      coalesce(n.frame, m.frame) AS frame, round(coalesce(n.x, m.x), 6) AS x, round(coalesce(n.y, m.y), 6) AS y
    FROM new n FULL OUTER JOIN manual m ON n.video = m.video AND n.label = m.label AND n.frame = m.frame"""
)
def interpolate_interval(spark, d):
    return repair.interpolate_intervals(
        src.manual_layer(spark, d), src.dense_layer(spark, d), src.intervals(spark, d), src.flow(spark, d), block=src.event_block(spark, d)
    )


@query(
    f"""WITH {FLOW}, a AS (SELECT video, label, frame AS s, x, y, CASE WHEN k % 2 = 0 THEN frame + 6 ELSE frame - 6 END AS t
      FROM pred WHERE frame % 20 = 0),
    m AS (SELECT a.*, f.frame, CASE WHEN t > s THEN f.dx_fwd ELSE f.dx_rev END AS dx, CASE WHEN t > s THEN f.dy_fwd ELSE f.dy_rev END AS dy
      FROM a JOIN flow f ON f.video = a.video AND f.label = a.label AND f.frame BETWEEN least(s, t) AND greatest(s, t)),
    w AS (SELECT *, sum(CASE WHEN frame = s THEN 0 ELSE dx END) OVER (PARTITION BY video, label, s ORDER BY abs(frame - s)) AS sx,
      sum(CASE WHEN frame = s THEN 0 ELSE dy END) OVER (PARTITION BY video, label, s ORDER BY abs(frame - s)) AS sy,
      bool_or(frame <> s AND (dx IS NULL OR dy IS NULL)) OVER (PARTITION BY video, label, s) AS hole,
      count(*) OVER (PARTITION BY video, label, s) AS n FROM m)
    SELECT video, label, frame, round(x + sx, 6) AS x, round(y + sy, 6) AS y FROM w WHERE NOT hole AND n = 7"""
)
def propagate(spark, d):
    anchors = src.predictions(spark, d, with_event=True).where("frame % 20 = 0").withColumn(
        "to", F.when(F.col("k") % 2 == 0, F.col("frame") + 6).otherwise(F.col("frame") - 6)
    )
    return repair.propagate(anchors, src.flow(spark, d), block=src.event_block(spark, d))


@query(
    f"""WITH {FLOW}, two AS (SELECT video, label, frame, x, y FROM pred WHERE frame % 5 = 0 AND (label = '0' OR k >= 20)),
    near AS (SELECT p.video, p.label, p.frame, arg_min(m.frame, abs(m.frame - p.frame) * 1000000 - m.frame) AS nearest
      FROM pred p JOIN two m ON m.video = p.video AND m.label = p.label WHERE p.frame % 9 = 4 GROUP BY p.video, p.label, p.frame),
    both_ AS (SELECT video, frame, min(nearest) AS nearest FROM near GROUP BY video, frame HAVING min(nearest) = max(nearest)),
    a AS (SELECT m.video, m.label, m.frame AS s, b.frame AS t, m.x, m.y FROM both_ b JOIN two m ON m.video = b.video AND m.frame = b.nearest)
    SELECT a.video, a.label, t AS frame,
      round(any_value(a.x) + sum(CASE WHEN f.frame = s THEN 0 WHEN t > s THEN f.dx_fwd ELSE f.dx_rev END), 6) AS x,
      round(any_value(a.y) + sum(CASE WHEN f.frame = s THEN 0 WHEN t > s THEN f.dy_fwd ELSE f.dy_rev END), 6) AS y
    FROM a JOIN flow f ON f.video = a.video AND f.label = a.label AND f.frame BETWEEN least(s, t) AND greatest(s, t) GROUP BY a.video, a.label, s, t"""
)
def predict_from_nearest(spark, d):
    pred = src.predictions(spark, d, with_event=True)
    labelled = pred.where((F.col("frame") % 5 == 0) & ((F.col("label") == "0") | (F.col("k") >= 20)))
    probes = src.event_frames(spark, d).where(F.col("frame") % 9 == 4).select("video", "frame")
    return workflows.predict_from_nearest(
        labelled, probes, src.flow(spark, d), mode="direct", block=src.event_block(spark, d)
    )


@query(
    f"""WITH {FLOW}, sp AS (SELECT video, label, frame, x, y FROM pred WHERE frame % 6 = 0),
    nx AS (SELECT video, label, frame AS "start", lead(frame) OVER w AS "end", x AS ax0, y AS ay0,
      lead(x) OVER w AS ax1, lead(y) OVER w AS ay1, lag(frame) OVER w AS prior FROM sp WINDOW w AS (PARTITION BY video, label ORDER BY frame)),
    pairs AS (SELECT * EXCLUDE (prior) FROM nx WHERE "end" IS NOT NULL), {BLEND.format(runs="pairs", steep=STEEP)}
    SELECT video, 'buffer' AS layer, label, frame, {XY} FROM blended WHERE frame < "end"
    UNION ALL SELECT video, 'buffer', label, "start", round(ax0, 6), round(ay0, 6) FROM nx WHERE "end" IS NULL AND prior IS NOT NULL"""
)
def interpolate_between_labels(spark, d):
    sparse = src.predictions(spark, d).where(F.col("frame") % 6 == 0)
    return repair.interpolate_between_labels(sparse, src.flow(spark, d), block=src.event_block(spark, d))


@query(
    f"""WITH {FLOW}, sp AS (SELECT video, label, frame, x, y FROM pred WHERE frame % 6 = 0 AND label = '1'),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame DESC) AS r FROM sp WHERE frame < 20) WHERE r <= 2
      UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) AS r FROM sp WHERE frame >= 20) WHERE r <= 2),
    nx AS (SELECT video, label, frame AS "start", lead(frame) OVER w AS "end", x AS ax0, y AS ay0,
      lead(x) OVER w AS ax1, lead(y) OVER w AS ay1, lag(frame) OVER w AS prior FROM near WINDOW w AS (PARTITION BY video, label ORDER BY frame)),
    pairs AS (SELECT * EXCLUDE (prior) FROM nx WHERE "end" IS NOT NULL), {BLEND.format(runs="pairs", steep=STEEP)}
    SELECT video, 'buffer' AS layer, label, frame, {XY} FROM blended WHERE frame < "end"
    UNION ALL SELECT video, 'buffer', label, "start", round(ax0, 6), round(ay0, 6) FROM nx WHERE "end" IS NULL AND prior IS NOT NULL"""
)
def interpolate_near_frame(spark, d):
    sparse = src.predictions(spark, d).where(F.col("frame") % 6 == 0)
    return repair.interpolate_between_labels(sparse, src.flow(spark, d), mode="minimal", label="1", frame=20, block=src.event_block(spark, d))


FIXED_BLIPS = BLIPS + """,
wide AS (SELECT video, label, "start" - 1 AS "start", "end" + 1 AS "end", ax0, ay0, ax1, ay1 FROM blips),
""" + BLEND.format(runs="wide", steep=STEEP) + """,
fixed AS (SELECT video, label, frame, x, y FROM blended WHERE frame > "start" AND frame < "end")
"""


def _deblip(spark, d, part):
    layers, steps = src.dense_layer(spark, d), src.flow(spark, d)
    landed = flow.flow_layer(src.predictions(spark, d), steps)
    return workflows.deblip(layers, "dlc_iteration-0_100", landed, steps, block=src.event_block(spark, d))[part]


@query(f"WITH {FIXED_BLIPS} SELECT video, label, frame, {XY} FROM fixed")
def interpolate_blips(spark, d):
    return _deblip(spark, d, "corrections")


@query(
    f"""WITH {FIXED_BLIPS} SELECT p.video, 'deblip_dlc_iteration-0_100' AS layer, p.label, p.frame,
    round(coalesce(f.x, p.x), 6) AS x, round(coalesce(f.y, p.y), 6) AS y
    FROM pred p LEFT JOIN fixed f ON f.video = p.video AND f.label = p.label AND f.frame = p.frame"""
)
def deblip_trace(spark, d):
    return _deblip(spark, d, "deblip_layer")


# Selected frames: label 0 at every sixth frame. Label 1 must be completed.
COMPLETED = FLOW + """,
sel AS (SELECT video, label, frame, x + 1 AS x, y FROM pred WHERE label = '0' AND frame % 6 = 2),
conf AS (SELECT *, CASE WHEN likelihood >= 0.9 THEN frame END AS cf FROM pred),
around AS (SELECT *, max(cf) OVER (PARTITION BY video, label ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf,
   min(cf) OVER (PARTITION BY video, label ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS af FROM conf),
want AS (SELECT s.video, l.label, s.frame FROM (SELECT DISTINCT video, frame FROM sel) s CROSS JOIN (VALUES ('0'), ('1')) l(label)),
full_ AS (SELECT w.video, w.label, w.frame, g.x AS gx, g.y AS gy, a.x AS px, a.y AS py, a.likelihood, a.bf, a.af
  FROM want w LEFT JOIN sel g ON g.video = w.video AND g.label = w.label AND g.frame = w.frame
  LEFT JOIN around a ON a.video = w.video AND a.label = w.label AND a.frame = w.frame),
need AS (SELECT DISTINCT f.video, f.label, bf AS "start", af AS "end", b.x AS ax0, b.y AS ay0, a.x AS ax1, a.y AS ay1 FROM full_ f
  JOIN pred b ON b.video = f.video AND b.label = f.label AND b.frame = f.bf
  JOIN pred a ON a.video = f.video AND a.label = f.label AND a.frame = f.af
  WHERE gx IS NULL AND NOT f.likelihood >= 0.9 AND f.af - f.bf <= 45),
""" + BLEND.format(runs="need", steep=STEEP) + """,
cand AS (SELECT f.video, f.label, f.frame,
    CASE WHEN f.gx IS NOT NULL THEN 'given' WHEN f.likelihood >= 0.9 THEN 'prediction' ELSE 'flow' END AS source,
    CASE WHEN f.gx IS NOT NULL THEN f.gx WHEN f.likelihood >= 0.9 THEN f.px ELSE b.x END AS x,
    CASE WHEN f.gx IS NOT NULL THEN f.gy WHEN f.likelihood >= 0.9 THEN f.py ELSE b.y END AS y
  FROM full_ f LEFT JOIN blended b ON b.video = f.video AND b.label = f.label AND b.frame = f.frame AND b."start" = f.bf AND b.disagreement <= 5.0),
completed AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.video = c.video AND o.frame = c.frame AND o.x IS NULL))
"""


def _selected(spark, d):
    rows = src.predictions(spark, d).where((F.col("label") == "0") & (F.col("frame") % 6 == 2))
    return rows.select("video", "label", "frame", (F.col("x") + 1).alias("x"), "y")


def _completed(spark, d):
    return repair.complete_frames(_selected(spark, d), src.predictions(spark, d), src.flow(spark, d), block=src.event_block(spark, d))


@query(f"WITH {COMPLETED} SELECT video, label, frame, {XY}, source FROM completed")
def complete_frames(spark, d):
    return _completed(spark, d)


@query(
    f"""WITH {COMPLETED}, k AS (SELECT video, count(DISTINCT frame) AS kept, count(*) FILTER (source = 'given') AS given,
      count(*) FILTER (source = 'prediction') AS by_prediction, count(*) FILTER (source = 'flow') AS by_flow FROM completed GROUP BY video),
    i AS (SELECT video, count(DISTINCT frame) AS n FROM sel GROUP BY video)
    SELECT i.video, coalesce(kept, 0) AS kept, n - coalesce(kept, 0) AS dropped, coalesce(given, 0) AS given,
      coalesce(by_prediction, 0) AS by_prediction, coalesce(by_flow, 0) AS by_flow FROM i LEFT JOIN k ON k.video = i.video"""
)
def completion_tally(spark, d):
    return repair.completion_tally(_selected(spark, d), _completed(spark, d))


# Every window of 9 frames of every trace, blended between its ends.
WINDOWS = FLOW + """,
sums AS (SELECT p.video, p.label, p.frame, p.x, p.y,
    sum(coalesce(f.dx_fwd, 0)) OVER w AS fx, sum(coalesce(f.dy_fwd, 0)) OVER w AS fy,
    coalesce(sum(coalesce(f.dx_rev, 0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rx,
    coalesce(sum(coalesce(f.dy_rev, 0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ry
  FROM pred p JOIN flow f ON f.video = p.video AND f.label = p.label AND f.frame = p.frame
  WINDOW w AS (PARTITION BY p.video, p.label ORDER BY p.frame)),
win AS (SELECT s.video, s.label, t.frame, s.frame AS window_start,
    s.x + t.fx - s.fx AS ux, s.y + t.fy - s.fy AS uy, e.x + e.rx - t.rx AS vx, e.y + e.ry - t.ry AS vy,
    (1.0::DOUBLE / (1.0::DOUBLE + exp({steep} / 8 * (t.frame - s.frame - 4))) - 0.5) / 0.98::DOUBLE + 0.5 AS w
  FROM sums s JOIN sums e ON e.video = s.video AND e.label = s.label AND e.frame = s.frame + 8
  JOIN sums t ON t.video = s.video AND t.label = s.label AND t.frame BETWEEN s.frame AND e.frame),
pieces AS (SELECT video, label, frame, window_start, w * ux + (1 - w) * vx AS x, w * uy + (1 - w) * vy AS y FROM win)
""".replace("{steep}", STEEP)


AVERAGES = f"WITH {WINDOWS} SELECT video, label, frame, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM pieces GROUP BY video, label, frame"


@query(AVERAGES)
def smooth_moving_average_stored(spark, d):
    """Points and flow written in blocks first, then smoothed where they lie."""
    points, steps = (store_blocks(df, f"tracks_{uuid.uuid4().hex}", context=8) for df in (src.predictions(spark, d), src.flow(spark, d)))
    return smooth.smooth_moving_average(points, steps, src.event_videos(spark, d), n_window=9)


@query(AVERAGES)
def smooth_moving_average(spark, d):
    return smooth.smooth_moving_average(
        src.predictions(spark, d), src.flow(spark, d), src.event_videos(spark, d), n_window=smooth.window_frames(0.3, 30), block=src.event_block(spark, d)
    )


@query(f"WITH {WINDOWS} SELECT video, label, frame, window_start, {XY} FROM pieces")
def moving_average_windows(spark, d):
    return smooth.moving_average_windows(
        src.predictions(spark, d), src.flow(spark, d), src.event_videos(spark, d), n_window=9, block=src.event_block(spark, d)
    )


@query(
    f"""WITH {FLOW}, part AS (SELECT * FROM pred WHERE NOT (label = '1' AND k = 50)),
    n AS (SELECT video, max(frame) + 1 AS n_frames FROM pred GROUP BY video)
    SELECT p.video, p.label, count(*) AS n_points, n_frames, CASE WHEN count(*) < n_frames THEN 'holes' END AS reason
    FROM part p JOIN n ON n.video = p.video GROUP BY p.video, p.label, n_frames"""
)
def smoothing_coverage(spark, d):
    rows = src.predictions(spark, d, with_event=True).where(~((F.col("label") == "1") & (F.col("k") == 50)))
    return smooth.smoothing_coverage(rows, src.flow(spark, d), src.event_videos(spark, d))


@query(
    f"""WITH {MANUAL}, {INTERVALS},
    sp AS (SELECT DISTINCT video, "start", "end" FROM spans),
    thick AS (SELECT video, 'iteration-0' AS layer, label, frame, x, y FROM pred WHERE label = '0' OR k >= 20),
    labs AS (SELECT video, count(DISTINCT label) AS n FROM thick GROUP BY video),
    comp AS (SELECT t.video, t.frame FROM thick t JOIN labs ON labs.video = t.video GROUP BY t.video, t.frame, labs.n HAVING count(*) = labs.n),
    ord AS (SELECT c.video, c.frame, row_number() OVER (PARTITION BY c.video ORDER BY c.frame) AS r FROM comp c
      JOIN sp ON sp.video = c.video AND c.frame BETWEEN sp."start" AND sp."end")
    SELECT t.video, t.layer, t.label, t.frame, round(t.x, 6) AS x, round(t.y, 6) AS y FROM thick t JOIN sp ON sp.video = t.video
    LEFT JOIN ord ON ord.video = t.video AND ord.frame = t.frame AND ord.r % 2 = 1
    WHERE NOT (t.frame BETWEEN sp."start" AND sp."end") OR ord.frame IS NOT NULL"""
)
def decimate_interval(spark, d):
    rows = src.predictions(spark, d, with_event=True).where((F.col("label") == "0") | (F.col("k") >= 20))
    rows = rows.select("video", F.lit("iteration-0").alias("layer"), "label", "frame", "x", "y")
    return smooth.decimate_intervals(rows, src.intervals(spark, d).drop("label"), block=src.event_block(spark, d))


# Low-pass between frames start .. end of label 0, every third point missing. {period} is the period of an interval s.
LOWPASS = EVENTS + "," + INTERVALS + """,
spans2 AS (SELECT s.*, CAST({period} AS BIGINT) AS p FROM spans s),
holed AS (SELECT video, label, frame, x, y FROM pred WHERE k % 3 <> 0),
sinc AS (SELECT p, i, CASE WHEN i = 0 THEN 1.0 ELSE sin(pi() * (2.0 / p) * i) / (pi() * (2.0 / p) * i) END * (2.0 / p) * 0.5 * (1 + cos(pi() * i / p)) AS h
  FROM (SELECT p, unnest(range(-p, p + 1)) AS i FROM (SELECT DISTINCT p FROM spans2))),
taps AS (SELECT p, i, h / sum(h) OVER (PARTITION BY p) AS h FROM sinc),
ctx AS (SELECT s.video, s.label, s."start", s."end", s.p, c.frame FROM spans2 s, LATERAL (SELECT unnest(range(s."start" - s.p, s."end" + s.p + 1)) AS frame) c),
val AS (SELECT c.*, h.x, h.y, CASE WHEN h.x IS NOT NULL THEN c.frame END AS kf FROM ctx c
  LEFT JOIN holed h ON h.video = c.video AND h.label = c.label AND h.frame = c.frame),
near AS (SELECT *, max(kf) OVER (PARTITION BY video, label ORDER BY frame) AS bf,
    min(kf) OVER (PARTITION BY video, label ORDER BY frame DESC) AS af, count(x) OVER (PARTITION BY video, label) AS n FROM val),
fill AS (SELECT n.*, CASE WHEN n.x IS NOT NULL THEN n.x WHEN bf IS NULL THEN a.x WHEN af IS NULL THEN b.x
      ELSE b.x + (n.frame - bf) / (af - bf) * (a.x - b.x) END AS gx,
    CASE WHEN n.x IS NOT NULL THEN n.y WHEN bf IS NULL THEN a.y WHEN af IS NULL THEN b.y
      ELSE b.y + (n.frame - bf) / (af - bf) * (a.y - b.y) END AS gy
  FROM near n LEFT JOIN holed b ON b.video = n.video AND b.label = n.label AND b.frame = bf
  LEFT JOIN holed a ON a.video = n.video AND a.label = n.label AND a.frame = af WHERE n >= 8),
conv AS (SELECT f.video, f.label, f.frame, f."start", f."end", f.p, f.x, f.y, sum(t.h * g.gx) AS lx, sum(t.h * g.gy) AS ly
  FROM fill f JOIN taps t ON t.p = f.p JOIN fill g ON g.video = f.video AND g.label = f.label AND g.frame = f.frame + t.i
  WHERE f.x IS NOT NULL AND f.frame BETWEEN f."start" AND f."end" GROUP BY ALL),
fade AS (SELECT *, frame - "start" AS j, "end" - "start" + 1 AS m, least(("end" - "start" + 1) // 4, greatest(3, least(p // 3, 20))) AS k FROM conv),
lp AS (SELECT *, CASE WHEN j >= m - k THEN 0.5 * (1 - cos(pi() * (m - j) / (k + 1))) WHEN j < k THEN 0.5 * (1 - cos(pi() * (j + 1) / (k + 1))) ELSE 1 END AS w FROM fade)
"""


def _holed(spark, d):
    return src.predictions(spark, d, with_event=True).where(F.col("k") % 3 != 0).select("video", "label", "frame", "x", "y")


FILTERED = f"""WITH {LOWPASS} SELECT h.video, h.label, h.frame, round(CASE WHEN lp.w IS NULL THEN h.x ELSE h.x + lp.w * (lx - h.x) END, 6) AS x,
    round(CASE WHEN lp.w IS NULL THEN h.y ELSE h.y + lp.w * (ly - h.y) END, 6) AS y
    FROM holed h LEFT JOIN lp ON lp.video = h.video AND lp.label = h.label AND lp.frame = h.frame"""


@query(FILTERED.replace("{period}", "5"))
def lowpass_interval(spark, d):
    return smooth.lowpass_intervals(_holed(spark, d), src.intervals(spark, d), period=5, block=src.event_block(spark, d))


# Intervals of 13 to 17 frames: periods 5 and, from 16 frames on, 8.
@query(FILTERED.replace("{period}", """CASE WHEN s."end" - s."start" + 1 >= 16 THEN 8 ELSE 5 END"""))
def lowpass_level(spark, d):
    """The second level, or the first where an interval is too short for it."""
    return smooth.lowpass_level(_holed(spark, d), src.intervals(spark, d), level=2, block=src.event_block(spark, d))


@query(
    f"""WITH {EVENTS}, p AS (SELECT video, frame, x, y, 1 AS o FROM pred WHERE label = '0'
      UNION ALL SELECT video, frame, x, y, 2 FROM pred WHERE label = '1'
      UNION ALL SELECT video, frame, x + 30, y * 2, 3 FROM pred WHERE label = '0' AND k >= 10),
    c AS (SELECT *, count(*) OVER (PARTITION BY video, frame) AS n,
      coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM p
      WINDOW w AS (PARTITION BY video, frame ORDER BY o))
    SELECT video, frame, round(CASE WHEN max(n) = 3 THEN abs(sum(x * y2 - x2 * y)) / 2 END, 6) AS area FROM c GROUP BY video, frame"""
)
def polygon_area(spark, d):
    pred = src.predictions(spark, d, with_event=True)
    third = pred.where((F.col("label") == "0") & (F.col("k") >= 10)).select(
        "video", F.lit("2").alias("label"), "frame", (F.col("x") + 30).alias("x"), (F.col("y") * 2).alias("y")
    )
    return smooth.polygon_areas(pred.select(third.columns).unionByName(third), "012")
