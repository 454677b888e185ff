"""Queries that look along the frame axis or pair model iterations."""

from pyspark.sql import functions as F

from trackspark.catalog.base import EVENTS, MANUAL, PREVIOUS, query
from trackspark.operators import asof
from trackspark.sources import adapters as src

NEAR = """
probe AS (SELECT video, label, frame FROM pred WHERE frame % 3 = 1),
span AS (SELECT p.video, p.label, p.frame,
    max(CASE WHEN m.frame < p.frame THEN m.frame END) AS b, min(CASE WHEN m.frame > p.frame THEN m.frame END) AS a,
    bool_or(coalesce(m.frame = p.frame, false)) AS here
  FROM probe p LEFT JOIN (SELECT DISTINCT video, label, frame FROM {frames}) m ON m.video = p.video {on_label}
  GROUP BY p.video, p.label, p.frame),
near AS (SELECT *, CASE WHEN here THEN frame WHEN a - frame <= frame - b THEN a ELSE coalesce(b, a) END AS nearest FROM span)
"""


@query(
    f"""WITH {MANUAL}, {NEAR.format(frames="manual", on_label="AND m.label = p.label")}
    SELECT video, label, frame, nearest, coalesce(b, frame) AS previous, coalesce(a, frame) AS next FROM near"""
)
def neighbour_frames_of_label(spark, d):
    probes = src.predictions(spark, d).where(F.col("frame") % 3 == 1)
    return asof.neighbour_frames(src.manual_layer(spark, d), probes, block=src.event_block(spark, d))


@query(
    f"""WITH {MANUAL}, {NEAR.format(frames="manual", on_label="")}
    SELECT DISTINCT video, frame, nearest, coalesce(b, frame) AS previous, coalesce(a, frame) AS next FROM near"""
)
def neighbour_frames_any_label(spark, d):
    probes = src.predictions(spark, d).where(F.col("frame") % 3 == 1)
    return asof.neighbour_frames(src.manual_layer(spark, d), probes, keys=("video",), block=src.event_block(spark, d))


@query(
    f"""WITH {MANUAL}, two AS (SELECT * FROM manual WHERE label IN ('0', '1')),
    {NEAR.format(frames="two", on_label="AND m.label = p.label")}
    SELECT n.video, n.frame, min(nearest) AS nearest FROM near n
    WHERE EXISTS (SELECT 1 FROM two WHERE two.video = n.video AND two.label = n.label)
    GROUP BY n.video, n.frame HAVING min(nearest) = max(nearest)"""
)
def common_nearest_frame(spark, d):
    two = src.manual_layer(spark, d).where(F.col("label").isin("0", "1"))
    probes = src.event_frames(spark, d).where(F.col("frame") % 3 == 1).select("video", "frame")
    return asof.common_nearest_frame(two, probes, block=src.event_block(spark, d))


@query(
    f"""WITH {EVENTS}, want AS (SELECT video, k % 50 AS pos, max(frame) - k % 50 AS frame FROM ev GROUP BY video, k % 50 HAVING max(frame) >= 50)
    SELECT w.video, w.pos, w.frame, p.label, round(x, 6) AS x, round(y, 6) AS y, round(likelihood, 6) AS likelihood
    FROM want w LEFT JOIN pred p ON p.video = w.video AND p.frame = w.frame"""
)
def select_frames(spark, d):
    ev = src.event_frames(spark, d)
    pos = F.col("k") % 50
    wanted = ev.groupBy("video", pos.alias("pos")).agg(F.max("frame").alias("m")).where("m >= 50")
    wanted = wanted.select("video", "pos", (F.col("m") - F.col("pos")).alias("frame"))
    wanted = wanted.join(src.event_videos(spark, d).select("video", "n_frames"), "video")
    return asof.select_frames(src.predictions(spark, d), wanted)


@query(
    f"""WITH {EVENTS} SELECT video, (frame - 6) // 4 AS pos, frame, label, round(x, 6) AS x, round(y, 6) AS y,
    round(likelihood, 6) AS likelihood FROM pred WHERE frame BETWEEN 6 AND 60 AND (frame - 6) % 4 = 0"""
)
def select_range(spark, d):
    return asof.select_range(src.predictions(spark, d), src.event_videos(spark, d), 6, 60, step=4)


@query(f"WITH {EVENTS} SELECT video, 'predicted' AS layer, label, frame, round(x, 6) AS x, round(y, 6) AS y FROM pred")
def to_annotation(spark, d):
    named = src.predictions(spark, d).withColumn("bodypart", F.concat(F.lit("point"), F.col("label")))
    return asof.to_annotation(named.drop("label"))[0]


PAIRED = PREVIOUS + """,
manual AS (SELECT video, label, frame, x + (event_id % 12) AS x, y FROM pred WHERE frame % 5 = 0),
pairs AS (SELECT m.video, m.label, m.frame, m.x, m.y, n.x AS now_x, n.y AS now_y, n.likelihood AS now_lik, w.x AS was_x, w.y AS was_y
  FROM manual m LEFT JOIN pred n ON n.video = m.video AND n.label = m.label AND n.frame = m.frame
  LEFT JOIN prev w ON w.video = m.video AND w.label = m.label AND w.frame = m.frame),
judged AS (SELECT *, sqrt((x - now_x) * (x - now_x) + (y - now_y) * (y - now_y)) AS d,
   coalesce(now_lik >= 0.9 AND sqrt((now_x - was_x) * (now_x - was_x) + (now_y - was_y) * (now_y - was_y)) <= 1.1, false) AS settled FROM pairs),
nudged AS (SELECT *, CASE WHEN NOT settled THEN 'unconverged' WHEN d < 1.5 THEN 'on_target' WHEN d > 8.5 THEN 'flagged' ELSE 'nudged' END AS status FROM judged)
"""


def _labels(spark, d):
    rows = src.predictions(spark, d, with_event=True).where(F.col("frame") % 5 == 0)
    return rows.select("video", "label", "frame", (F.col("x") + F.col("event_id") % 12).alias("x"), "y")


@query(
    f"""WITH {PAIRED} SELECT video, label, frame, round(x, 6) AS x, round(y, 6) AS y, round(now_x, 6) AS now_x, round(now_y, 6) AS now_y,
    round(now_lik, 6) AS now_lik, round(was_x, 6) AS was_x, round(was_y, 6) AS was_y FROM pairs"""
)
def pair_iterations(spark, d):
    return asof.pair_iterations(_labels(spark, d), src.predictions(spark, d), src.previous_predictions(spark, d))


def _nudged(spark, d):
    return asof.nudge_labels(
        _labels(spark, d), src.predictions(spark, d), src.previous_predictions(spark, d),
        converge_tol=1.1, nudge_min=1.5, nudge_max=8.5, alpha=0.5,
    )


@query(
    f"""WITH {PAIRED} SELECT video, label, frame, round(CASE WHEN status = 'nudged' THEN x + 0.5 * (now_x - x) ELSE x END, 6) AS x,
    round(CASE WHEN status = 'nudged' THEN y + 0.5 * (now_y - y) ELSE y END, 6) AS y, status FROM nudged"""
)
def nudge_labels(spark, d):
    return _nudged(spark, d)


@query(f"WITH {PAIRED} SELECT video, status, count(*) AS n FROM nudged GROUP BY video, status")
def nudge_tally(spark, d):
    return asof.nudge_tally(_nudged(spark, d))
