"""Queries that choose training frames under budgets."""

from pyspark.sql import functions as F

from trackspark.catalog.base import BLIPS, EVENTS, MANUAL, query
from trackspark.catalog.detection import GAPS, RESIDUAL
from trackspark.catalog.repairing import SEVERE, severe_runs
from trackspark.functions.names import image_name
from trackspark.operators import detect, flow, repair, select
from trackspark.plans import workflows
from trackspark.sources import adapters as src

XY = "round(x, 6) AS x, round(y, 6) AS y"
# Evenly spaced picks of n rows: row position pos is kept if some i hits it.
EVEN = """(n <= share OR (share = 1 AND pos = 0) OR (share > 1 AND EXISTS (SELECT 1 FROM range(0, share) t(i)
  WHERE CASE WHEN i = share - 1 THEN n - 1 ELSE CAST(round_even(i * ((n - 1)::DOUBLE / (share - 1)), 0) AS BIGINT) END = pos)))"""


@query(
    f"""WITH {GAPS}, g AS (SELECT * FROM judged WHERE reason IS NULL),
    t AS (SELECT video, count(*) AS total, count(DISTINCT label) AS labels FROM g GROUP BY video),
    r AS (SELECT g.video, g.label, g."start", g."end", g.length, t.total, greatest(1, 4 // t.labels) AS share,
      count(*) OVER (PARTITION BY g.video, g.label) AS n,
      row_number() OVER (PARTITION BY g.video, g.label ORDER BY g."start") - 1 AS pos FROM g JOIN t ON t.video = g.video)
    SELECT video, label, "start", "end", length FROM r WHERE total <= 4 OR {EVEN}"""
)
def sample_gaps(spark, d):
    gaps = detect.find_gaps(src.predictions(spark, d), max_gap=2, dense=True, block=src.event_block(spark, d))
    return select.sample_gaps(gaps.select("video", "label", "start", "end", "length"), 4, block=src.event_block(spark, d))


@query(
    f"""WITH RECURSIVE {SEVERE},
    ok AS (SELECT *, count(*) OVER (PARTITION BY video, label, "start") AS n,
      row_number() OVER (PARTITION BY video, label, "start" ORDER BY frame) - 1 AS pos, 2 AS share FROM repaired WHERE disagreement <= 2.0),
    o AS (SELECT *, row_number() OVER (PARTITION BY video, label ORDER BY frame) AS i FROM ok WHERE {EVEN}),
    walk AS (SELECT video, label, i, frame, frame AS last, true AS kept FROM o WHERE i = 1
      UNION ALL SELECT o.video, o.label, o.i, o.frame, CASE WHEN o.frame - w.last >= 10 THEN o.frame ELSE w.last END, o.frame - w.last >= 10
      FROM walk w JOIN o ON o.video = w.video AND o.label = w.label AND o.i = w.i + 1),
    kept AS (SELECT w.video, w.label, w.frame, o.x, o.y, o.disagreement, count(*) OVER (PARTITION BY w.video, w.label) AS n,
      row_number() OVER (PARTITION BY w.video, w.label ORDER BY w.frame) - 1 AS pos, count(*) OVER (PARTITION BY w.video) AS total
      FROM walk w JOIN o ON o.video = w.video AND o.label = w.label AND o.i = w.i WHERE w.kept),
    shared AS (SELECT *, greatest(1, CAST(round_even(n * 5.0::DOUBLE / total, 0) AS BIGINT)) AS share FROM kept)
    SELECT video, label, frame, {XY}, round(disagreement, 6) AS disagreement FROM shared WHERE total <= 5 OR {EVEN}"""
)
def select_training_frames(spark, d):
    repaired = repair.repair_gaps(severe_runs(spark, d), src.flow(spark, d), block=src.event_block(spark, d))
    return select.select_training_frames(repaired, max_frames=5, block=src.event_block(spark, d))


SHARED = """
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY {by}) AS r FROM pool) WHERE r = 1),
b AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.video ORDER BY {by_p}) AS r FROM pool p JOIN a ON a.video = p.video
      WHERE p.label <> a.label OR abs(p.frame - a.frame) >= 10) WHERE r = 1),
two AS (SELECT * FROM a UNION ALL SELECT * FROM b)
"""


@query(
    f"""WITH {SEVERE}, pool AS (SELECT video, label, frame, x, y, disagreement AS score FROM repaired WHERE disagreement <= 4.0),
    {SHARED.format(by="score, video, label, frame", by_p="p.score, p.video, p.label, p.frame")}
    SELECT video, label, frame, {XY}, round(score, 6) AS disagreement FROM two ORDER BY score, video, label, frame LIMIT 20"""
)
def select_across_videos(spark, d):
    """Two picks per video at most; enough candidates exist for the budget."""
    repaired = repair.repair_gaps(severe_runs(spark, d), src.flow(spark, d), block=src.event_block(spark, d))
    return select.select_across_videos(repaired, n=20, per_video_cap=2)


@query(
    f"""WITH {RESIDUAL}, pool AS (SELECT r.video, r.label, r.frame, p.x, p.y, r.residual AS score FROM resid r
      JOIN pred p ON p.video = r.video AND p.label = r.label AND p.frame = r.frame WHERE residual >= 1.0),
    {SHARED.format(by="score DESC, video DESC, label DESC, frame DESC", by_p="p.score DESC, p.video DESC, p.label DESC, p.frame DESC")}
    SELECT video, label, frame, {XY}, round(score, 6) AS residual FROM two ORDER BY score DESC, video DESC, label DESC, frame DESC LIMIT 20"""
)
def select_flow_blips(spark, d):
    pred = src.predictions(spark, d)
    residual = flow.flow_residual(pred, src.flow(spark, d), block=src.event_block(spark, d)).join(
        pred.select("video", "label", "frame", "x", "y"), ["video", "label", "frame"]
    )
    return select.select_flow_blips(residual, n=20, min_residual=1.0, per_video_cap=2)


# Picks by one greedy walk per video under a cap, then by one per trace for the room that is left.
FILLED = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY {by}) AS r FROM pool),
shares AS (
  SELECT DISTINCT video, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(label VARCHAR, frame BIGINT)[]) AS a FROM pool
  UNION ALL
  SELECT s.video, o.r, CASE WHEN len(s.a) < {cap} AND len(list_filter(s.a, lambda g: g.label = o.label AND abs(g.frame - o.frame) < {spacing})) = 0
    THEN list_append(s.a, struct_pack(label := o.label, frame := CAST(o.frame AS BIGINT))) ELSE s.a END
  FROM shares s JOIN ordered o ON o.video = s.video AND o.r = s.r + 1),
shared AS (SELECT video, unnest(arg_max(a, r)) AS g FROM shares GROUP BY video),
first AS (SELECT p.* FROM pool p JOIN shared s ON s.video = p.video AND s.g.label = p.label AND s.g.frame = p.frame ORDER BY {by_p} LIMIT {n}),
rest AS (SELECT p.*, row_number() OVER (PARTITION BY p.video, p.label ORDER BY {by_p}) AS r FROM pool p
  ANTI JOIN first f ON f.video = p.video AND f.label = p.label AND f.frame = p.frame),
walks AS (
  SELECT video, label, CAST(0 AS BIGINT) AS r, (SELECT coalesce(list(CAST(f.frame AS BIGINT)), CAST([] AS BIGINT[])) FROM first f WHERE f.video = t.video AND f.label = t.label) AS a
  FROM (SELECT DISTINCT video, label FROM rest) t
  UNION ALL
  SELECT w.video, w.label, o.r, CASE WHEN len(list_filter(w.a, lambda g: abs(g - o.frame) < {spacing})) = 0 THEN list_append(w.a, CAST(o.frame AS BIGINT)) ELSE w.a END
  FROM walks w JOIN rest o ON o.video = w.video AND o.label = w.label AND o.r = w.r + 1),
offers AS (SELECT video, label, unnest(arg_max(a, r)) AS frame FROM walks GROUP BY video, label),
fill AS (SELECT rest.* EXCLUDE (r) FROM rest JOIN offers o ON o.video = rest.video AND o.label = rest.label AND o.frame = rest.frame
  ORDER BY {by_o} LIMIT greatest(0, {n} - (SELECT count(*) FROM first))),
two AS (SELECT * FROM first UNION ALL SELECT * FROM fill)"""


@query(
    f"""WITH RECURSIVE {SEVERE}, pool AS (SELECT video, label, frame, x, y, disagreement AS score FROM repaired WHERE disagreement <= 4.0),
    {FILLED.format(by="score, video, label, frame", by_p="p.score, p.video, p.label, p.frame",
                   by_o="rest.score, rest.video, rest.label, rest.frame", cap=1, spacing=4, n=400)}
    SELECT video, label, frame, {XY}, round(score, 6) AS disagreement FROM two"""
)
def select_across_videos_filled(spark, d):
    """One pick per video at first; most of the budget is filled from any video."""
    repaired = repair.repair_gaps(severe_runs(spark, d), src.flow(spark, d), block=src.event_block(spark, d))
    return select.select_across_videos(repaired, n=400, per_video_cap=1, min_spacing=4)


@query(
    f"""WITH RECURSIVE {RESIDUAL}, pool AS (SELECT r.video, r.label, r.frame, p.x, p.y, r.residual AS score FROM resid r
      JOIN pred p ON p.video = r.video AND p.label = r.label AND p.frame = r.frame WHERE residual >= 1.0),
    {FILLED.format(by="score DESC, video DESC, label DESC, frame DESC", by_p="p.score DESC, p.video DESC, p.label DESC, p.frame DESC",
                   by_o="rest.score DESC, rest.video DESC, rest.label DESC, rest.frame DESC", cap=1, spacing=2, n=100000)}
    SELECT video, label, frame, {XY}, round(score, 6) AS residual FROM two"""
)
def select_flow_blips_filled(spark, d):
    """A budget beyond all rows: every row that keeps its distance."""
    pred = src.predictions(spark, d)
    residual = flow.flow_residual(pred, src.flow(spark, d), block=src.event_block(spark, d)).join(
        pred.select("video", "label", "frame", "x", "y"), ["video", "label", "frame"]
    )
    return select.select_flow_blips(residual, n=100_000, min_residual=1.0, per_video_cap=1, min_spacing=2)


ERRORS = BLIPS + """,
low AS (SELECT video, frame FROM (SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY min(likelihood), frame) AS r
    FROM pred GROUP BY video, frame HAVING min(likelihood) < 0.6) WHERE r <= 200),
flagged AS (SELECT p.video, p.label, p.frame FROM pred p WHERE likelihood >= 0.9 AND EXISTS (SELECT 1 FROM blips b
    WHERE b.video = p.video AND b.label = p.label AND p.frame BETWEEN b."start" AND b."end")),
errs AS (SELECT p.video, p.label, p.frame, p.x, p.y, 'low_confidence' AS kind FROM pred p JOIN low ON low.video = p.video AND low.frame = p.frame
    WHERE NOT EXISTS (SELECT 1 FROM flagged g WHERE g.video = p.video AND g.frame = p.frame)
  UNION ALL
  SELECT p.video, p.label, p.frame, CASE WHEN g.frame IS NOT NULL THEN coalesce(f.x, p.x) ELSE p.x END,
    CASE WHEN g.frame IS NOT NULL THEN coalesce(f.y, p.y) ELSE p.y END, 'blip'
  FROM pred p JOIN (SELECT DISTINCT video, frame FROM flagged) d ON d.video = p.video AND d.frame = p.frame
  LEFT JOIN flagged g ON g.video = p.video AND g.label = p.label AND g.frame = p.frame
  LEFT JOIN lk f ON f.video = p.video AND f.label = p.label AND f.frame = p.frame)
"""


@query(f"WITH {ERRORS} SELECT video, label, frame, {XY}, kind FROM errs")
def error_frames(spark, d):
    return select.error_frames(src.predictions(spark, d), src.flow(spark, d), block=src.event_block(spark, d))


@query(
    f"""WITH {EVENTS}, u AS (
      SELECT DISTINCT video, 'img' || lpad(CAST(frame AS VARCHAR), 6, '0') || '.png' AS image, CAST(NULL AS BIGINT) AS frame, 'labeled' AS source, 0 AS p FROM pred WHERE frame % 5 = 0
      UNION ALL SELECT DISTINCT video, NULL, frame, 'low', 1 FROM pred WHERE likelihood < 0.6
      UNION ALL SELECT DISTINCT video, NULL, frame, 'other', 2 FROM pred WHERE k % 4 = 0)
    SELECT video, image, frame, source FROM (SELECT *, row_number() OVER (PARTITION BY video, image, frame ORDER BY p) AS r FROM u) WHERE r = 1"""
)
def union_sources(spark, d):
    pred = src.predictions(spark, d, with_event=True)
    none = F.lit(None)
    labeled = pred.where(F.col("frame") % 5 == 0).select(
        "video", image_name("frame", width=6).alias("image"), none.cast("long").alias("frame"), F.lit("labeled").alias("source")
    )
    marked = lambda cond, name: pred.where(cond).select(
        "video", none.cast("string").alias("image"), "frame", F.lit(name).alias("source")
    )
    sources = [labeled, marked(F.col("likelihood") < 0.6, "low"), marked(F.col("k") % 4 == 0, "other")]
    return select.union_sources(*[s.distinct() for s in sources])


@query(
    f"""WITH {MANUAL}, two AS (SELECT * FROM manual WHERE label IN ('0', '1'))
    SELECT video, layer, frame, count(*) AS n_points, string_agg(label, ',' ORDER BY label) AS labels, round(sum(x), 6) AS sum_x
    FROM two GROUP BY video, layer, frame HAVING count(*) = 2"""
)
def complete_frame_entries(spark, d):
    manual = src.manual_layer(spark, d)
    entries = select.complete_frame_entries(manual, src.declared_pair(manual))
    return entries.select(
        "video", "layer", "frame", F.size("points").alias("n_points"),
        F.array_join(F.transform("points", lambda p: p["label"]), ",").alias("labels"),
        F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p["x"]).alias("sum_x"),
    )


@query(
    f"""WITH {MANUAL} SELECT video, CASE WHEN CAST(substr(video, 2) AS BIGINT) % 2 = 0 THEN 'iteration-0_diverse2' ELSE 'iteration-0_diverse' END AS layer,
    label, frame, {XY} FROM manual m WHERE EXISTS (SELECT 1 FROM pred p WHERE p.video = m.video AND p.frame = m.frame AND p.likelihood < 0.9)"""
)
def materialize_selection(spark, d):
    manual = src.manual_layer(spark, d)
    used = manual.select("video", "layer").distinct()
    even = used.where(F.substring("video", 2, 20).cast("long") % 2 == 0)
    layers = used.unionByName(even.withColumn("layer", F.lit("iteration-0_diverse")))
    kept = src.predictions(spark, d).where(F.col("likelihood") < 0.9).select("video", "frame")
    return select.materialize_selection(manual, kept, layers, "iteration-0")


@query()
def refine_cohort(spark, d):
    """Find, repair, choose and complete over all videos."""
    pred, steps = src.predictions(spark, d), src.flow(spark, d)
    return workflows.refine_cohort(pred, steps, flow_positions=flow.flow_layer(pred, steps), n=60, max_gap=8, block=src.event_block(spark, d))
