"""Queries over layers: filters, label schema, merges, edits and differences."""

from pyspark.sql import functions as F

from trackspark.catalog.base import EVENTS, INTERVALS, MANUAL, query
from trackspark.operators import layers
from trackspark.sources import adapters as src

XY = "round(x, 6) AS x, round(y, 6) AS y"
PAIR = """
pair AS (SELECT DISTINCT m.video, m.layer, l.label, l.pos FROM manual m CROSS JOIN (VALUES ('0', 0), ('1', 1)) l(label, pos))
"""
COMPLETE = MANUAL + "," + PAIR + """,
comp AS (SELECT m.video, m.layer, m.frame FROM manual m JOIN pair p
           ON p.video = m.video AND p.layer = m.layer AND p.label = m.label
         GROUP BY m.video, m.layer, m.frame HAVING count(*) = 2)
"""


@query(f"WITH {MANUAL} SELECT video, layer, label, frame, {XY} FROM manual WHERE frame BETWEEN 10 AND 40")
def clip_frames(spark, d):
    return layers.clip_frames(src.manual_layer(spark, d), 10, 40)


@query(
    f"""WITH {EVENTS}, {INTERVALS}, n AS (SELECT video, max(frame) AS last FROM pred GROUP BY video),
    c AS (SELECT s.video, s.label, least(greatest("end" * 3 - 60, 0), last) AS a, least(greatest("start" * 9, 0), last) AS b
          FROM spans s JOIN n ON s.video = n.video)
    SELECT video, label, least(a, b) AS "start", greatest(a, b) AS "end" FROM c"""
)
def normalize_intervals(spark, d):
    raw = src.intervals(spark, d).select(
        "video", "label", (F.col("end") * 3 - 60).alias("start"), (F.col("start") * 9).alias("end")
    )
    return layers.normalize_intervals(raw, src.event_videos(spark, d))


@query(
    f"""WITH {MANUAL}, {INTERVALS} SELECT video, layer, label, frame, {XY} FROM manual m WHERE NOT EXISTS (
      SELECT 1 FROM spans s WHERE s.video = m.video AND s.label = m.label AND m.frame BETWEEN s."start" AND s."end")"""
)
def remove_interval_current_label(spark, d):
    return layers.remove_intervals(src.manual_layer(spark, d), src.intervals(spark, d))


@query(
    f"""WITH {MANUAL}, {INTERVALS} SELECT video, layer, label, frame, {XY} FROM manual m WHERE label NOT IN ('0', '1') OR NOT EXISTS (
      SELECT 1 FROM spans s WHERE s.video = m.video AND m.frame BETWEEN s."start" AND s."end")"""
)
def remove_interval_overlay_labels(spark, d):
    overlay = src.declared_pair(src.dense_layer(spark, d))
    return layers.remove_intervals(
        src.manual_layer(spark, d), src.intervals(spark, d), all_labels=True, overlay_declared=overlay
    )


@query(
    f"""WITH {MANUAL}, {PAIR} SELECT p.video, p.layer, p.label, CAST(25 AS BIGINT) AS frame, round(m.x, 6) AS x, round(m.y, 6) AS y
    FROM pair p LEFT JOIN manual m ON m.video = p.video AND m.layer = p.layer AND m.label = p.label AND m.frame = 25"""
)
def points_at_frame(spark, d):
    manual = src.manual_layer(spark, d)
    return layers.points_at_frame(manual, src.declared_pair(manual), 25)


@query(f"WITH {MANUAL} SELECT DISTINCT video, layer, frame FROM manual")
def layer_frames(spark, d):
    return layers.layer_frames(src.manual_layer(spark, d))


@query(
    f"""WITH {MANUAL}, n AS (SELECT video, max(frame) + 1 AS n_frames FROM pred GROUP BY video)
    SELECT m.video, m.layer, CAST(3 AS BIGINT) AS n_labels, count(DISTINCT frame) AS n_annotated_frames, count(*) AS n_points,
      max(n_frames) AS n_frames FROM manual m JOIN n ON n.video = m.video GROUP BY m.video, m.layer"""
)
def layer_summary(spark, d):
    manual = src.manual_layer(spark, d)
    return layers.layer_summary(manual, src.declared(manual), src.event_videos(spark, d))


@query(
    f"""WITH {COMPLETE} SELECT video, layer, label, frame, {XY} FROM manual m
    WHERE EXISTS (SELECT 1 FROM comp c WHERE c.video = m.video AND c.layer = m.layer AND c.frame = m.frame)
       OR NOT EXISTS (SELECT 1 FROM comp c WHERE c.video = m.video AND c.layer = m.layer)"""
)
def keep_complete_frames(spark, d):
    manual = src.manual_layer(spark, d)
    return layers.keep_complete_frames(manual, src.declared_pair(manual))


@query(
    f"""WITH {EVENTS}, kept AS (SELECT video, 'iteration-0' AS layer, label, frame, x, y FROM pred WHERE label = '0' OR k >= 60),
    comp AS (SELECT video, frame FROM kept GROUP BY video, frame HAVING count(*) = 2),
    near AS (SELECT c.video, c.frame FROM comp c WHERE EXISTS (
      SELECT 1 FROM comp o WHERE o.video = c.video AND abs(o.frame - c.frame) = 1))
    SELECT video, layer, label, frame, {XY} FROM kept m
    WHERE EXISTS (SELECT 1 FROM near c WHERE c.video = m.video AND c.frame = m.frame)
       OR NOT EXISTS (SELECT 1 FROM near c WHERE c.video = m.video)"""
)
def keep_complete_runs(spark, d):
    rows = src.predictions(spark, d, with_event=True).where((F.col("label") == "0") | (F.col("k") >= 60))
    rows = rows.select("video", F.lit("iteration-0").alias("layer"), "label", "frame", "x", "y")
    return layers.keep_complete_runs(rows, src.declared_pair(rows), block=src.event_block(spark, d))


@query(
    f"""WITH {MANUAL}, n AS (SELECT video, max(frame) + 1 AS n_frames FROM pred GROUP BY video),
    spine AS (SELECT n.video, 'iteration-0' AS layer, l.label, f.frame FROM n
      CROSS JOIN (VALUES ('0'), ('1')) l(label), LATERAL (SELECT unnest(range(n.n_frames)) AS frame) f)
    SELECT s.video, s.layer, s.label, s.frame, round(m.x, 6) AS x, round(m.y, 6) AS y, round(s.frame / 30.0, 6) AS t
    FROM spine s LEFT JOIN manual m ON m.video = s.video AND m.label = s.label AND m.frame = s.frame"""
)
def densify(spark, d):
    manual = src.manual_layer(spark, d)
    return layers.densify(manual, src.declared_pair(manual), src.event_videos(spark, d))


# Label 1 only where a video has a frame with k >= 97; label 4 is declared empty.
SPARSE = EVENTS + """,
sparse AS (SELECT video, 'iteration-0' AS layer, label, frame FROM pred WHERE frame % 5 = 0 AND (label = '0' OR k >= 97)),
decl AS (SELECT DISTINCT video, layer, l.label, l.pos FROM sparse CROSS JOIN (VALUES ('0', 0::BIGINT), ('1', 1::BIGINT), ('4', 2::BIGINT)) l(label, pos)),
filled AS (SELECT DISTINCT video, layer, label FROM sparse)
"""


def _sparse(spark, d):
    rows = src.predictions(spark, d, with_event=True).where(
        (F.col("frame") % 5 == 0) & ((F.col("label") == "0") | (F.col("k") >= 97))
    )
    rows = rows.select("video", F.lit("iteration-0").alias("layer"), "label", "frame", "x", "y")
    return rows, src.declared_pair(rows, ("0", "1", "4"))


@query(f"WITH {SPARSE} SELECT decl.* FROM decl JOIN filled USING (video, layer, label)")
def remove_empty_labels(spark, d):
    rows, decl = _sparse(spark, d)
    return layers.remove_empty_labels(decl, rows)


@query(
    f"""WITH {SPARSE}, last AS (SELECT decl.video, max(pos) AS last FROM decl JOIN filled USING (video, layer, label) GROUP BY decl.video)
    SELECT decl.* FROM decl JOIN last ON last.video = decl.video WHERE pos <= last"""
)
def clip_trailing_empty_labels(spark, d):
    rows, decl = _sparse(spark, d)
    return layers.clip_trailing_empty_labels(decl, rows)


@query(
    f"""WITH {SPARSE} SELECT video, layer, label, row_number() OVER (PARTITION BY video, layer ORDER BY CAST(label AS INT)) - 1 AS pos
    FROM (SELECT video, layer, label FROM decl UNION SELECT video, layer, '3' FROM decl)"""
)
def add_label(spark, d):
    return layers.add_label(_sparse(spark, d)[1])


@query(
    f"""WITH {MANUAL}, l AS (SELECT DISTINCT video, layer, label FROM manual UNION SELECT DISTINCT video, layer, label FROM patch)
    SELECT a.video, a.layer, b.label, row_number() OVER (PARTITION BY a.video, a.layer ORDER BY CAST(b.label AS INT)) - 1 AS pos
    FROM (SELECT DISTINCT video, layer FROM l) a JOIN (SELECT DISTINCT video, label FROM l) b ON a.video = b.video"""
)
def union_labels_across_layers(spark, d):
    both = src.manual_layer(spark, d).unionByName(src.patch_layer_points(spark, d))
    return layers.union_labels_across_layers(src.declared(both))


@query(
    f"""WITH {MANUAL}, v AS (SELECT DISTINCT video FROM manual)
    SELECT DISTINCT video, layer, label, CAST(CASE label WHEN '0' THEN 0 WHEN '1' THEN 1 ELSE 2 END AS BIGINT) AS pos FROM manual
    UNION ALL SELECT video, 'iteration-1', l.label, l.pos FROM v CROSS JOIN (VALUES ('2', 0), ('10', 1)) l(label, pos)"""
)
def reset_empty_layer_labels(spark, d):
    from trackspark.functions.names import is_manual

    manual = src.manual_layer(spark, d)
    fresh = manual.select("video").distinct().select(
        "video", F.lit("iteration-1").alias("layer"), F.lit("0").alias("label"), F.lit(0).alias("pos")
    )
    decl = src.declared(manual).unionByName(fresh)
    return layers.reset_empty_layer_labels(decl, manual, ["10", "2"], is_manual("layer"))


@query(f"WITH {MANUAL} SELECT video, layer, label, frame, {XY} FROM manual ORDER BY video, layer, CAST(label AS INT), frame")
def ordered_points(spark, d):
    return layers.order_points(src.manual_layer(spark, d))


@query(
    f"""WITH {MANUAL},
    log AS (
      SELECT video, layer, label, frame, x, y, 'add' AS op, -1 AS seq FROM manual
      UNION ALL SELECT video, 'iteration-0', label, frame, x + 2, y - 1, 'add', event_id FROM pred WHERE frame % 10 = 0
      UNION ALL SELECT video, 'iteration-0', label, frame, NULL, NULL, 'delete', event_id + 1000000000 FROM pred WHERE frame % 15 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY video, layer, label, frame ORDER BY seq DESC) AS r FROM log)
    SELECT video, layer, label, frame, {XY} FROM r WHERE r = 1 AND op <> 'delete'"""
)
def apply_edits(spark, d):
    pred = src.predictions(spark, d, with_event=True)
    key = ["video", F.lit("iteration-0").alias("layer"), "label", "frame"]
    adds = pred.where(F.col("frame") % 10 == 0).select(
        *key, (F.col("x") + 2).alias("x"), (F.col("y") - 1).alias("y"), F.lit("add").alias("op"), F.col("event_id").alias("seq")
    )
    cuts = pred.where(F.col("frame") % 15 == 0).select(
        *key, F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"),
        F.lit("delete").alias("op"), (F.col("event_id") + 1000000000).alias("seq"),
    )
    return layers.apply_edits(src.manual_layer(spark, d), adds.unionByName(cuts))


@query(f"WITH {MANUAL} SELECT video, 'iteration-1' AS layer, label, frame, {XY} FROM manual")
def rename_layer(spark, d):
    manual = src.manual_layer(spark, d)
    return layers.rename_layer(manual, src.declared(manual), "iteration-0", "iteration-1")


@query(
    f"""WITH {MANUAL}, p AS (SELECT * FROM patch WHERE CAST(substr(video, 2) AS BIGINT) % 2 = 0)
    SELECT video, layer, label, frame, {XY} FROM manual WHERE CAST(substr(video, 2) AS BIGINT) % 2 = 1
    UNION ALL SELECT video, layer, label, frame, {XY} FROM p"""
)
def drop_layer(spark, d):
    """Videos that only have this layer keep it."""
    patch = src.patch_layer_points(spark, d).where(F.substring("video", 2, 20).cast("long") % 2 == 0)
    both = src.manual_layer(spark, d).unionByName(patch)
    return layers.drop_layer(both, src.declared(both), "iteration-0")


@query(
    f"""WITH {EVENTS}, t AS (SELECT video, frame % 20 AS frame FROM ev WHERE k % 3 = 0)
    SELECT video, frame FROM t GROUP BY video, frame HAVING count(*) % 2 = 1"""
)
def frames_of_interest(spark, d):
    marks = src.event_frames(spark, d).where(F.col("k") % 3 == 0)
    return layers.toggle_frames(marks.select("video", (F.col("frame") % 20).alias("frame")))


MERGED = """SELECT video, '{name}' AS layer, label, frame, {xy} FROM (
  SELECT *, row_number() OVER (PARTITION BY video, label, frame ORDER BY p DESC) AS r FROM ({body})) WHERE r = 1"""
PATCHED = MANUAL + """, dense AS (SELECT video, label, frame, x, y FROM pred),
patched AS (SELECT coalesce(p.video, s.video) AS video, coalesce(p.label, s.label) AS label, coalesce(p.frame, s.frame) AS frame,
   CASE WHEN p.video IS NOT NULL THEN p.x ELSE s.x END AS x, CASE WHEN p.video IS NOT NULL THEN p.y ELSE s.y END AS y
   FROM {source} s FULL OUTER JOIN {patch} p ON p.video = s.video AND p.label = s.label AND p.frame = s.frame)
SELECT video, '{name}' AS layer, label, frame, round(x, 6) AS x, round(y, 6) AS y FROM patched"""


@query(
    f"WITH {MANUAL} "
    + MERGED.format(name="merged", xy=XY, body="SELECT *, 0 AS p FROM manual UNION ALL SELECT *, 1 AS p FROM patch")
)
def merge_layers(spark, d):
    both = src.manual_layer(spark, d).unionByName(src.patch_layer_points(spark, d))
    return layers.merge_layers(both, F.when(F.col("layer") == "patch", 1).otherwise(0))


@query("WITH " + PATCHED.format(source="dense", patch="manual", name="patched"))
def patch_layer(spark, d):
    return layers.patch_layer(src.dense_layer(spark, d), src.manual_layer(spark, d))


@query("WITH " + PATCHED.format(source="dense", patch="(SELECT * FROM manual WHERE label IN ('0', '1'))", name="spliced"))
def splice_corrections(spark, d):
    dense = src.dense_layer(spark, d)
    return layers.splice_corrections(dense, src.manual_layer(spark, d), src.declared_pair(dense))


@query("WITH " + PATCHED.format(
    source="manual", patch="(SELECT * FROM pred WHERE frame % 6 = 1 AND label IN ('0', '1'))", name="iteration-0"))
def copy_overlay_at_frames(spark, d):
    manual, dense = src.manual_layer(spark, d), src.dense_layer(spark, d)
    marks = dense.where(F.col("frame") % 6 == 1).select("video", "frame")
    return layers.copy_from_overlay(manual, dense, src.declared(manual), frames=marks)


@query(f"WITH {INTERVALS}, " + PATCHED.format(
    source="manual", name="iteration-0",
    patch="""(SELECT p.video, p.label, p.frame, p.x, p.y FROM pred p JOIN spans s ON s.video = p.video AND s.label = p.label
             AND p.frame BETWEEN s."start" AND s."end")"""))
def copy_overlay_in_interval(spark, d):
    manual = src.manual_layer(spark, d)
    return layers.copy_from_overlay(
        manual, src.dense_layer(spark, d), src.declared(manual), intervals=src.intervals(spark, d)
    )


@query("WITH " + PATCHED.format(
    source="manual", name="iteration-0",
    patch="(SELECT p.* FROM pred p WHERE EXISTS (SELECT 1 FROM manual m WHERE m.video = p.video AND m.frame = p.frame))"))
def copy_overlay_existing(spark, d):
    manual = src.manual_layer(spark, d)
    return layers.copy_from_overlay(manual, src.dense_layer(spark, d), src.declared(manual), existing=True)


@query(f"WITH {INTERVALS}, " + PATCHED.format(
    source="manual", name="iteration-0",
    patch="""(SELECT p.video, p.label, p.frame, (p.x + q.x) / 2 AS x, (p.y + q.y) / 2 AS y FROM manual p
             JOIN patch q ON q.video = p.video AND q.label = p.label AND q.frame = p.frame
             JOIN spans s ON s.video = p.video AND p.frame BETWEEN s."start" AND s."end")"""))
def average_with_overlay(spark, d):
    spans = src.intervals(spark, d).drop("label")
    return layers.average_with_overlay(src.manual_layer(spark, d), src.patch_layer_points(spark, d), spans)


DIFF = MANUAL + """,
disk AS (SELECT video, 'iteration-0' AS layer, label, frame, CASE WHEN k % 4 = 0 THEN x + 0.5 ELSE x END AS x, y FROM pred
         WHERE frame % 5 = 0 AND k % 7 <> 0),
delta AS (SELECT coalesce(m.video, o.video) AS video, coalesce(m.layer, o.layer) AS layer, coalesce(m.label, o.label) AS label,
   coalesce(m.frame, o.frame) AS frame, CASE WHEN o.video IS NULL THEN 'added' WHEN m.video IS NULL THEN 'removed'
     WHEN m.x IS DISTINCT FROM o.x OR m.y IS DISTINCT FROM o.y THEN 'modified' END AS status
   FROM manual m FULL OUTER JOIN disk o ON o.video = m.video AND o.label = m.label AND o.frame = m.frame)
"""


def disk_state(spark, d):
    rows = src.predictions(spark, d, with_event=True).where((F.col("frame") % 5 == 0) & (F.col("k") % 7 != 0))
    x = F.when(F.col("k") % 4 == 0, F.col("x") + 0.5).otherwise(F.col("x"))
    return rows.select("video", F.lit("iteration-0").alias("layer"), "label", "frame", x.alias("x"), "y")


@query(f"WITH {DIFF} SELECT video, layer, label, frame, status FROM delta WHERE status IS NOT NULL")
def diff_layers(spark, d):
    return layers.diff_layers(src.manual_layer(spark, d), disk_state(spark, d))


@query(
    f"""WITH {DIFF} SELECT video, layer, count(*) FILTER (status = 'added') AS n_added, count(*) FILTER (status = 'removed') AS n_removed,
    count(*) FILTER (status = 'modified') AS n_modified FROM delta WHERE status IS NOT NULL GROUP BY video, layer"""
)
def diff_summary(spark, d):
    return layers.diff_summary(layers.diff_layers(src.manual_layer(spark, d), disk_state(spark, d)))
