"""Queries over the completeness and consistency of manual layers."""

from pyspark.sql import functions as F

from trackspark.catalog.base import EVENTS, MANUAL, query
from trackspark.catalog.layering import DIFF, disk_state
from trackspark.operators import quality
from trackspark.session import scratch_dir
from trackspark.sources import adapters as src
from trackspark.sources.files import dropped_sidecar as sidecar
from trackspark.sources.files import read_dropped_sidecar, write_dropped_sidecar

PAIR = ["0", "1"]
LACKING = """
lack AS (SELECT f.video, f.layer, f.frame, l.label, l.n FROM (SELECT DISTINCT video, layer, frame FROM manual) f
   CROSS JOIN {labels} l(label, n)
   WHERE NOT EXISTS (SELECT 1 FROM manual m WHERE m.video = f.video AND m.frame = f.frame AND m.label = l.label))
"""
PAIR_LACKING = LACKING.format(labels="(VALUES ('0', 0), ('1', 1))")


def _joined(df):
    return df.withColumn("missing", F.array_join("missing", ","))


@query(
    f"""WITH {MANUAL}, {PAIR_LACKING} SELECT video, layer, frame, string_agg(label, ',' ORDER BY n) AS missing
    FROM lack GROUP BY video, layer, frame"""
)
def incomplete_frames(spark, d):
    return _joined(quality.incomplete_frames(src.manual_layer(spark, d), PAIR))


@query(
    f"""WITH {MANUAL}, {LACKING.format(labels="(VALUES ('0', 0), ('1', 1), ('9', 9))")}
    SELECT video, layer, frame, string_agg(label, ',' ORDER BY n) AS missing FROM lack
    WHERE EXISTS (SELECT 1 FROM manual m WHERE m.video = lack.video AND m.label = lack.label)
    GROUP BY video, layer, frame"""
)
def incomplete_frames_own_labels(spark, d):
    return _joined(quality.incomplete_frames(src.manual_layer(spark, d)))


@query(f"WITH {MANUAL}, {PAIR_LACKING} SELECT video, layer, label, count(*) AS n_frames FROM lack GROUP BY video, layer, label")
def incomplete_breakdown(spark, d):
    return quality.incomplete_breakdown(quality.incomplete_frames(src.manual_layer(spark, d), PAIR))


@query(f"WITH {MANUAL} SELECT video, layer, label, frame FROM manual WHERE label NOT IN ('0', '1')")
def stray_labels(spark, d):
    return quality.stray_labels(src.manual_layer(spark, d), PAIR)


@query(f"WITH {MANUAL} SELECT video, layer, bool_or(label NOT IN ('0', '1')) AS has_strays FROM manual GROUP BY video, layer")
def has_strays(spark, d):
    return quality.has_strays(src.manual_layer(spark, d), PAIR)


ISSUES = DIFF + f""", {PAIR_LACKING},
issues AS (
  SELECT video, layer, 'incomplete' AS issue, label, frame FROM lack
  UNION ALL SELECT video, layer, 'stray', label, frame FROM manual WHERE label NOT IN ('0', '1')
  UNION ALL SELECT video, layer, status, label, frame FROM delta WHERE status IS NOT NULL)
"""


@query(f"WITH {ISSUES} SELECT * FROM issues")
def quality_issues(spark, d):
    return quality.quality_issues(src.manual_layer(spark, d), disk_state(spark, d), PAIR)


@query(
    f"""WITH {ISSUES},
    t AS (SELECT video, layer, count(DISTINCT frame) FILTER (issue = 'incomplete') AS n_incomplete_frames,
      count(*) FILTER (issue = 'added') AS n_added, count(*) FILTER (issue = 'removed') AS n_removed,
      count(*) FILTER (issue = 'modified') AS n_modified, count(*) FILTER (issue = 'stray') AS n_stray
      FROM issues GROUP BY video, layer)
    SELECT *, concat_ws('; ',
      CASE WHEN n_added + n_removed + n_modified > 0 THEN 'unsaved: +' || n_added || ' -' || n_removed || ' ~' || n_modified END,
      CASE WHEN n_incomplete_frames > 0 THEN 'incomplete frames: ' || n_incomplete_frames END,
      CASE WHEN n_stray > 0 THEN 'stray points: ' || n_stray END) AS summary FROM t"""
)
def quality_report(spark, d):
    return quality.quality_report(quality_issues(spark, d))


@query(
    f"""WITH {MANUAL}, {PAIR_LACKING} SELECT video, layer, label, frame, round(x, 6) AS x, round(y, 6) AS y FROM manual m
    WHERE label IN ('0', '1') AND NOT EXISTS (SELECT 1 FROM lack l WHERE l.video = m.video AND l.frame = m.frame)"""
)
def remediate(spark, d):
    return quality.remediate(src.manual_layer(spark, d), PAIR)


@query(
    f"""WITH {MANUAL}, {PAIR_LACKING} SELECT video, layer, label, frame, round(x, 6) AS x, round(y, 6) AS y FROM manual m
    WHERE EXISTS (SELECT 1 FROM lack l WHERE l.video = m.video AND l.frame = m.frame)"""
)
def dropped_points(spark, d):
    return quality.dropped_points(src.manual_layer(spark, d), PAIR)


SIDECAR = f"""WITH {MANUAL}, {PAIR_LACKING} SELECT video, layer, frame, count(*) AS n_present, string_agg(label, ',' ORDER BY label) AS labels
    FROM manual m WHERE EXISTS (SELECT 1 FROM lack l WHERE l.video = m.video AND l.frame = m.frame) GROUP BY video, layer, frame"""


def _present(rows):
    present = F.from_json("present", "map<string,array<double>>")
    return rows.select(
        "video", "layer", "frame", F.size(present).alias("n_present"),
        F.array_join(F.array_sort(F.map_keys(present)), ",").alias("labels"),
    )


@query(SIDECAR)
def dropped_sidecar(spark, d):
    """The sidecar's JSON, read back."""
    return _present(sidecar(src.manual_layer(spark, d), PAIR))


@query(SIDECAR)
def dropped_sidecar_file(spark, d):
    """The sidecar written beside layer files, and read back from there."""
    manual, target = src.manual_layer(spark, d), scratch_dir(spark, "project")
    write_dropped_sidecar(manual, f"{target}/dropped", PAIR)
    return _present(read_dropped_sidecar(spark, f"{target}/dropped"))


@query(f"WITH {MANUAL} SELECT count(*) > 0 AS has_trainable_labels FROM manual")
def has_trainable_labels(spark, d):
    return quality.has_trainable_labels(src.manual_layer(spark, d))


@query(
    f"""WITH {EVENTS}, decl AS (SELECT DISTINCT video, label FROM pred UNION
      SELECT DISTINCT video, '10' FROM pred WHERE CAST(substr(video, 2) AS BIGINT) % 10 = 3),
    s AS (SELECT video, string_agg(label, ',' ORDER BY label) AS labels, count(*) AS n FROM decl GROUP BY video),
    u AS (SELECT label, count(*) AS c FROM decl GROUP BY label)
    SELECT (SELECT count(*) FROM s) AS n_videos, (SELECT count(DISTINCT n) FROM s) <= 1 AS same_count,
      (SELECT count(DISTINCT labels) FROM s) <= 1 AS same_names,
      (SELECT coalesce(string_agg(label, ',' ORDER BY label), '') FROM u WHERE c < (SELECT count(*) FROM s)) AS missing_somewhere,
      (SELECT string_agg('point' || label, ',' ORDER BY 'point' || label) FROM u) AS bodyparts"""
)
def check_label_schema(spark, d):
    pred = src.predictions(spark, d).select("video", "label").distinct()
    odd = pred.select("video").distinct().where(F.substring("video", 2, 20).cast("long") % 10 == 3)
    decl = pred.unionByName(odd.withColumn("label", F.lit("10")))
    out = quality.check_label_schema(decl)
    return out.withColumns(
        {c: F.array_join(c, ",") for c in ("missing_somewhere", "bodyparts")}
    )
