"""Queries over names of files, layers and labels, built from order and part keys."""

from pyspark.sql import functions as F

from trackspark.catalog.base import query
from trackspark.functions import names
from trackspark.sources.adapters import table
from trackspark.sources.files import classify_files

# One file path per order, in the forms a project holds.
PATHS = """
paths AS (SELECT o_orderkey AS k, o_custkey AS c, CASE o_orderkey % 6
    WHEN 0 THEN '/data/proj/videos/v' || o_custkey || '_annotations.json'
    WHEN 1 THEN '/data/proj/videos/v' || o_custkey || '_annotations_iter_' || (o_orderkey % 4) || '.json'
    WHEN 2 THEN '/data/proj/videos/iteration-' || (o_orderkey % 3) || '/v' || o_custkey || 'DLC_net_shuffle1_' || (o_orderkey % 7 * 100) || '.csv'
    WHEN 3 THEN '/data/proj/videos/iteration-1/v' || o_custkey || 'DLC_net_200_lkmovavg_0.5.json'
    WHEN 4 THEN '/data/proj/videos/v' || o_custkey || '.mp4'
    ELSE '/data/proj/videos/v' || o_custkey || '_annotations__dlccorr_.json' END AS path,
  '/data/proj/videos/v' || (o_custkey - o_custkey % 2) || '.mp4' AS video_path FROM orders)
"""


def paths(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    base = "/data/proj/videos/"
    text = lambda v: v.cast("string")
    path = (
        F.when(k % 6 == 0, F.concat(F.lit(base + "v"), c, F.lit("_annotations.json")))
        .when(k % 6 == 1, F.concat(F.lit(base + "v"), c, F.lit("_annotations_iter_"), text(k % 4), F.lit(".json")))
        .when(
            k % 6 == 2,
            F.concat(F.lit(base + "iteration-"), text(k % 3), F.lit("/v"), c, F.lit("DLC_net_shuffle1_"), text(k % 7 * 100), F.lit(".csv")),
        )
        .when(k % 6 == 3, F.concat(F.lit(base + "iteration-1/v"), c, F.lit("DLC_net_200_lkmovavg_0.5.json")))
        .when(k % 6 == 4, F.concat(F.lit(base + "v"), c, F.lit(".mp4")))
        .otherwise(F.concat(F.lit(base + "v"), c, F.lit("_annotations__dlccorr_.json")))
    )
    cust = F.col("o_custkey")
    video = F.concat(F.lit(base + "v"), text(cust - cust % 2), F.lit(".mp4"))
    return table(spark, d, "orders").select(k.alias("k"), cust.alias("c"), path.alias("path"), video.alias("video_path"))


NAMED = PATHS + """,
parts AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS file FROM paths),
stems AS (SELECT *, regexp_replace(file, '\\.[^.]+$', '') AS stem FROM parts),
named AS (SELECT *, CASE WHEN contains(stem, '_annotations') THEN trim(list_last(string_split(stem, '_annotations')), '_')
    WHEN contains(stem, 'DLC') THEN 'dlc_' || string_split(path, '/')[-2] || '_' || list_last(string_split(stem, '_'))
    ELSE stem END AS layer FROM stems)
"""


@query(f"WITH {NAMED} SELECT k, path, layer, string_split(stem, '_annotations')[1] AS video FROM named")
def layer_name(spark, d):
    return paths(spark, d).select(
        "k", "path", names.layer_name("path").alias("layer"), names.video_name("path").alias("video")
    )


@query(
    f"""WITH {NAMED} SELECT k, layer, layer LIKE 'dlc\\_%' ESCAPE '\\' OR layer LIKE 'dlccorr%' OR layer LIKE 'lk\\_%' ESCAPE '\\'
      OR layer LIKE 'deblip%' OR contains(layer, 'lkmovavg') AS dense FROM named"""
)
def is_dense(spark, d):
    layer = names.layer_name("path")
    return paths(spark, d).select("k", layer.alias("layer"), names.is_dense(layer).alias("dense"))


@query(
    f"""WITH {NAMED}, m AS (SELECT *, layer NOT IN ('dlccorr', 'buffer') AND NOT (layer LIKE 'dlc%' OR layer LIKE 'lk\\_%' ESCAPE '\\'
      OR layer LIKE 'blips%' OR layer LIKE 'deblip%') AS manual,
      regexp_replace(regexp_extract(video_path, '([^/]*)$', 1), '\\.[^.]+$', '') || '_annotations' AS base FROM named)
    SELECT k, layer, manual, manual AND path LIKE '%.json' AND path LIKE '/data/proj/videos/v%'
      AND (stem = base OR starts_with(stem, base || '_')) AS manual_file FROM m"""
)
def is_manual(spark, d):
    layer = names.layer_name("path")
    return paths(spark, d).select(
        "k", layer.alias("layer"), names.is_manual(layer).alias("manual"),
        names.is_manual(layer, "path", "video_path").alias("manual_file"),
    )


@query(
    f"""WITH {PATHS} SELECT k, CASE WHEN k % 3 = 0 THEN '/data/proj/videos/v' || (c - c % 2) || '_annotations.json'
    ELSE '/data/proj/videos/v' || (c - c % 2) || '_annotations_it' || (k % 5) || '.json' END AS path FROM paths"""
)
def layer_path(spark, d):
    layer = F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("it"), (F.col("k") % 5).cast("string")))
    return paths(spark, d).select("k", names.layer_path("video_path", layer).alias("path"))


PARTS = """
bp AS (SELECT DISTINCT 'f' || (p_partkey % 40) AS file, p_partkey % 11 AS pos,
   CASE WHEN (p_partkey % 40) % 3 = 0 THEN 'joint' || chr(CAST(97 + (p_partkey * 7) % 11 AS INT)) ELSE 'point' || (p_partkey % 11) END AS bodypart FROM part)
"""


def _bodyparts(spark, d):
    k = F.col("p_partkey")
    part = F.when((k % 40) % 3 == 0, F.concat(F.lit("joint"), F.char(97 + (k * 7) % 11))).otherwise(
        F.concat(F.lit("point"), (k % 11).cast("string"))
    )
    return table(spark, d, "part").select(
        F.concat(F.lit("f"), (k % 40).cast("string")).alias("file"), (k % 11).alias("pos"), part.alias("bodypart")
    ).distinct()


LABELS = """WITH {bp}, t AS (SELECT *, regexp_replace(bodypart, '^point', '') AS bare,
      dense_rank() OVER (PARTITION BY file ORDER BY {by}) - 1 AS r FROM bp),
    a AS (SELECT file, bool_and(regexp_full_match(bare, '[0-9]+')) AS digits FROM t GROUP BY file)
    SELECT t.file, t.bodypart, t.pos, CASE WHEN digits THEN bare ELSE CAST(r AS VARCHAR) END AS label FROM t JOIN a ON a.file = t.file"""


@query(LABELS.format(bp=PARTS, by="bodypart"))
def label_from_bodypart_trace(spark, d):
    return names.label_from_bodypart(_bodyparts(spark, d)).select("file", "bodypart", "pos", "label")


@query(LABELS.format(bp=PARTS, by="pos"))
def label_from_bodypart_config(spark, d):
    return names.label_from_bodypart(_bodyparts(spark, d), pos="pos", mode="config").select("file", "bodypart", "pos", "label")


@query(
    """WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'D:\\old\\proj\\videos\\v' || o_custkey || '.mp4'
      WHEN 1 THEN '/home/a/proj/b/proj/v' || o_custkey || '.mp4' WHEN 2 THEN '/x/PROJ/v' || o_custkey || '.mp4'
      ELSE '/elsewhere/v' || o_custkey || '.mp4' END AS old, o_custkey AS c FROM orders)
    SELECT k, CASE k % 4 WHEN 0 THEN '/new/proj/videos/v' || c || '.mp4' WHEN 1 THEN '/new/proj/v' || c || '.mp4'
      WHEN 2 THEN '/new/proj/v' || c || '.mp4' END AS path, CASE WHEN k % 4 = 3 THEN 'folder_not_found' ELSE 'ok' END AS status FROM o"""
)
def rebase_path(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    old = (
        F.when(k % 4 == 0, F.concat(F.lit("D:\\old\\proj\\videos\\v"), c, F.lit(".mp4")))
        .when(k % 4 == 1, F.concat(F.lit("/home/a/proj/b/proj/v"), c, F.lit(".mp4")))
        .when(k % 4 == 2, F.concat(F.lit("/x/PROJ/v"), c, F.lit(".mp4")))
        .otherwise(F.concat(F.lit("/elsewhere/v"), c, F.lit(".mp4")))
    )
    new = names.rebase_path(F.lit("/new/proj/config.yaml"), old)
    return table(spark, d, "orders").select(k.alias("k"), new.alias("_n")).select("k", "_n.path", "_n.status")


@query(
    """SELECT o_orderkey AS k, 'img' || CASE WHEN length(CAST(o_orderkey AS VARCHAR)) >= length(CAST(o_custkey AS VARCHAR)) THEN CAST(o_orderkey AS VARCHAR)
      ELSE lpad(CAST(o_orderkey AS VARCHAR), CAST(length(CAST(o_custkey AS VARCHAR)) AS INT), '0') END || '.png' AS image,
      'img' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.png' AS wide, o_orderkey AS frame FROM orders"""
)
def image_name(spark, d):
    rows = table(spark, d, "orders")
    wide = names.image_name("o_orderkey", width=9)
    return rows.select(
        F.col("o_orderkey").alias("k"), names.image_name("o_orderkey", "o_custkey").alias("image"),
        wide.alias("wide"), names.frame_of_image(wide).alias("frame"),
    )


@query(
    """WITH l AS (SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'buffer' WHEN 1 THEN 'labeled_data' WHEN 2 THEN 'dlccorr_lkmovavg_0.5'
      WHEN 3 THEN 'dlc_iteration-0_100' WHEN 4 THEN 'iteration-1_manual_corrections' WHEN 5 THEN 'iteration-' || o_custkey ELSE '' END AS layer FROM orders)
    SELECT k, layer, CAST(CASE k % 7 WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE 0 END AS BIGINT) AS grp FROM l"""
)
def layer_group(spark, d):
    k = F.col("o_orderkey")
    fixed = ["buffer", "labeled_data", "dlccorr_lkmovavg_0.5", "dlc_iteration-0_100", "iteration-1_manual_corrections"]
    layer = F.lit("")
    for i, name in enumerate(fixed):
        layer = F.when(k % 7 == i, name).otherwise(layer)
    layer = F.when(k % 7 == 5, F.concat(F.lit("iteration-"), F.col("o_custkey").cast("string"))).otherwise(layer)
    rows = table(spark, d, "orders").select(k.alias("k"), layer.alias("layer"))
    return rows.withColumn("grp", names.layer_group("layer"))


@query(
    """WITH p AS (SELECT c_custkey AS pos, '/proj/videos/v' || (c_custkey % 200) || '.avi' AS path FROM customer),
    f AS (SELECT 'v' || (pos % 200) AS stem, min(pos) AS pos FROM p GROUP BY 1),
    w AS (SELECT DISTINCT '/other/v' || (o_custkey % 300) || '.mp4' AS path, 'v' || (o_custkey % 300) AS stem FROM orders)
    SELECT w.path, f.pos FROM w LEFT JOIN f ON f.stem = w.stem"""
)
def video_index(spark, d):
    file = lambda root, key, n, ext: F.concat(F.lit(f"{root}/v"), (F.col(key) % n).cast("string"), F.lit(ext)).alias("path")
    known = table(spark, d, "customer").select(file("/proj/videos", "c_custkey", 200, ".avi"), F.col("c_custkey").alias("pos"))
    wanted = table(spark, d, "orders").select(file("/other", "o_custkey", 300, ".mp4")).distinct()
    return names.video_index(known, wanted)


# Trace files among all paths: those of models, and processed ones, which have no training number.
LATEST = PATHS + """,
t AS (SELECT 'v' || c AS video, path, k % 7 * 100 AS n FROM paths WHERE k % 6 = 2)
"""


def _traces(spark, d):
    return classify_files(paths(spark, d)).where("kind = 'trace'").select("video", "path")


@query(f"WITH {LATEST} SELECT video, max(n) AS n FROM t GROUP BY video")
def latest_trace(spark, d):
    return names.latest_trace(_traces(spark, d)).select("video", "n")


@query(f"WITH {LATEST} SELECT video, max(path) AS path, n FROM t WHERE n = 300 GROUP BY video, n")
def trace_of_iteration(spark, d):
    traces = _traces(spark, d)
    return names.latest_trace(traces, 300)
