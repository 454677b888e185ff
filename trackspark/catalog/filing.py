"""Queries that write files into the shared folder and read them back."""

from pyspark.sql import functions as F

from trackspark.catalog.base import EVENTS, MANUAL, query
from trackspark.catalog.detection import GAP_COLUMNS, GAPS
from trackspark.catalog.naming import PATHS, paths
from trackspark.operators import detect
from trackspark.schema import PRED
from trackspark.session import scratch_dir, settle
from trackspark.sources import adapters as src
from trackspark.sources import files
from trackspark.sources.layer_files import read_layer_files, write_layer_files
from trackspark.streaming.arrivals import read_results, stream_predictions
from trackspark.streaming.parts import GAP, gaps_in_parts

XY = "round(x, 6) AS x, round(y, 6) AS y"


def _written_layers(spark, d):
    manual = src.manual_layer(spark, d)
    target = scratch_dir(spark, "layers")
    files.write_layers(manual, src.declared(manual, extra=("4",)), target)
    return files.read_written_layers(spark, target)


@query(f"WITH {MANUAL} SELECT video, layer, label, frame, {XY} FROM manual")
def layer_files(spark, d):
    return _written_layers(spark, d)[0]


@query(
    f"""WITH {MANUAL} SELECT video, layer, label, row_number() OVER (PARTITION BY video, layer ORDER BY CAST(label AS INT)) - 1 AS pos
    FROM (SELECT DISTINCT video, layer, label FROM manual UNION SELECT DISTINCT video, layer, '4' FROM manual)"""
)
def layer_file_labels(spark, d):
    """Labels survive the file, also the one without any point."""
    return _written_layers(spark, d)[1]


@query(
    f"""WITH {MANUAL}, r AS (SELECT DISTINCT video, l.layer FROM manual CROSS JOIN (VALUES ('iteration-0'), ('iteration-1')) l(layer))
    SELECT r.video, r.layer, n.label, CAST(n.pos AS BIGINT) AS pos FROM r CROSS JOIN (VALUES ('0', 0), ('1', 1), ('2', 2)) n(label, pos)
    WHERE NOT EXISTS (SELECT 1 FROM manual m WHERE m.video = r.video AND m.layer = r.layer)"""
)
def default_labels(spark, d):
    manual = src.manual_layer(spark, d)
    wanted = manual.select("video").distinct().withColumn(
        "layer", F.explode(F.array(F.lit("iteration-0"), F.lit("iteration-1")))
    )
    return files.default_labels(wanted, manual, 3)


@query(
    f"""WITH {EVENTS} SELECT video, label, frame, round(x, 6) AS x, round(y, 6) AS y, round(likelihood, 6) AS likelihood
    FROM pred WHERE NOT (label = '1' AND k % 11 = 3)"""
)
def prediction_files(spark, d):
    """Wide traces with holes, written as CSV and read back as rows."""
    pred = src.predictions(spark, d, with_event=True)
    hole = (F.col("label") == "1") & (F.col("k") % 11 == 3)
    pred = pred.withColumns({c: F.when(~hole, F.col(c)) for c in ("x", "y", "likelihood")})
    target = scratch_dir(spark, "traces")
    files.write_predictions_csv(pred, ["0", "1"], target)
    back = files.read_predictions_csv(spark, target, file_glob="*.txt", with_video=True)
    return back.select("video", "label", "frame", "x", "y", "likelihood")


@query(
    f"""WITH {MANUAL} SELECT video, 'img' || lpad(CAST(frame AS VARCHAR), 6, '0') || '.png' AS image, label, frame, {XY}
    FROM manual WHERE label IN ('0', '1')"""
)
def training_files(spark, d):
    manual = src.manual_layer(spark, d)
    target = scratch_dir(spark, "training")
    files.write_training_feed(manual, ["0", "1"], target)
    return files.read_training_csv(spark, target, file_glob="*.txt").select("video", "image", "label", "frame", "x", "y")


@query(
    f"""WITH {MANUAL} SELECT video, 'img' || lpad(CAST(frame AS VARCHAR), 6, '0') || '.png' AS image,
    round(max(x) FILTER (label = '0'), 6) AS x0, round(max(y) FILTER (label = '0'), 6) AS y0,
    round(max(x) FILTER (label = '1'), 6) AS x1, round(max(y) FILTER (label = '1'), 6) AS y1 FROM manual GROUP BY video, frame"""
)
def training_feed(spark, d):
    feed = files.training_feed(src.manual_layer(spark, d), ["0", "1"])
    return feed.select(
        "video", "image", *[F.col(f"{l}_{c}").alias(f"{c}{l}") for l in ("0", "1") for c in ("x", "y")]
    )


@query(
    f"""WITH {PATHS}, n AS (SELECT k, path, regexp_extract(path, '([^/]*)$', 1) AS file FROM paths)
    SELECT path, CASE WHEN k % 6 IN (0, 1, 5) THEN 'annotation' ELSE 'trace' END AS kind,
      regexp_extract(file, '^(v[0-9]+)', 1) AS video FROM n WHERE k % 6 <> 4"""
)
def classify_files(spark, d):
    return files.classify_files(paths(spark, d)).select("path", "kind", "video")


@query(f"WITH {PATHS} SELECT path FROM paths WHERE k % 6 IN (0, 1)")
def training_layer_files(spark, d):
    return files.classify_files(paths(spark, d), training_only=True).select("path")


@query(
    """SELECT DISTINCT 'point' || (p_partkey % 50) AS bodypart,
    CASE WHEN p_partkey % 50 < 30 THEN 'site ' || (p_partkey % 50) ELSE 'point' || (p_partkey % 50) END AS display FROM part"""
)
def display_names(spark, d):
    number = (F.col("p_partkey") % 50).cast("string")
    parts = src.table(spark, d, "part").select(F.concat(F.lit("point"), number).alias("bodypart"), number.alias("n")).distinct()
    target = scratch_dir(spark, "names")
    lines = parts.where(F.col("n").cast("int") < 30).select(F.concat(F.col("bodypart"), F.lit(" - site "), F.col("n")).alias("value"))
    lines.write.text(target)
    return files.display_names(parts.select("bodypart"), files.read_label_names(spark, target))


@query(
    """SELECT CAST(o_custkey % 7 AS BIGINT) AS iteration, o_orderkey % 1000 * 100 AS step, round(max(o_totalprice), 6) AS test_error
    FROM orders GROUP BY 1, 2"""
)
def evaluation_files(spark, d):
    """Evaluation tables with padded header names, one folder per iteration."""
    rows = src.table(spark, d, "orders").groupBy(
        (F.col("o_custkey") % 7).alias("it"), (F.col("o_orderkey") % 1000 * 100).alias("step")
    ).agg(F.max("o_totalprice").alias("err"))
    target = scratch_dir(spark, "evaluation")
    rows.select(
        F.concat(F.lit("iteration-"), F.col("it").cast("string")).alias("folder"),
        F.col("step").alias(" Training iterations: "), F.col("err").alias(" Test error(px) "),
    ).write.partitionBy("folder").option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(target)
    return files.read_evaluation(spark, target).select("iteration", "step", "test_error")


def _layer_files(spark, d):
    # Documents and declared labels read the points several times.
    manual = settle(src.manual_layer(spark, d))
    target = scratch_dir(spark, "layer-files")
    write_layer_files(manual, src.declared(manual, extra=("4",)), target)
    return target, manual


@query(f"WITH {MANUAL} SELECT video, layer, label, frame, {XY} FROM manual")
def layer_files_each(spark, d):
    """One file per video and layer, written by the data source and read back."""
    return read_layer_files(spark, _layer_files(spark, d)[0])[0]


@query(
    f"""WITH {MANUAL} SELECT DISTINCT video || '_annotations_' || layer || '.json' AS file, 'annotation' AS kind, video, layer,
    false AS dense, true AS manual FROM manual"""
)
def layer_file_listing(spark, d):
    """All columns of a listing of the written files; a sidecar among them is no layer."""
    target, manual = _layer_files(spark, d)
    files.write_dropped_sidecar(manual, f"{target}/dropped", ["0", "1"])
    listed = files.discover_layers(spark, target)
    return listed.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "kind", "video", "layer", "dense", "manual")


GAP_ROWS = f"WITH {GAPS} SELECT {GAP_COLUMNS}, round(min_likelihood, 6) AS min_likelihood FROM judged WHERE reason IS NULL"
# Videos of even users are delivered again without label 1.
REDELIVERED = "label = '0' OR CAST(substr(video, 2) AS BIGINT) % 2 = 1"


@query(f"{GAP_ROWS} AND ({REDELIVERED})")
def stream_gaps(spark, d):
    """Gap finding over predictions as they arrive; a second delivery of half the videos lacks a label, and its gaps go."""
    source, target = scratch_dir(spark, "arrivals"), scratch_dir(spark, "results")
    checkpoint, block = scratch_dir(spark, "stream"), src.event_block(spark, d)
    pred = src.predictions(spark, d)
    gaps = lambda df: detect.find_gaps(df, max_gap=2, dense=True, block=block)
    again = pred.where("CAST(substr(video, 2) AS BIGINT) % 2 = 0 AND label = '0'")
    for number, rows in enumerate((pred, again)):
        rows.repartition("video").write.parquet(f"{source}/delivery-{number}")
        stream_predictions(spark, source, target, {"gaps": gaps}, checkpoint=checkpoint).awaitTermination()
    return read_results(spark, target, "gaps")


@query(GAP_ROWS)
def stream_gaps_in_parts(spark, d):
    """Every trace arrives in three deliveries; gaps across their borders are found once all their rows are there."""
    source, target, checkpoint = (scratch_dir(spark, n) for n in ("parts", "part-results", "part-stream"))
    pred = settle(src.predictions(spark, d))
    part = F.least(F.floor((F.col("frame") + F.length("video")) / 23), F.lit(2))
    for number in range(3):
        pred.where(part == number).write.parquet(f"{source}/delivery-{number}")
        arrivals = spark.readStream.schema(PRED).option("recursiveFileLookup", "true").parquet(source)
        out = gaps_in_parts(arrivals, max_gap=2).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        out.outputMode("append").trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.schema(GAP).parquet(target)
