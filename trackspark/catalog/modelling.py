"""Queries about models, axis limits and images."""

from pyspark.sql import functions as F

from trackspark.catalog.base import MANUAL, query
from trackspark.operators import models
from trackspark.sources import adapters as src

EVALUATION = """
ev AS (SELECT o_custkey % 7 AS iteration, o_orderkey AS row_no, o_custkey % 50 * 100 AS step, round(o_totalprice / 1000) AS test_error
       FROM orders WHERE o_custkey % 7 <> 3),
snap AS (SELECT DISTINCT o_custkey % 7 AS iteration, o_custkey % 50 * 100 AS step FROM orders WHERE o_custkey % 7 <> 6),
its AS (SELECT DISTINCT o_custkey % 7 AS iteration FROM orders),
best AS (SELECT iteration, min(test_error) AS err FROM ev GROUP BY iteration),
pick AS (SELECT i.iteration, coalesce(b.err, -1) AS test_error, coalesce(
    (SELECT step FROM ev WHERE ev.iteration = i.iteration ORDER BY test_error, row_no LIMIT 1),
    (SELECT max(step) FROM snap s WHERE s.iteration = i.iteration)) AS best_step FROM its i LEFT JOIN best b ON b.iteration = i.iteration)
"""


def _models(spark, d):
    orders = src.table(spark, d, "orders")
    it, step = F.col("o_custkey") % 7, F.col("o_custkey") % 50 * 100
    iterations = orders.select(it.alias("iteration")).distinct()
    evaluation = orders.where(it != 3).select(
        it.alias("iteration"), F.col("o_orderkey").alias("row_no"), step.alias("step"),
        F.round(F.col("o_totalprice") / 1000).alias("test_error"),
    )
    snapshots = orders.where(it != 6).select(it.alias("iteration"), step.alias("step")).distinct()
    return iterations, evaluation, snapshots.withColumn("snapshot", F.concat(F.lit("snapshot-"), F.col("step").cast("string")))


@query(
    f"""WITH {EVALUATION} SELECT p.iteration, p.best_step, CAST(p.test_error AS DOUBLE) AS test_error,
    CASE WHEN EXISTS (SELECT 1 FROM snap s WHERE s.iteration = p.iteration AND s.step = p.best_step)
      THEN (SELECT count(*) FROM snap s WHERE s.iteration = p.iteration AND s.step < p.best_step) END AS best_index FROM pick p"""
)
def best_snapshots(spark, d):
    return models.best_snapshots(*_models(spark, d))


@query(
    f"""WITH {EVALUATION}, named AS (SELECT iteration, max(step) AS step FROM snap WHERE iteration IN (1, 2, 3) GROUP BY iteration)
    SELECT p.iteration, coalesce(n.step, p.best_step) AS best_step, CAST(p.test_error AS DOUBLE) AS test_error,
    CASE WHEN n.step IS NOT NULL THEN (SELECT count(*) FROM snap s WHERE s.iteration = p.iteration)
      WHEN EXISTS (SELECT 1 FROM snap s WHERE s.iteration = p.iteration AND s.step = p.best_step)
      THEN (SELECT count(*) FROM snap s WHERE s.iteration = p.iteration AND s.step < p.best_step) END AS best_index
    FROM pick p LEFT JOIN named n ON n.iteration = p.iteration"""
)
def best_snapshots_named(spark, d):
    """A snapshot that is named best goes before the evaluation."""
    iterations, evaluation, snapshots = _models(spark, d)
    named = snapshots.where("iteration in (1, 2, 3)").groupBy("iteration").agg(F.max("step").alias("step"))
    named = named.withColumn("snapshot", F.concat(F.lit("snapshot-best-"), F.col("step").cast("string")))
    return models.best_snapshots(iterations, evaluation, snapshots.unionByName(named), prefer_best=True)


@query("SELECT max(o_custkey % 7) AS latest_trained FROM orders WHERE o_custkey % 7 <> 6")
def latest_trained_iteration(spark, d):
    iterations, _, snapshots = _models(spark, d)
    return models.latest_trained_iteration(iterations, snapshots)


@query("SELECT 'iteration-6' AS layer UNION ALL SELECT 'iteration-6'")
def next_layer_name(spark, d):
    """Iteration 5 is trained, iteration 6 is not: both lead to layer 6."""
    iterations, _, snapshots = _models(spark, d)
    return models.next_layer_name(iterations, snapshots, 5).unionByName(models.next_layer_name(iterations, snapshots, 6))


@query(
    f"""WITH {MANUAL}, s AS (SELECT video, label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1
      FROM (SELECT * FROM manual UNION ALL SELECT * FROM patch) GROUP BY video, label),
    p AS (SELECT *, CASE WHEN x0 = x1 THEN greatest(abs(x0) * 0.05, 0.5) ELSE (x1 - x0) * 0.05 END AS px,
      CASE WHEN y0 = y1 THEN greatest(abs(y0) * 0.05, 0.5) ELSE (y1 - y0) * 0.05 END AS py FROM s)
    SELECT video, label, round(x0 - px, 6) AS x_lo, round(x1 + px, 6) AS x_hi, round(y0 - py, 6) AS y_lo, round(y1 + py, 6) AS y_hi FROM p"""
)
def trace_extent(spark, d):
    return models.trace_extent(src.manual_layer(spark, d).unionByName(src.patch_layer_points(spark, d)))


@query(
    f"""WITH {MANUAL} SELECT video, round(min(x) * 0.9, 6) AS x_lo, round(min(y) * 0.9, 6) AS y_lo,
    round(max(x) * 1.1, 6) AS x_hi, round(max(y) * 1.1, 6) AS y_hi FROM manual GROUP BY video"""
)
def full_extent(spark, d):
    return models.full_extent(src.manual_layer(spark, d))


@query(
    """WITH p AS (SELECT 's' || (l_suppkey % 20) AS video, CAST(l_linenumber AS BIGINT) AS frame,
      CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 256 ELSE l_partkey % 50 END AS v FROM lineitem),
    q AS (SELECT video, frame, quantile_cont(v::DOUBLE, 0.05) AS p5, quantile_cont(v::DOUBLE, 0.5) AS p50, quantile_cont(v::DOUBLE, 0.95) AS p95
      FROM p GROUP BY video, frame)
    SELECT video, frame, round(p5, 6) AS p5, round(p50, 6) AS p50, round(p95, 6) AS p95,
      round(1 + 3 * least(greatest((75 - (p95 - p5)) / 75, 0), 1), 6) AS clip, round(1 + least(greatest((25 - p50) / 25, 0), 1), 6) AS gamma FROM q"""
)
def contrast_params(spark, d):
    s = F.col("l_suppkey")
    pixels = src.table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), (s % 20).cast("string")).alias("video"), F.col("l_linenumber").cast("long").alias("frame"),
        F.when(s % 3 == 0, F.col("l_partkey") % 256).otherwise(F.col("l_partkey") % 50).alias("intensity"),
    )
    return models.contrast_params(pixels)
