"""Registration of queries together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles to six digits and widen integers, as the SQL side does."""
    out = []
    for f in df.schema:
        col = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = F.round(col.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            col = col.cast("long")
        out.append(col.alias(f.name))
    return df.select(*out)


# Track tables derived from the driver's tables, as SQL.
EVENTS = """
ev AS (
  SELECT event_id, 'u' || CAST(user_id AS VARCHAR) AS video, event_type, value AS v,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame
  FROM events),
pred AS (
  SELECT video, '0' AS label, frame, v AS x, CAST(k AS DOUBLE) AS y,
         CASE WHEN event_type = 'error' THEN 0.05 + k / 200.0
              WHEN event_type = 'signup' AND k < 30 THEN 0.6 + k / 100.0
              ELSE 0.95 + k / 2000.0 END AS likelihood, event_id, k
  FROM ev
  UNION ALL
  SELECT video, '1', frame, 500 - v, CAST(100 - k AS DOUBLE),
         CASE WHEN event_type = 'purchase' AND k < 50 THEN 0.05 + k / 100.0 ELSE 0.97 END, event_id, k
  FROM ev)
"""

FLOW = EVENTS + """,
flow AS (
  SELECT video, label, frame,
         x - lag(x) OVER w + nx + CASE WHEN event_id % 37 = 0 THEN 20.0 ELSE 0.0 END AS dx_fwd,
         y - lag(y) OVER w + ny AS dy_fwd,
         x - lead(x) OVER w - nx AS dx_rev,
         y - lead(y) OVER w - ny AS dy_rev
  FROM (SELECT *, ((event_id * 7 + CAST(label AS BIGINT)) % 11 - 5) / 16.0 AS nx,
               ((event_id * 3 + CAST(label AS BIGINT)) % 11 - 5) / 16.0 AS ny FROM pred)
  WINDOW w AS (PARTITION BY video, label ORDER BY frame)),
lk AS (
  SELECT f.video, f.label, f.frame, p.x + f.dx_fwd AS x, p.y + f.dy_fwd AS y
  FROM flow f JOIN pred p ON p.video = f.video AND p.label = f.label AND p.frame = f.frame - 1
  WHERE f.dx_fwd IS NOT NULL)
"""

MANUAL = EVENTS + """,
manual AS (
  SELECT video, 'iteration-0' AS layer, label, frame, x, y FROM pred
  WHERE frame % 5 = 0 AND (label = '0' OR k >= 20)
  UNION ALL
  SELECT video, 'iteration-0', '9', frame, x, y FROM pred WHERE frame % 20 = 0 AND label = '0'),
patch AS (SELECT video, 'patch' AS layer, label, frame, x + 1 AS x, y FROM pred WHERE frame % 7 = 0)
"""

PREVIOUS = EVENTS + """,
prev AS (SELECT video, label, frame, x + (event_id % 5) * 0.5 AS x, y, likelihood FROM pred)
"""

INTERVALS = """
spans AS (
  SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS video, '0' AS label,
         user_id % 7 + 5 AS "start", user_id % 7 + 17 + user_id % 5 AS "end"
  FROM events)
"""

BLIPS = FLOW + """,
dis AS (SELECT p.*, sqrt((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y)) AS d
        FROM pred p LEFT JOIN lk f ON p.video = f.video AND p.label = f.label AND p.frame = f.frame),
med AS (SELECT video, label, count(d) AS n, median(d) AS med, min(d) AS lo, max(d) AS hi
        FROM dis GROUP BY video, label),
mad AS (SELECT d.video, d.label, median(abs(d.d - m.med)) AS mad
        FROM dis d JOIN med m ON d.video = m.video AND d.label = m.label GROUP BY d.video, d.label),
thr AS (SELECT med.video, med.label, n, med, mad,
          CASE WHEN mad >= 1e-6 THEN med + 5.0 * 1.4826 * mad
               WHEN hi - lo < 1e-6 THEN CAST('inf' AS DOUBLE) ELSE 0.5 * (med + hi) END AS threshold
        FROM med JOIN mad ON med.video = mad.video AND med.label = mad.label),
hit AS (SELECT d.*, t.threshold, d.frame - lag(d.frame) OVER (PARTITION BY d.video, d.label ORDER BY d.frame) - 1 AS gap
        FROM dis d JOIN thr t ON d.video = t.video AND d.label = t.label WHERE d.d > t.threshold),
grp AS (SELECT *, sum(CASE WHEN gap <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY video, label ORDER BY frame) AS g FROM hit),
brun AS (SELECT video, label, min(frame) AS "start", max(frame) AS "end", max(frame) - min(frame) + 1 AS length,
           min(threshold) AS threshold FROM grp GROUP BY video, label, g),
judged_blips AS (SELECT r.*, b.x AS ax0, b.y AS ay0, a.x AS ax1, a.y AS ay1,
     CASE WHEN b.x IS NULL OR a.x IS NULL THEN 'edge' END AS reason
   FROM brun r
   LEFT JOIN pred b ON b.video = r.video AND b.label = r.label AND b.frame = r."start" - 1
   LEFT JOIN pred a ON a.video = r.video AND a.label = r.label AND a.frame = r."end" + 1),
blips AS (SELECT * FROM judged_blips WHERE reason IS NULL)
"""

LINES = """
lines AS (
  SELECT 's' || CAST(l_suppkey AS VARCHAR) AS video, '0' AS label,
         row_number() OVER (PARTITION BY l_suppkey
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS frame,
         l_quantity AS x, l_extendedprice / 1000 AS y, 1 - 5 * l_discount AS likelihood
  FROM lineitem)
"""
