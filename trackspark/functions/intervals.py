"""Frames inside intervals, as equi-joins over a tree of frame ranges.

A node of level ``l`` stands for ``64 ** l`` frames that begin at a multiple of that number. An interval of any length is the
union of at most 126 nodes of each level it needs, so a run of a million frames becomes some hundred rows rather than a
million; a frame has one node of each level. Levels that no interval uses are left out, so frames of a table of short runs get
one or two keys. A node of a long trace is a join key of its own, which spreads the trace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.schema import TRACE
from trackspark.session import settle

BITS = 6
LEVELS = 11


def cover(start: Column, end: Column) -> Column:
    """The nodes of the inclusive interval, as an array of ``(level, node)``; none if it is empty."""
    def nodes(level: Column, low: Column, high: Column) -> Column:
        return F.when(low < high, F.transform(F.sequence(low, high - 1), lambda n: F.struct(level.alias("level"), n.alias("node")))).otherwise(
            F.array().cast("array<struct<level:int,node:bigint>>")
        )

    def step(state: Column, level: Column) -> Column:
        low, high = state["low"], state["high"]
        # whole nodes of the next level, if there are any
        up, down = F.shiftright(low + (1 << BITS) - 1, BITS), F.shiftright(high, BITS)
        above = up < down
        left = F.when(above, F.shiftleft(up, BITS)).otherwise(high)
        right = F.when(above, F.shiftleft(down, BITS)).otherwise(high)
        out = F.concat(state["out"], nodes(level, low, left), nodes(level, right, high))
        return F.struct(F.when(above, up).otherwise(0).alias("low"), F.when(above, down).otherwise(0).alias("high"), out.alias("out"))

    begin = F.struct(
        start.cast("long").alias("low"), (end.cast("long") + 1).alias("high"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out")
    )
    return F.aggregate(F.array(*[F.lit(i) for i in range(LEVELS)]), begin, step, lambda state: state["out"])


def with_nodes(runs: DataFrame, *, start: str = "start", end: str = "end") -> DataFrame:
    """One row per node of each run, in the columns ``_level`` and ``_node``."""
    rows = runs.withColumn("_n", F.explode(cover(F.col(start), F.col(end))))
    return rows.select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")


def frame_nodes(points: DataFrame, noded: DataFrame, frame: str = "frame") -> DataFrame:
    """One row per point and level that ``noded`` uses: at most ``LEVELS`` numbers are asked for."""
    used = sorted(r[0] for r in noded.select("_level").distinct().collect())
    keys = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(F.col(frame), BITS * n).alias("node")) for n in used])
    if not used:
        return points.where("false").withColumns({"_level": F.lit(0), "_node": F.lit(0).cast("long")})
    rows = points.withColumn("_n", F.explode(keys))
    return rows.select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")


def inside(points: DataFrame, runs: DataFrame, *, keys: Sequence[str] = TRACE) -> DataFrame:
    """The points at the frames of any run, each once, also where runs overlap."""
    nodes = settle(with_nodes(runs.select(*keys, "start", "end")).select(*keys, "_level", "_node").distinct())
    # A node below another one would find its points a second time.
    parents = F.transform(
        F.sequence(F.col("_level") + 1, F.lit(LEVELS)),
        lambda n: F.struct(n.alias("level"), F.expr("_node").alias("node")),
    )
    above = nodes.withColumn("_a", F.explode(parents)).select(
        *keys, F.col("_level").alias("_l"), F.col("_node").alias("_c"), F.col("_a.level").alias("_level"),
        F.expr(f"shiftright(_node, CAST({BITS} * (_a.level - _level) AS INT))").alias("_node"),
    )
    covered = above.join(nodes, [*keys, "_level", "_node"], "left_semi").select(*keys, F.col("_l").alias("_level"), F.col("_c").alias("_node")).distinct()
    nodes = settle(nodes.join(covered, [*keys, "_level", "_node"], "left_anti"))
    return frame_nodes(points, nodes).join(nodes, [*keys, "_level", "_node"], "left_semi").drop("_level", "_node")


def meet(points: DataFrame, runs: DataFrame, *, keys: Sequence[str] = TRACE) -> DataFrame:
    """Every point with every run that holds its frame; ``runs`` keeps its columns, ``points`` its others."""
    noded = settle(with_nodes(runs))
    return frame_nodes(points, noded).join(noded, [*keys, "_level", "_node"]).drop("_level", "_node")
