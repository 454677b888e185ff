"""Runs (gaps and islands), robust thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.blocks import BLK, BLOCK, block_of
from trackspark.functions.ranks import IN_ORDER, at_ranks, between, by_length, percentiles
from trackspark.schema import TRACE
from trackspark.session import settle

# The flat-signal limit and the factor from MAD to sigma.
MAD_ZERO = 1e-6
MAD_TO_SIGMA = 1.4826


def runs(
    hits: DataFrame,
    *,
    keys: Sequence[str] = TRACE,
    order: str = "frame",
    max_gap: int = 0,
    mins: dict[str, str] | None = None,
    first: dict[str, Column | str] | None = None,
    last: dict[str, Column | str] | None = None,
    sums: dict[str, Column | str] | None = None,
    block: int | None = BLOCK,
) -> DataFrame:
    """Merge rows into inclusive runs ``start .. end``.

    ``hits`` holds only the rows that count. Neighbouring hits belong to one
    run when at most ``max_gap`` frames lie between them. ``mins`` and ``sums``
    aggregate columns over the hits of a run; ``first`` and ``last`` take a
    column at its first and last hit.

    Runs are built inside blocks; only the first and last run of a block can
    continue in a neighbour, so just those are stitched along the whole trace.
    """
    keys = list(keys)
    mins, first, last, sums = mins or {}, first or {}, last or {}, sums or {}
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    source = {f"_m_{n}": as_col(c) for n, c in mins.items()}
    source |= {f"_f_{n}": as_col(c) for n, c in first.items()}
    source |= {f"_l_{n}": as_col(c) for n, c in last.items()}
    source |= {f"_s_{n}": as_col(c) for n, c in sums.items()}

    # Rows that carry their block already are partitioned by it, too.
    blk = F.col(BLK) if BLK in hits.columns else block_of(order, block)
    rows = hits.select(*keys, blk.alias(BLK), F.col(order).alias("_o"), *[c.alias(n) for n, c in source.items()])
    w = Window.partitionBy(*keys, *([] if block is None else [BLK])).orderBy("_o")
    gap = F.col("_o") - F.lag("_o").over(w) - 1
    rows = rows.withColumn("_new", F.when(gap <= max_gap, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = rows.groupBy(*keys, BLK, "_run").agg(
        F.min("_o").alias("start"),
        F.max("_o").alias("end"),
        F.count(F.lit(1)).alias("n_hits"),
        *[F.min(f"_m_{n}").alias(n) for n in mins],
        *[F.min_by(f"_f_{n}", "_o").alias(n) for n in first],
        *[F.max_by(f"_l_{n}", "_o").alias(n) for n in last],
        *[F.sum(f"_s_{n}").alias(n) for n in sums],
    )

    outputs = ["n_hits", *mins, *first, *last, *sums]
    length = (F.col("end") - F.col("start") + 1).alias("length")
    if block is None:
        return local.select(*keys, "start", "end", length, *outputs)

    in_block = Window.partitionBy(*keys, BLK)
    edge = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(in_block))
    # Inner runs keep their block as group, edge runs of a trace share group -1.
    local = local.withColumn("_grp", F.when(edge, F.lit(-1)).otherwise(F.col(BLK)))
    chain = Window.partitionBy(*keys, "_grp").orderBy("start")
    gap = F.col("start") - F.lag("end").over(chain) - 1
    local = local.withColumn("_new", F.when(gap <= max_gap, 0).otherwise(1)).withColumn(
        "_id", F.sum("_new").over(chain.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = local.groupBy(*keys, "_grp", "_id").agg(
        F.min("start").alias("_start"),
        F.max("end").alias("end"),
        F.sum("n_hits").alias("n_hits"),
        *[F.min(n).alias(n) for n in mins],
        *[F.min_by(n, "start").alias(n) for n in first],
        *[F.max_by(n, "start").alias(n) for n in last],
        *[F.sum(n).alias(n) for n in sums],
    )
    merged = merged.withColumnRenamed("_start", "start")
    return merged.select(*keys, "start", "end", length, *outputs)


def by_block(figures: DataFrame, rows: DataFrame, *, keys: Sequence[str] = TRACE, block: int = BLOCK) -> DataFrame:
    """One row of ``figures`` (one per key) for each block that the key has in ``rows``, to be joined with the rows of a block.

    So a long trace meets its figures in as many tasks as it has blocks.
    """
    own = F.col(BLK) if BLK in rows.columns else block_of("frame", block)
    return rows.select(*keys, own.alias(BLK)).distinct().join(figures, list(keys))


def robust_threshold(
    values: DataFrame,
    value: str,
    *,
    keys: Sequence[str] = TRACE,
    factor: float = 5.0,
    in_order: int = IN_ORDER,
    block: int = BLOCK,
) -> DataFrame:
    """Median, MAD and outlier threshold of a value per trace.

    Normal signals get ``median + factor * 1.4826 * MAD``. A flat signal with
    spikes gets the midpoint of median and maximum, a constant one infinity.
    ``values`` is read several times. Traces of at most ``in_order`` rows are
    sorted, once by value and once by deviation, in one shuffle. Longer ones
    are narrowed down; with a ``frame`` column their medians meet the rows
    block by block.
    """
    keys = list(keys)
    framed = "frame" in values.columns
    at = [c for c in ("frame", BLK) if c in values.columns] if framed else []
    rows = values.where(F.col(value).isNotNull()).select(*keys, value, *at)
    short, long = by_length(rows, keys, in_order)
    parts = [] if short is None else [_short_figures(short, value, keys)]
    parts += [] if long is None else [_long_figures(long, value, keys, framed, in_order, block)]
    return reduce(DataFrame.unionByName, parts).select(*keys, "n", "med", "mad", _threshold(factor).alias("threshold"))


def _short_figures(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Median, MAD and range of traces that one task may sort."""
    whole = Window.partitionBy(*keys)
    one, n, upto = F.lit(1), F.col("n"), F.col("_upto")
    place = lambda by: F.row_number().over(whole.orderBy(by))
    ranked = rows.select(*keys, F.col(value).cast("double").alias("_v"))
    ranked = ranked.withColumn("_upto", place("_v")).withColumn("n", F.count(one).over(whole))
    around = at_ranks("_v", {"med": 0.5}, n, upto, one)
    ranked = ranked.withColumns({name: c.over(whole) for name, c in around.items()}).withColumn("med", between("med", 0.5, n))
    ranked = ranked.withColumn("_dev", F.abs(F.col("_v") - F.col("med"))).withColumn("_upto", place("_dev"))
    got = ranked.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("n", "med")], F.min("_v").alias("v_min"), F.max("_v").alias("v_max"),
        *[c.alias(name) for name, c in at_ranks("_dev", {"mad": 0.5}, n, upto, one).items()],
    )
    return got.select(*keys, "n", "v_min", "v_max", "med", between("mad", 0.5, n).alias("mad"))


def _long_figures(rows: DataFrame, value: str, keys: list[str], framed: bool, in_order: int, block: int) -> DataFrame:
    """Median, MAD and range of traces of any length."""
    shape = settle(percentiles(rows, keys, value, {"med": 0.5}, in_order=in_order))
    if framed:
        rows = rows if BLK in rows.columns else rows.withColumn(BLK, block_of("frame", block))
        rows = rows.join(
            by_block(shape.select(*keys, "med"), rows, keys=keys, block=block), [*keys, BLK]
        )
    else:
        rows = rows.join(shape.select(*keys, "med"), keys)
    far = rows.withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    mad = percentiles(far, keys, "_dev", {"mad": 0.5}, in_order=in_order).select(*keys, "mad")
    return shape.join(mad, keys)


def _threshold(factor: float) -> Column:
    return (
        F.when(F.col("mad") >= MAD_ZERO, F.col("med") + factor * MAD_TO_SIGMA * F.col("mad"))
        .when(F.col("v_max") - F.col("v_min") < MAD_ZERO, F.lit(float("inf")))
        .otherwise(0.5 * (F.col("med") + F.col("v_max")))
    )
