"""Ordered computations over one trace, split into frame blocks.

A trace is all rows of one key (a label of a video) in frame order. A plain
window over a trace puts the whole trace into one task, which fails when one
trace holds a large share of the table. The helpers here cut a trace into
blocks of a fixed number of frames, so a task never holds more than one block
of one trace:

* context of a bounded width travels as a halo: rows near a block border are
  also sent to the neighbouring block (`with_halo`);
* context of unbounded width (running sums, last value seen) is computed inside
  blocks and completed by one small summary row per block (`scan`).

Frames are unique per key, so a block holds at most ``block`` rows per key.

A caller who has checked that every trace fits one block (`one_block`) passes
``block=None``: the same results then come from one plain window per trace,
without summary rows and without joining them back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 16
BLK = "_blk"
OWN = "_own"


def block_of(order: str | Column, block: int | None = BLOCK) -> Column:
    if block is None:
        return F.lit(0).cast("long")
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(block)).cast("long")


def layout_of(df: DataFrame) -> tuple[int, int] | None:
    """Frames per block and frames of context of a table that is stored in blocks (`sources.layout`), else None."""
    if BLK not in df.columns or OWN not in df.columns:
        return None
    kept = df.schema[BLK].metadata
    return (kept["block"], kept["context"]) if "context" in kept else None


def layout_columns(df: DataFrame) -> list[str]:
    """The columns that a projection has to keep for a stored layout to be used further on."""
    return [] if layout_of(df) is None else [BLK, OWN]


def plain_rows(df: DataFrame) -> DataFrame:
    """The table's own rows, without the context that a stored layout adds."""
    return df if layout_of(df) is None else df.where(F.col(OWN)).drop(BLK, OWN)


def with_halo(
    df: DataFrame, *, before: int, after: int, order: str = "frame", block: int | None = BLOCK
) -> DataFrame:
    """Send each row to every block that may look at it.

    A row of frame f is context for frames f-after .. f+before. Adds the block
    number and whether the row belongs to that block or is only context. A
    table stored with enough context comes back as it is.
    """
    stored = layout_of(df)
    if stored is not None:
        if stored[0] == block and stored[1] >= max(before, after):
            return df
        df = plain_rows(df)
    if block is None:
        return df.withColumns({BLK: F.lit(0).cast("long"), OWN: F.lit(True)})
    f = F.col(order)
    low = block_of(f - F.lit(after), block)
    high = block_of(f + F.lit(before), block)
    return df.withColumn(BLK, F.explode(F.sequence(low, high))).withColumn(
        OWN, F.col(BLK) == block_of(f, block)
    )


def own_rows(df: DataFrame, *, keep_block: bool = False) -> DataFrame:
    """Drop the context rows and helper columns added by `with_halo`.

    With ``keep_block`` the block number stays, for a next step on the same blocks.
    """
    return df.where(F.col(OWN)).drop(OWN, *([] if keep_block else [BLK]))


def halo_window(keys: Sequence[str], order: str = "frame", block: int | None = BLOCK):
    return Window.partitionBy(*keys, *([] if block is None else [BLK])).orderBy(order)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Spread a small table before its rows grow.

    The number of partitions is given, so the adaptive planner does not merge
    them for being small.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)


def meet_blocks(
    left: DataFrame, right: DataFrame, fn: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: T.StructType | str, *, keys: Sequence[str]
) -> DataFrame:
    """Run a function over each block of a trace in two tables at once, in Arrow.

    Both tables carry block numbers. Tables stored in blocks meet where they lie; others are spread first.
    """
    keys = [*keys, BLK]
    # Both may come from one table, so the columns of one get names of their own.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    sides = [df if layout_of(df) else spread(df, *keys) for df in (left, right)]
    return sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(fn, schema)


def apply_groups(
    df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], pa.Table], schema: T.StructType | str
) -> DataFrame:
    """Run a small function over each group, in Arrow and on all partitions.

    Only for groups of a bounded size: blocks of a trace, or a bounded number
    of candidates. Cheap rows with costly functions must not be merged into few
    tasks, hence the explicit spread.
    """
    return spread(df, *keys).groupBy(*keys).applyInArrow(fn, schema)


FORWARD = {"sum", "last", "prev"}
BACKWARD = {"rsum", "first", "next"}


def scan(
    df: DataFrame,
    keys: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    *,
    order: str = "frame",
    block: int | None = BLOCK,
) -> DataFrame:
    """Add running values along each trace.

    ``specs`` maps a new column to ``(kind, value)``:

    ``sum`` / ``rsum``   sum of the values up to / from this row, itself included
    ``last`` / ``first`` nearest non-NULL value at or before / at or after this row
    ``prev`` / ``next``  the same, strictly before / strictly after this row
    """
    keys = list(keys)
    values = {f"_v{i}": (name, kind, value) for i, (name, (kind, value)) in enumerate(specs.items())}
    base = df.withColumns({v: value for v, (_, _, value) in values.items()}).withColumn(
        BLK, block_of(order, block)
    )

    up = Window.partitionBy(*keys, *([] if block is None else [BLK])).orderBy(order)
    down = Window.partitionBy(*keys, *([] if block is None else [BLK])).orderBy(F.desc(order))
    start = Window.unboundedPreceding
    local = {}
    for v, (_, kind, _) in values.items():
        w = up if kind in FORWARD else down
        if kind in ("sum", "rsum"):
            local[f"{v}l"] = F.sum(v).over(w.rowsBetween(start, 0))
        else:
            stop = 0 if kind in ("last", "first") else -1
            local[f"{v}l"] = F.last(v, ignorenulls=True).over(w.rowsBetween(start, stop))
    if block is None:
        names = {name: F.col(f"{v}l") for v, (name, _, _) in values.items()}
        return base.withColumns(local).withColumns(names).drop(BLK, *values, *local)

    totals = []
    for v, (_, kind, _) in values.items():
        if kind in ("sum", "rsum"):
            totals.append(F.sum(v).alias(f"{v}t"))
        else:
            at = F.when(F.col(v).isNotNull(), F.col(order))
            pick = F.max_by if kind in FORWARD else F.min_by
            totals.append(pick(F.col(v), at).alias(f"{v}t"))
    summary = base.groupBy(*keys, BLK).agg(*totals)

    fwd = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    bwd = Window.partitionBy(*keys).orderBy(F.desc(BLK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for v, (_, kind, _) in values.items():
        w = fwd if kind in FORWARD else bwd
        fold = F.sum(f"{v}t") if kind in ("sum", "rsum") else F.last(f"{v}t", ignorenulls=True)
        carried.append(fold.over(w).alias(f"{v}c"))
    carry = summary.select(*keys, BLK, *carried)

    joined = base.withColumns(local).join(_null_safe(carry, keys), [*keys, BLK], "left")

    done = {}
    for v, (name, kind, _) in values.items():
        if kind in ("sum", "rsum"):
            inside, outside = F.col(f"{v}l"), F.col(f"{v}c")
            both = F.coalesce(inside, F.lit(0)) + F.coalesce(outside, F.lit(0))
            done[name] = F.when(inside.isNull() & outside.isNull(), None).otherwise(both)
        else:
            done[name] = F.coalesce(f"{v}l", f"{v}c")
    helpers = [BLK, *[f"{v}{s}" for v in values for s in ("", "l", "c")]]
    return joined.withColumns(done).drop(*helpers)


def _null_safe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    # Key columns are never NULL in the track tables; the filter lets the
    # optimizer know and keeps the join an equi-join.
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def position(
    df: DataFrame,
    keys: Sequence[str],
    *,
    order: str = "frame",
    name: str = "pos",
    block: int | None = BLOCK,
) -> DataFrame:
    """Zero-based row position inside each trace."""
    return scan(df, keys, {name: ("sum", F.lit(1).cast("long"))}, order=order, block=block).withColumn(
        name, F.col(name) - 1
    )


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    *,
    salt_on: Sequence[str],
    salts: int = 64,
    name: str = "rank",
) -> DataFrame:
    """The first ``k`` rows of each group, exact for groups of any size.

    Rows are first cut to ``k`` inside ``salts`` hashed parts of a group, so
    the final ranking of a group sees at most ``salts * k`` rows.
    """
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
        .withColumn("_r", F.row_number().over(w1))
        .where(F.col("_r") <= k)
        .withColumn(name, F.row_number().over(w2))
        .where(F.col(name) <= k)
        .drop("_salt", "_r")
    )
