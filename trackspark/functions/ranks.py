"""Exact order statistics of groups of any size, by sorting or by radix selection.

Rows of keys that few enough rows share are sorted by key and value, in one shuffle. Those of longer keys are narrowed down:
doubles become longs of the same order. Values are counted by key and leading bits; the running count says which bucket holds
a wanted rank, and only rows of that bucket go on to the next bits. Three rounds settle all 64 bits, but a bucket whose values
are equal, or that few enough rows share to be put in order, is settled at once. Counts are combined before the shuffle, rows
meet the buckets in an equi-join on key and bits, and no list of keys or values leaves the tables, so one long key among
millions of short ones needs no other plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.session import settle

#: Bits below the leading ones, by round.
SHIFTS = (44, 22, 0)
#: Rows of a key or a bucket that one task may put in order.
IN_ORDER = 1 << 16
_HALF = 1 << 52  # longs of one power of two


def sortable(value: Column) -> Column:
    """A double as a long that compares like it; both zeros are 0, NaN comes last."""
    size = F.abs(value)
    # The logarithm may be off by a rounding error next to a power of two.
    near = F.floor(F.log2(size)).cast("int")
    two = lambda e: F.pow(F.lit(2.0), e)
    exponent = near + F.when(size >= two(near + 1), 1).when(size < two(near), -1).otherwise(0)
    exponent = F.greatest(exponent, F.lit(-1022))
    bits = (exponent + 1022).cast("long") * _HALF + (size / two(exponent) * float(_HALF)).cast("long")
    bits = (
        F.when(size == 0, F.lit(0).cast("long"))
        .when(F.isnan(size), F.lit(2047 * _HALF + 1))
        .when(size == float("inf"), F.lit(2047 * _HALF))
        .otherwise(bits)
    )
    return F.when((value < 0) & ~F.isnan(value), -bits).otherwise(bits)


def _digits(shift: int) -> Column:
    return F.shiftright("_s", shift).alias("_d")


def _buckets(rows: DataFrame, keys: list[str], shift: int, more: Sequence[str] = ()) -> DataFrame:
    """How many values, and which smallest and largest, each bucket of a key holds."""
    return rows.groupBy(*keys, *more, _digits(shift)).agg(
        F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )


def _hit(upto: Column, wanted: Column) -> Column:
    """The wanted ranks in a bucket that ends at ``upto``, counted from its start."""
    start = upto - F.col("_c")
    inside = F.filter(wanted, lambda w: (w["rank"] >= start) & (w["rank"] < upto))
    return F.transform(inside, lambda w: F.struct(w["id"].alias("id"), (w["rank"] - start).alias("rank")))


def by_length(df: DataFrame, keys: Sequence[str], in_order: int = IN_ORDER) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of keys that at most ``in_order`` rows share, and the rows of longer ones; None where there are none."""
    if in_order <= 0:
        return None, df
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    shortest, longest = sizes.agg(F.min("_m"), F.max("_m")).first()
    if longest is None or longest <= in_order:
        return df, None
    if shortest > in_order:
        return None, df
    long_keys = settle(sizes.where(F.col("_m") > in_order).select(*keys))
    return df.join(long_keys, list(keys), "left_anti"), df.join(long_keys, list(keys), "left_semi")


def between(name: str, prob: float, n: Column) -> Column:
    """The percentile of ``n`` values from the two around it, ``_0_<name>`` and ``_1_<name>``."""
    lower, upper, at = F.col(f"_0_{name}"), F.col(f"_1_{name}"), (n - 1) * F.lit(float(prob))
    return lower + (upper - lower) * (at - F.floor(at))


def at_ranks(value: str, probs: dict[str, float], n: Column, upto: Column, count: Column) -> dict[str, Column]:
    """Values at the ranks around each percentile, as aggregates over the sorted rows of a short key.

    A row covers the ranks from ``upto - count`` to ``upto - 1`` of ``n``.
    """
    out = {}
    for name, p in probs.items():
        at = (n - 1) * F.lit(float(p))
        for side, f in enumerate((F.floor, F.ceil)):
            rank = f(at).cast("long")
            out[f"_{side}_{name}"] = F.max(F.when((rank >= upto - count) & (rank < upto), F.col(value)))
    return out


def _sorted_percentiles(base: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Percentiles of keys that are short enough to be sorted by one task, in one shuffle."""
    whole = Window.partitionBy(*keys)
    along = whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumn("_upto", F.sum("_c").over(along)).withColumn("n", F.sum("_c").over(whole))
    around = at_ranks("_v", probs, F.col("n"), F.col("_upto"), F.col("_c"))
    got = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), F.min("_v").alias("v_min"), F.max("_v").alias("v_max"), *[c.alias(name) for name, c in around.items()]
    )
    return got.select(*keys, "n", "v_min", "v_max", *[between(name, p, F.col("n")).alias(name) for name, p in probs.items()])


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    *,
    weight: str | None = None,
    in_order: int = IN_ORDER,
) -> DataFrame:
    """Exact linear-interpolated percentiles per key, plus ``n``, ``v_min`` and ``v_max``.

    NULL values are left out. ``weight`` is a column that says how often a row counts. ``df`` is read twice, to count the rows
    of the keys and to rank them, so a costly one should be settled before.
    """
    keys = list(keys)
    base = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_c")
    )
    short, long = by_length(base, keys, in_order)
    parts = [] if short is None else [_sorted_percentiles(short, keys, probs)]
    parts += [] if long is None else [_narrowed_percentiles(long, keys, probs, in_order)]
    return reduce(DataFrame.unionByName, parts)


def _narrowed_percentiles(base: DataFrame, keys: list[str], probs: dict[str, float], in_order: int) -> DataFrame:
    """Percentiles of keys of any length. Rows are settled with their bits; a round leaves only those of wanted buckets."""
    rows = settle(base.withColumn("_s", sortable(F.col("_v"))))
    whole = Window.partitionBy(*keys)
    along = whole.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    # A key has at most 2^20 leading bits, and in practice some hundreds.
    counts = _buckets(rows, keys, SHIFTS[0]).withColumns(
        {"n": F.sum("_c").over(whole), "v_min": F.min("_lo").over(whole), "v_max": F.max("_hi").over(whole), "_upto": F.sum("_c").over(along)}
    )
    at = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    ranks = [
        F.struct(F.lit(2 * i + side).alias("id"), f(at[name]).cast("long").alias("rank"))
        for i, name in enumerate(probs)
        for side, f in enumerate((F.floor, F.ceil))
    ]
    found = counts.withColumn("_t", _hit(F.col("_upto"), F.array(*ranks))).where(F.size("_t") > 0)
    open_ = settle(found.select(*keys, "n", "v_min", "v_max", "_d", "_c", "_lo", "_hi", "_t"))  # at most two rows per key and percentile
    done = []
    for shift, next_shift in zip(SHIFTS, SHIFTS[1:], strict=False):
        done.append(open_.where("_lo = _hi"))
        open_ = open_.where("_lo < _hi")
        largest = open_.agg(F.max("_c")).first()[0]
        if largest is None:
            break
        wanted = open_.select(*keys, "n", "v_min", "v_max", F.col("_d").alias("_p"), "_t")
        inside = rows.withColumn("_p", F.shiftright("_s", shift)).join(wanted, [*keys, "_p"])
        last = largest <= in_order
        if not last and next_shift:
            inside = settle(inside)
            rows = inside.select(*rows.columns)
        cut = 0 if last else next_shift
        step = inside.groupBy(*keys, "_p", _digits(cut)).agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            *[F.first(c).alias(c) for c in ("n", "v_min", "v_max", "_t")],
        )
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
        step = step.withColumn("_upto", upto).withColumn("_t", _hit(F.col("_upto"), F.col("_t"))).where(F.size("_t") > 0)
        step = step.select(*open_.columns)
        if cut == 0:
            done.append(step)
            break
        open_ = settle(step)
    picks = reduce(DataFrame.unionByName, done).select(*keys, "n", "v_min", "v_max", F.col("_lo").alias("_v"), F.explode("_t").alias("_t"))
    pick = lambda i: F.max(F.when(F.col("_t.id") == i, F.col("_v")))
    got = picks.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("n", "v_min", "v_max")],
        *[pick(2 * i + side).alias(f"_{side}_{name}") for i, name in enumerate(probs) for side in (0, 1)],
    )
    return got.select(*keys, "n", "v_min", "v_max", *[between(name, p, F.col("n")).alias(name) for name, p in probs.items()])


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, name: str = "pos", in_order: int = IN_ORDER
) -> DataFrame:
    """Zero-based rank by ``order`` inside each key, for keys of any size.

    Rows of keys that at most ``in_order`` rows share are ranked in one shuffle, those of longer ones as `_dealt_ranks` does.
    ``df`` is also read to count the rows of its keys, its other columns are not needed for that.
    """
    keys = list(keys)
    short, long = by_length(df, keys, in_order)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1
    parts = [] if short is None else [short.withColumn(name, rank)]
    parts += [] if long is None else [_dealt_ranks(long, keys, order, name)]
    return reduce(DataFrame.unionByName, parts)


def _dealt_ranks(df: DataFrame, keys: list[str], order: Sequence[str], name: str) -> DataFrame:
    """Ranks of keys of any length.

    Rows are dealt out by ranges of key and order, so a long key covers several partitions; a rank is the place inside the
    partition plus the key's rows in the partitions before. The dealt rows are settled, as a second sampling of the
    ranges could cut them elsewhere.
    """
    dealt = settle(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)).cast("long") - 1
    return dealt.withColumn("_place", place).join(offsets, [*keys, "_part"]).withColumn(name, F.col("_place") + F.col("_o")).drop(
        "_part", "_place", "_o"
    )
