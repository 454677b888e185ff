"""Sharding by a k-d tree over metadata, with shards of near-equal bytes.

A node that must become k shards is cut at the weighted quantile k // 2 / k of its bytes (the median for even k) along
the dimension in which it is widest, measured against the whole table's width. Every level of the tree sorts the rows
of all its nodes once by range and sums bytes in two steps (per range, then over ranges), so no node is ever in one task
and equal values, equal texts and equal rows are no obstacle: ties go by text, id and row. At each cut one row may change
sides, the one whose size best makes up for the document that the cut would have had to divide.

Defined cases: a null text has size ``OVERHEAD``; null metadata counts as below all values; equal rows are placed one by
one; an empty table gives no rows; with more shards than rows some shards stay empty. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.session import settle

OVERHEAD = 8
#: Rows that are numbered in one sorted group.
NUMBERED = 1 << 18


def sizes(text: Column) -> Column:
    """Bytes of the text as UTF-8 (none for null) plus what a record costs."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def text_dimension(value: Column) -> Column:
    """A text as a number: equal texts are equal, their order means nothing."""
    return F.crc32(F.encode(value.cast("string"), "UTF-8"))


def document_dimensions() -> dict[str, Column]:
    """What :func:`shard` cuts documents along, if nothing else is named."""
    return {
        "n_chars": F.col("n_chars").cast("long"),
        "source": text_dimension(F.col("source")),
        "lang": text_dimension(F.col("lang")),
    }


def _cut(rows: DataFrame, dims: list[str], whole: dict[str, Column]) -> DataFrame:
    """One level: every node of ``k`` > 1 shards becomes two."""
    node = ["lo", "k"]
    stats = rows.groupBy(*node).agg(
        F.sum("size").alias("node_bytes"), *((F.max(d) - F.min(d)).alias(f"w_{d}") for d in dims)
    )
    shares = [F.coalesce(F.col(f"w_{d}") / whole[d], F.lit(0.0)) for d in dims]
    widest = F.greatest(*shares) if len(shares) > 1 else shares[0]
    axis = F.coalesce(*(F.when(s == widest, i) for i, s in enumerate(shares)))
    stats = stats.select(*node, "node_bytes", axis.alias("axis"))
    value = F.element_at(F.array(*dims), F.col("axis") + 1)
    keyed = rows.join(stats, node).withColumn("value", value).drop("axis")
    order = ["value", "text_crc32", "doc_id", "row"]
    ranged = settle(keyed.repartitionByRange(*node, *order).withColumn("part", F.spark_partition_id()))
    before = (
        ranged.groupBy(*node, "part").agg(F.sum("size").alias("own"))
        .withColumn("before", F.sum("own").over(Window.partitionBy(*node).orderBy("part")) - F.col("own"))
        .drop("own")
    )
    within = Window.partitionBy(*node, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    left = F.floor(F.col("k") / 2).cast("int")
    middle = F.col("before") + F.sum("size").over(within) - F.col("size") / 2
    goes_left = middle <= F.col("node_bytes") * left / F.col("k")
    split = settle(
        ranged.join(before, [*node, "part"])
        .withColumn("left", goes_left)
        .select(*node, "doc_id", "size", "text_crc32", "row", "node_bytes", *dims, "left")
    )
    return _even_out(split, node).select(
        "doc_id", "size", "text_crc32", "row", *dims,
        F.when(F.col("left"), F.col("lo")).otherwise(F.col("lo") + left).alias("lo"),
        F.when(F.col("left"), left).otherwise(F.col("k") - left).alias("k"),
    )


def _even_out(split: DataFrame, node: list[str]) -> DataFrame:
    """Move one row per node over its cut: the one whose size comes nearest to what the lighter side lacks."""
    lacks = split.groupBy(*node).agg(
        (F.max("node_bytes") * F.floor(F.col("k") / 2) / F.col("k") - F.sum(F.when(F.col("left"), F.col("size")).otherwise(0)))
        .alias("lacks")
    )
    size, need = F.col("size"), F.abs("lacks")
    heavier = split.join(lacks, node).where((F.col("left") == (F.col("lacks") < 0)) & (size < 2 * need))
    moved = heavier.groupBy(*node).agg(
        F.min(F.struct(F.abs(size - need).alias("off"), "doc_id", "text_crc32", "row")).getField("row").alias("moved")
    )
    return split.join(moved, node, "left").withColumn(
        "left", F.col("left") != F.coalesce(F.col("row") == F.col("moved"), F.lit(False))
    )


def shard(docs: DataFrame, shards: int, dimensions: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; slots count from 0 in each shard.

    ``dimensions`` maps names to numeric columns of ``docs``.
    """
    dimensions = dimensions or document_dimensions()
    dims = [f"d{i}" for i in range(len(dimensions))]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        sizes(F.col("text")).alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")).alias("text_crc32"),
        *(F.coalesce(c.cast("double"), F.lit(-1.0)).alias(d) for d, c in zip(dims, dimensions.values(), strict=True)),
    )
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.count("*").alias("n"), *((F.max(d) - F.min(d)).alias(d) for d in dims)).first()
    whole = {d: F.lit(total[d] or 1.0) for d in dims}
    todo, done, most = rows.withColumns({"lo": F.lit(0), "k": F.lit(shards)}), [], shards
    while most > 1:
        parts = settle(_cut(todo, dims, whole))
        done.append(parts.where("k = 1"))
        todo, most = parts.where("k > 1"), most - most // 2
    done.append(todo.where("k = 1"))
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    groups = max(1, -(-total["n"] // (shards * NUMBERED)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups)))
    counts = placed.groupBy("lo", "part").agg(F.count("*").alias("own"))
    before = counts.withColumn("before", F.sum("own").over(Window.partitionBy("lo").orderBy("part")) - F.col("own")).drop("own")
    place = F.row_number().over(Window.partitionBy("lo", "part").orderBy("doc_id", "text_crc32", "row"))
    return placed.join(before, ["lo", "part"]).select(
        "doc_id", "size", "text_crc32", F.col("lo").alias("shard"), (F.col("before") + place - 1).cast("long").alias("slot"),
    )


def shard_by_bytes(docs: DataFrame, target_bytes: int, dimensions: dict[str, Column] | None = None) -> DataFrame:
    """:func:`shard` into as many shards as leave each about ``target_bytes``."""
    total = docs.agg(F.sum(sizes(F.col("text")))).first()[0] or 0
    return shard(docs, max(1, round(total / target_bytes)), dimensions)
