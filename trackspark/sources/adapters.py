"""Track tables derived from the star-schema test tables.

Two families: ``events`` gives a prediction table with two labels per user
(short videos), ``lineitem`` gives one long single-label track per supplier.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackspark.functions.blocks import BLOCK, halo_window, own_rows, with_halo
from trackspark.functions.ranks import ordinal

# Block size of the registered queries; `blocks_of` changes it for a while.
_BLOCK: ContextVar[int] = ContextVar("block", default=BLOCK)


@contextmanager
def blocks_of(block: int) -> Iterator[None]:
    """Build queries with traces cut into blocks of this many frames."""
    token = _BLOCK.set(block)
    try:
        yield
    finally:
        _BLOCK.reset(token)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_block(spark: SparkSession, sf_dir: str) -> int:
    """Frames per block of the event tracks."""
    return _BLOCK.get()


def line_block(spark: SparkSession, sf_dir: str) -> int:
    """Frames per block of the line tracks."""
    return _BLOCK.get()


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video"),
        "event_type",
        F.col("value").alias("v"),
        "props",
    )
    framed = ordinal(events, ["video"], ["ts", "event_id"], name="frame")
    # Parsed once the rows are in order, not while they are counted and dealt out.
    return framed.withColumn("k", F.get_json_object("props", "$.k").cast("long")).select("event_id", "video", "event_type", "v", "k", "frame")


def predictions(spark: SparkSession, sf_dir: str, *, with_event: bool = False) -> DataFrame:
    """Predictions of two labels for every event of a user."""
    k, v, kind = F.col("k"), F.col("v"), F.col("event_type")
    first = (
        F.when(kind == "error", 0.05 + k / 200.0)
        .when((kind == "signup") & (k < 30), 0.6 + k / 100.0)
        .otherwise(0.95 + k / 2000.0)
    )
    second = F.when((kind == "purchase") & (k < 50), 0.05 + k / 100.0).otherwise(0.97)
    point = lambda label, x, y, lik: F.struct(
        F.lit(label).alias("label"), x.alias("x"), y.cast("double").alias("y"), lik.alias("likelihood")
    )
    both = F.array(point("0", v, k, first), point("1", 500 - v, 100 - k, second))
    rows = event_frames(spark, sf_dir).withColumn("p", F.explode(both))
    kept = ["video", "p.label", "frame", "p.x", "p.y", "p.likelihood"]
    return rows.select(*kept, "event_id", "k") if with_event else rows.select(*kept)


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-step displacements with a small bounded error and a few jumps."""
    block = event_block(spark, sf_dir)
    rows = with_halo(predictions(spark, sf_dir, with_event=True), before=1, after=1, block=block)
    w = halo_window(["video", "label"], block=block)
    label = F.col("label").cast("long")
    noise = lambda m: (F.pmod(F.col("event_id") * m + label, F.lit(11)) - 5) / 16.0
    jump = F.when(F.col("event_id") % 37 == 0, 20.0).otherwise(0.0)
    # Context rows are dropped, so their own incomplete neighbours do not matter.
    stepped = rows.select(
        "video",
        "label",
        "frame",
        (F.col("x") - F.lag("x").over(w) + noise(7) + jump).alias("dx_fwd"),
        (F.col("y") - F.lag("y").over(w) + noise(3)).alias("dy_fwd"),
        (F.col("x") - F.lead("x").over(w) - noise(7)).alias("dx_rev"),
        (F.col("y") - F.lead("y").over(w) - noise(3)).alias("dy_rev"),
        "_blk",
        "_own",
    )
    return own_rows(stepped)


def previous_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same predictions as an earlier model iteration saw them."""
    return predictions(spark, sf_dir, with_event=True).select(
        "video", "label", "frame",
        (F.col("x") + (F.col("event_id") % 5) * 0.5).alias("x"), "y", "likelihood",
    )


def manual_layer(spark: SparkSession, sf_dir: str, name: str = "iteration-0") -> DataFrame:
    """A sparse hand-made layer: holes in label 1 and a stray label 9."""
    base = predictions(spark, sf_dir, with_event=True).where(F.col("frame") % 5 == 0)
    kept = base.where((F.col("label") == "0") | (F.col("k") >= 20))
    stray = base.where((F.col("label") == "0") & (F.col("frame") % 20 == 0)).withColumn("label", F.lit("9"))
    return kept.unionByName(stray).select(
        "video", F.lit(name).alias("layer"), "label", "frame", "x", "y"
    )


def patch_layer_points(spark: SparkSession, sf_dir: str, name: str = "patch") -> DataFrame:
    return predictions(spark, sf_dir).where(F.col("frame") % 7 == 0).select(
        "video", F.lit(name).alias("layer"), "label", "frame", (F.col("x") + 1).alias("x"), "y"
    )


def dense_layer(spark: SparkSession, sf_dir: str, name: str = "dlc_iteration-0_100") -> DataFrame:
    return predictions(spark, sf_dir).select("video", F.lit(name).alias("layer"), "label", "frame", "x", "y")


def declared(points: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Declared labels of each layer: those with points, plus ``extra`` ones."""
    seen = points.select("video", "layer", "label").distinct()
    if extra:
        more = points.select("video", "layer").distinct().withColumn(
            "label", F.explode(F.array(*[F.lit(e) for e in extra]))
        )
        seen = seen.unionByName(more).distinct()
    # Labels of one layer of one video: a handful of rows.
    w = Window.partitionBy("video", "layer").orderBy(F.col("label").cast("int"))
    return seen.withColumn("pos", F.row_number().over(w) - 1)


def event_videos(spark: SparkSession, sf_dir: str, fps: float = 30.0) -> DataFrame:
    """Frame count of each video of the events family."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video"))
        .agg(F.count(F.lit(1)).alias("n_frames"))
        .withColumn("fps", F.lit(fps))
    )


def line_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long single-label track per supplier."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("video"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_quantity").alias("x"), "l_extendedprice", "l_discount",
    )
    ranked = ordinal(
        lines,
        ["video"],
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
        name="frame",
    )
    return ranked.select(
        "video",
        F.lit("0").alias("label"),
        "frame",
        "x",
        (F.col("l_extendedprice") / 1000).alias("y"),
        (1 - 5 * F.col("l_discount")).alias("likelihood"),
    )


def line_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact per-step displacements of the supplier tracks."""
    block = line_block(spark, sf_dir)
    rows = with_halo(line_tracks(spark, sf_dir), before=1, after=1, block=block)
    w = halo_window(["video", "label"], block=block)
    step = lambda c, f: (F.col(c) - f(c).over(w))
    return own_rows(
        rows.select(
            "video", "label", "frame",
            step("x", F.lag).alias("dx_fwd"), step("y", F.lag).alias("dy_fwd"),
            step("x", F.lead).alias("dx_rev"), step("y", F.lead).alias("dy_rev"),
            "_blk", "_own",
        )
    )


def line_videos(spark: SparkSession, sf_dir: str, fps: float = 73.94) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("video"))
        .agg(F.count(F.lit(1)).alias("n_frames"))
        .withColumn("fps", F.lit(fps))
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").alias("grp")
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interval of frames per user video."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.concat(F.lit("u"), user.cast("string")).alias("video"),
        F.lit("0").alias("label"),
        (user % 7 + 5).alias("start"),
        (user % 7 + 17 + user % 5).alias("end"),
    )


def declared_pair(points: DataFrame, labels: tuple[str, ...] = ("0", "1")) -> DataFrame:
    """The given labels declared in every layer that has points."""
    pairs = F.array(*[F.struct(F.lit(v).alias("label"), F.lit(i).alias("pos")) for i, v in enumerate(labels)])
    layers = points.select("video", "layer").distinct().withColumn("_l", F.explode(pairs))
    return layers.select("video", "layer", "_l.label", "_l.pos")
