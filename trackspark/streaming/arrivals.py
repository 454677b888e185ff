"""Prediction files that arrive one video at a time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackspark.schema import PRED
from trackspark.session import settle

Operator = Callable[[DataFrame], DataFrame]


def stream_predictions(
    spark: SparkSession, source: str, target: str, operators: dict[str, Operator], *, checkpoint: str
) -> StreamingQuery:
    """Run batch operators over every video that has arrived, as it arrives.

    A folder is a delivery and holds all rows of its videos, so no watermark is
    needed, and only what arrived is read. A video delivered again replaces its
    results: of several deliveries in one micro-batch the folder modified last
    counts (the larger path on ties), and results that the new delivery no
    longer has are gone. A repeated micro-batch writes the same again.

    Every micro-batch has one folder per operator, whatever the number of its
    videos; `read_results` takes each video's rows from the last one that had it.
    """
    arrivals = spark.readStream.schema(PRED).option("recursiveFileLookup", "true").parquet(source)
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
    arrivals = arrivals.select("*", folder.alias("_folder"), F.col("_metadata.file_modification_time").alias("_time"))

    def handle(batch: DataFrame, number: int) -> None:
        # A new checkpoint counts its micro-batches anew, but under another id.
        stream = spark.read.json(f"{checkpoint}/metadata").first()["id"]
        handled = F.lit(time.time_ns())
        batch = batch.persist()
        newest = batch.groupBy("video").agg(F.max_by("_folder", F.struct("_time", "_folder")).alias("_folder"))
        rows = batch.join(newest, ["video", "_folder"], "left_semi").drop("_folder", "_time")
        touched = newest.select("video")
        for name, op in operators.items():
            result = settle(rows.transform(op))
            # A touched video without results gets a row that says so, in place of its old ones.
            empty = touched.join(result.select("video").distinct(), "video", "left_anti")
            gone = empty.select(*(F.col("video") if f.name == "video" else F.lit(None).cast(f.dataType).alias(f.name) for f in result.schema))
            both = result.withColumn("_kept", F.lit(True)).unionByName(gone.withColumn("_kept", F.lit(False)))
            both.withColumn("_handled", handled).write.mode("overwrite").parquet(f"{target}/{name}/{stream}-{number}")
        batch.unpersist()

    return (
        arrivals.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_results(spark: SparkSession, target: str, name: str) -> DataFrame:
    """The current results of one operator of `stream_predictions`."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{target}/{name}")
    newest = rows.groupBy("video").agg(F.max("_handled").alias("_handled"))
    return rows.join(newest, ["video", "_handled"], "left_semi").where("_kept").drop("_kept", "_handled")
