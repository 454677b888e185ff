"""Track tables stored in blocks, so that ordered operators start without a shuffle.

A stored table is bucketed by trace and block and sorted by frame. Rows near a block border are written to the neighbouring
block, too, as context; ``_own`` tells them apart. Block size and context are kept with the schema. Points, flow and landings
stored with the same number of buckets meet in place: joins on trace, block and frame (with the setting that `build_session`
makes), windows along a block and cogrouped passes over both all find their rows where they lie. A trace of any length is spread over as many buckets as it has blocks.

These operators know the layout: ``detect.uncertain_runs`` (``dense``), ``detect.disagreement`` and its runs and blips,
``flow.flow_residual``, ``smooth.smooth_moving_average``. For others, `functions.blocks.plain_rows` gives the plain table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from trackspark.functions.blocks import BLK, BLOCK, with_halo
from trackspark.schema import TRACE
from trackspark.session import scratch_dir


def store_blocks(
    df: DataFrame,
    name: str,
    *,
    context: int = 0,
    block: int = BLOCK,
    buckets: int | None = None,
    keys: Sequence[str] = TRACE,
) -> DataFrame:
    """Write a track table in blocks as the table ``name`` of the catalog, below the shared folder, and read it back.

    ``context`` is the largest number of neighbouring frames that an operator will look at; ``buckets`` should be equal for
    tables that meet (default: the number of shuffle partitions).
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one file for each bucket
    rows = with_halo(df, before=context, after=context, block=block).repartition(buckets, *keys, BLK)
    rows = rows.withMetadata(BLK, {"block": block, "context": context})
    out = rows.write.format("parquet").option("path", scratch_dir(spark, name)).mode("overwrite")
    out.bucketBy(buckets, *keys, BLK).sortBy(*keys, BLK, "frame").saveAsTable(name)
    return spark.table(name)
