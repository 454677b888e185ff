"""Reading the tables of a folder, and columns that may be missing or clash."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just ``doc_id`` (long) and ``text``, whatever other columns the table has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Rows of a few numbers each that may be broadcast.
BROADCAST_IDS = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """A table of a few numbers per row, marked for broadcast if it has at most ``BROADCAST_IDS`` rows."""
    ids = settle(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def release() -> None:
    """Give freed memory back to the machine at the end of a task or a fit; a waiting worker or the driver would keep it from the JVM beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
