"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Tables stored by trace and block may be joined on frames, too, without being dealt out anew.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(app: str = "trackspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``master`` and the number of shuffle partitions are left to the cluster
    unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever it is not installed on their machine.

    Workers of a local session do not see what is only on the driver's ``sys.path``, so they get it, too.
    """
    package = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp(prefix='trackspark-')}/{package.name}"
    spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``; a local folder is made
    only where that is unset and the session runs in one process. A ``file:``
    folder is taken at the cluster's word to be mounted on every machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        root = named
    else:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            return jsc.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="trackspark-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once that several later steps read.

    The rows go to the shared folder, so losing an executor loses nothing.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint()
