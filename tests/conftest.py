import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trackspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "3",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.log.level": "ERROR",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def points(spark):
    """Build a table of track points from ``{label: {frame: (x, y)}}``."""

    def build(data, video="v", layer="a"):
        rows = [
            (video, layer, label, int(f), float(xy[0]), float(xy[1]))
            for label, per in data.items()
            for f, xy in per.items()
        ]
        return spark.createDataFrame(rows, "video string, layer string, label string, frame long, x double, y double")

    return build


@pytest.fixture(scope="session")
def declare(spark):
    def build(labels, video="v", layer="a"):
        rows = [(video, layer, label, i) for i, label in enumerate(labels)]
        return spark.createDataFrame(rows, "video string, layer string, label string, pos int")

    return build


def keyed(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="session")
def rows():
    return keyed
