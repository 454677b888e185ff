"""Registered queries against their SQL in DuckDB, on the smallest test tables.

A few of every area by default; all of them with TRACKSPARK_ALL_QUERIES=1.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import canon

ROOT = "/root/testdata/sf0.001"
SAMPLE = [
    "find_gaps", "find_gaps_long_tracks", "disagreement_blips", "flow_residual", "keep_complete_runs", "patch_layer",
    "diff_layers", "quality_report", "neighbour_frames_of_label", "nudge_labels", "repair_gaps", "complete_frames",
    "smooth_moving_average", "lowpass_interval", "select_across_videos", "knn", "layer_name", "prediction_files", "best_snapshots",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(ROOT):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{ROOT}/{f}'")
    return con


def test_every_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("TRACKSPARK_ALL_QUERIES") else SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, ROOT)
    rel = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r) for r in df.collect()]
    assert canon(got, df.columns) == canon(rel.fetchall(), columns)


def test_entry(spark):
    reasons = {r.reason for r in entry.entry(spark).select("reason").distinct().collect()}
    assert None in reasons and len(reasons) > 1
