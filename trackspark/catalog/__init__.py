"""All registered queries."""

from __future__ import annotations

import importlib

from trackspark.catalog.base import ORACLES, QUERIES
from trackspark.sources.adapters import blocks_of

AREAS = [
    "detection", "layering", "auditing", "lookups", "repairing", "selecting", "curating", "naming", "filing", "modelling",
]


# Ordered queries that are registered a second time with tracks cut into very small blocks, against the same SQL.
IN_BLOCKS = [
    "keep_complete_runs", "find_gaps", "find_gaps_long_tracks", "rejected_runs", "gap_label_stats", "runs_with_gap",
    "nearest_confident", "flow_residual", "sample_gaps", "select_training_frames", "neighbour_frames_of_label",
    "common_nearest_frame", "repair_gaps", "gap_verdicts", "rstc_blend", "interpolate_interval", "propagate",
    "interpolate_between_labels", "completion_tally", "smooth_moving_average", "decimate_interval", "lowpass_interval", "lowpass_level",
    "deblip_trace",
]
SMALL_BLOCK = 16


def _in_small_blocks(build):
    def query(spark, sf_dir):
        with blocks_of(SMALL_BLOCK):
            return build(spark, sf_dir)

    return query


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"trackspark.catalog.{area}")
    for name in IN_BLOCKS:
        QUERIES[f"{name}_in_blocks"], ORACLES[f"{name}_in_blocks"] = _in_small_blocks(QUERIES[name]), ORACLES[name]


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)
