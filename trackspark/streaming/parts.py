"""Gaps of traces that arrive in parts.

Each trace keeps a few rows as state: the confident rows before an open run, the run itself while it may still become a gap,
and the confident rows after it until they suffice. That is ``max_gap + 2 * bracket`` rows at most, however long the trace;
of a run that grew too long only the last row stays, as a sign of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackspark.operators.detect import BRACKET, HIGH, LOW, MAX_GAP
from trackspark.schema import TRACE

GAP = "video string, label string, start long, end long, length long, ax0 double, ay0 double, ax1 double, ay1 double, min_likelihood double"
STATE = "frames array<bigint>, xs array<double>, ys array<double>, likelihoods array<double>, overlong boolean"


def gaps_in_parts(
    arrivals: DataFrame, *, low: float = LOW, high: float = HIGH, bracket: int = BRACKET, max_gap: int = MAX_GAP
) -> DataFrame:
    """The gaps of `detect.find_gaps` with ``dense``, each as soon as the rows after it have arrived.

    ``arrivals`` is a stream of predictions with a row for every frame. The parts of a trace arrive in the order of their
    frames, in any number of micro-batches; rows of one micro-batch may be in any order. Frames at or before the last one
    of an earlier micro-batch are taken as repeated deliveries and left out.
    """
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # There are very many short parts, so rows are handled as arrays; a table for each part would cost more than its rows.
        parts = list(parts)
        column = lambda name, kind: np.concatenate([p[name].to_numpy(kind) for p in parts])
        frame, first = np.unique(column("frame", np.int64), return_index=True)
        points, overlong = [column(c, float)[first] for c in ("x", "y", "likelihood")], False
        if state.exists:
            frames, *held, overlong = state.get
            later = frame > frames[-1] if len(frames) else np.full(len(frame), True)
            frame = np.concatenate([np.array(list(frames), np.int64), frame[later]])
            points = [np.concatenate([np.array(list(old), float), new[later]]) for old, new in zip(held, points, strict=True)]
        x, y, likelihood = points
        ok = ~np.isnan(likelihood) & (likelihood >= high)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], ok, [True])).astype(int)))
        found, keep = [], max(0, len(frame) - bracket)
        for a, b in zip(edges[::2], edges[1::2], strict=True):  # rows a .. b - 1 are a run
            long = b - a > max_gap or (a == 0 and overlong)
            after = ok[b : b + bracket]
            if long or a < bracket or not ok[a - bracket : a].all() or not after.all():
                if b == len(frame):  # the run is open; of one that can't become a gap its last row tells
                    hopeless = long or a < bracket or not ok[a - bracket : a].all()
                    keep = len(frame) - 1 if hopeless else a - bracket
                continue
            if len(after) < bracket:
                keep = min(keep, a - bracket)
                continue
            worst = np.nan if np.isnan(likelihood[a:b]).any() else likelihood[a:b].min()
            if not worst > low:
                found.append((*key, int(frame[a]), int(frame[b - 1]), int(b - a), x[a - 1], y[a - 1], x[b], y[b], worst))
        first_open = len(frame) and not ok[keep] and keep == len(frame) - 1
        plain = lambda values: [None if v != v else v for v in values.tolist()]
        state.update(([int(f) for f in frame[keep:]], plain(x[keep:]), plain(y[keep:]), plain(likelihood[keep:]), bool(first_open)))
        if found:
            columns = ["video", "label", "start", "end", "length", "ax0", "ay0", "ax1", "ay1", "min_likelihood"]
            yield pd.DataFrame(found, columns=columns)

    rows = arrivals.select(*TRACE, "frame", "x", "y", "likelihood")
    return rows.groupBy(*TRACE).applyInPandasWithState(step, GAP, STATE, "append", GroupStateTimeout.NoTimeout)
