"""Numeric column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the blend weights start from a sigmoid that reaches this far at its ends.
EPSILON = 0.01


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distance(x0, y0, x1, y1) -> Column:
    """Euclidean distance of two points; NULL if any coordinate is missing."""
    return F.hypot(_col(x0) - _col(x1), _col(y0) - _col(y1))


def forward_weight(frame, start, end) -> Column:
    """Blend weight of the forward path: 1 at ``start``, 0 at ``end``, sigmoid between."""
    frame, start, end = _col(frame), _col(start), _col(end)
    steep = F.lit(2.0 * math.log(1.0 / EPSILON - 1.0)) / (end - start)
    centre = (start + end) / F.lit(2.0)
    sigmoid = F.lit(1.0) / (F.lit(1.0) + F.exp(steep * (frame - centre)))
    return (sigmoid - F.lit(0.5)) / F.lit(1.0 - 2.0 * EPSILON) + F.lit(0.5)


def blend(forward, reverse, weight) -> Column:
    weight = _col(weight)
    return _col(forward) * weight + _col(reverse) * (F.lit(1.0) - weight)


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda p, q: p.cast("double") * q.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def l2_normalize(a) -> Column:
    """Scale a vector to unit length; a zero vector stays zero."""
    scale = norm(a) + F.lit(1e-12)
    return F.transform(_col(a), lambda v: v.cast("double") / scale)


def polygon_area(points) -> Column:
    """Shoelace area of an ordered array of structs with x and y."""
    points = _col(points)
    rotated = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, rotated, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / F.lit(2.0)
