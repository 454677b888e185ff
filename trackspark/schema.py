"""Table schemas and the NULL convention.

Missing coordinates are NULL in every table. NaN is turned into NULL on entry,
because Spark orders NaN above all numbers and would treat a missing
likelihood as a confident one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

TRACK = _table(video=_S, layer=_S, label=_S, frame=_L, x=_D, y=_D)
DECLARED = _table(video=_S, layer=_S, label=_S, pos=_I)
VIDEOS = _table(video=_S, n_frames=_L, fps=_D)
PRED = _table(video=_S, label=_S, frame=_L, x=_D, y=_D, likelihood=_D)
FLOW = _table(video=_S, label=_S, frame=_L, dx_fwd=_D, dy_fwd=_D, dx_rev=_D, dy_rev=_D)
TRACKS = _table(run_id=_S, video=_S, label=_S, frame=_L, fwd_x=_D, fwd_y=_D, rev_x=_D, rev_y=_D)
EMBEDDINGS = _table(id=_L, embedding=T.ArrayType(T.FloatType()), grp=_I)
EVALUATION = _table(iteration=_I, step=_L, test_error=_D)

TRACE = ("video", "label")
LAYER = ("video", "layer")
LAYER_TRACE = ("video", "layer", "label")


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in the given (default: all) floating columns."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    chosen = set(floating if columns is None else columns)
    return df.select(
        *[
            F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in chosen else F.col(c)
            for c in df.columns
        ]
    )


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema`` and cast them; missing ones are an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return nan_to_null(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]))
