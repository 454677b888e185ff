"""Point-trajectory analytics on Spark DataFrames."""

from trackspark import schema
from trackspark.session import build_session, scratch_dir

__all__ = ["build_session", "schema", "scratch_dir"]
