"""simcheck: a Spark-native engine for copied and near-copied text.

Every operator takes DataFrames and returns DataFrames; the heavy work runs as
Spark jobs (joins, aggregations, windows, Arrow-batched kernels).
"""

from simcheck.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
