"""Global positions without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row to
one task.  Here the frame is range-sorted across all partitions, each row gets
its position inside its partition, and a tiny per-partition count table
(one row per partition, broadcast) supplies the offsets.  The sorted frame is
checkpointed to the shared checkpoint folder first so both passes see the
same partitioning even if executors are lost and tasks re-run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simcheck.session import checkpoint_root


def _placed(df: DataFrame, order_cols: list) -> DataFrame:
    """The frame range-sorted and checkpointed, with partition and place columns."""
    checkpoint_root(df.sparkSession)
    return (df.orderBy(*order_cols)
            .withColumn("__pid", F.spark_partition_id())
            .withColumn("__mid", F.monotonically_increasing_id())
            .checkpoint(eager=True))


def _offsets(per_partition: DataFrame, col: str) -> DataFrame:
    """Sum of ``col`` over all earlier partitions; one row per partition."""
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    return per_partition.withColumn(f"{col}_off", F.coalesce(F.sum(col).over(w), F.lit(0)))


def global_row_number(df: DataFrame, order_cols: list, out: str = "row_num") -> DataFrame:
    """Adds ``out`` = 1-based position in the total order ``order_cols`` (must be unique)."""
    ordered = _placed(df, order_cols)
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    offsets = _offsets(ordered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n")), "__n").drop("__n")
    return (ordered.join(F.broadcast(offsets), "__pid")
            .withColumn(out, F.col("__n_off") + local + 1)
            .drop("__pid", "__mid", "__n_off"))


def global_running_sum(df: DataFrame, order_cols: list, value: str, row: str, before: str) -> DataFrame:
    """Adds ``row`` (1-based position) and ``before`` (sum of ``value`` over all earlier rows)."""
    ordered = _placed(df, order_cols)
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    per = ordered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__s"))
    offsets = _offsets(_offsets(per, "__n"), "__s").drop("__n", "__s")
    w = Window.partitionBy("__pid").orderBy("__mid").rowsBetween(Window.unboundedPreceding, -1)
    return (ordered.withColumn("__local_sum", F.coalesce(F.sum(value).over(w), F.lit(0)))
            .join(F.broadcast(offsets), "__pid")
            .withColumn(row, F.col("__n_off") + local + 1)
            .withColumn(before, F.col("__s_off") + F.col("__local_sum"))
            .drop("__pid", "__mid", "__n_off", "__s_off", "__local_sum"))


def ntile_from_position(pos_col: str, total: int, parts: int) -> F.Column:
    """``ntile(parts)`` from a 1-based position and the row total (first N % parts get one more)."""
    q, r = divmod(total, parts)
    i = F.col(pos_col) - 1
    big = r * (q + 1)
    if q == 0:
        return (i + 1).cast("int")
    return F.when(i < big, (i / F.lit(q + 1)).cast("int") + 1) \
        .otherwise(F.lit(r) + ((i - big) / F.lit(q)).cast("int") + 1).cast("int")
