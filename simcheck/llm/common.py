"""Small helpers that several operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters of the contracts: ``[\x20\x09-\x0D]``.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest measured size of a table that is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 8 << 20


#: Rows and bytes of an Arrow batch; Spark's defaults hold 10,000 whole texts at once on both sides.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
         "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it asks for others than the defaults."""
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def small_or_shuffled(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the measured rows fit ``limit``; else leave the join to a shuffle.

    ``row_bytes`` is the size of one row, a number or a column that is summed.
    Measuring reads ``df`` once, so pass a written table.
    """
    width = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    total = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df
