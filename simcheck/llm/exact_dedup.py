"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted.  Level 1 keeps lengths that occur twice,
level 2 keeps (length, prefix hash) pairs that occur twice, and only rows of
those groups have their whole text hashed.  The text itself is never shuffled
while the surviving group keys fit a measured broadcast; beyond that the rows
are joined with the keys by a shuffle, with the same result.

Everything is DataFrame functions.  Groups are counted with map-side partial
aggregates and joined back to their rows, so a group holding a third of all
rows is split by the skew join like any other.

Defined results: a null text counts as empty, so null, empty and blank texts
are one group; a null doc_id loses against any other; rows that repeat a
doc_id and its text all count in ``group_size`` and share one answer; an empty
table gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simcheck.llm.common import BROADCAST_BYTES, WS_CLASS, small_or_shuffled, text_of
from simcheck.session import materialize

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WS_CLASS + "+", "")


def exact_dedup(docs: DataFrame, carry: dict[str, Callable[[Column], Column]] | None = None,
                prefix_chars: int = PREFIX_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, *carry) for every row of ``docs``.

    Of equal texts the row with the most code points in its original text
    stays, then the smallest doc_id.  ``carry`` names columns to compute from
    the normalised text while the last level has it at hand.
    """
    carry = carry or {}
    rows = docs.select("doc_id", F.char_length(text_of()).alias("n_points"),
                       normalised(text_of()).alias("norm"))
    keyed = rows.withColumns({"len": F.char_length("norm"),
                              "prefix": F.xxhash64(F.substring("norm", 1, prefix_chars))})

    keys = materialize(keyed.select("len", "prefix"))
    lengths = keys.groupBy("len").count().filter("count > 1").select("len")
    prefixes = materialize(
        keys.join(small_or_shuffled(lengths, 16, broadcast_bytes), "len", "left_semi")
        .groupBy("len", "prefix").count().filter("count > 1")
        .select("len", "prefix", F.lit(True).alias("alike")))

    hashed = materialize(
        keyed.join(small_or_shuffled(prefixes, 32, broadcast_bytes), ["len", "prefix"], "left")
        .select("doc_id", "n_points", "len", "prefix",
                F.when(F.col("alike"), F.unhex(F.sha2("norm", 256))).alias("full"),
                *[make(F.col("norm")).alias(name) for name, make in carry.items()]))

    # written, so that neither side of the join below is tied to the other's partitions
    # and rows of a large group can be split over tasks
    groups = materialize(hashed.filter("full is not null").groupBy("len", "prefix", "full")
              .agg(F.count(F.lit(1)).alias("members"),
                   F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("low_id"))).alias("best"))
              .filter("members > 1")
              .select("len", "prefix", "full", "members",
                      F.bitwise_not("best.low_id").alias("best_id")))
    return (hashed.join(small_or_shuffled(groups, 96, broadcast_bytes), ["len", "prefix", "full"], "left")
            .withColumn("keep_id", F.when(F.col("members").isNotNull(), F.col("best_id"))
                        .otherwise(F.col("doc_id")))
            .select("doc_id", "keep_id",
                    F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *carry))
