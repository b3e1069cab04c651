"""Connected components of a graph given as links, each named by its smallest node.

Alternates the large-star and small-star steps: every node hands its larger
neighbours to its smallest one, then its smaller neighbours and itself.  Each
step is a partial aggregate and a join, so a node with very many neighbours is
split like any skewed key; rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simcheck.session import materialize


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_least_neighbour(both), "u").filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that is not its component's smallest."""
    now = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct())
    seen = None
    while True:
        n, mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not n or (n, mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (n, mark)
        now = materialize(_small_star(_large_star(now).filter("u <> v")).filter("u <> v").distinct())
