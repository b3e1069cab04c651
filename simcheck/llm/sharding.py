"""Sharding through fixed virtual slots.

Records are hashed into a fixed number of virtual slots (thousands), bytes are
aggregated per slot, and a versioned table maps slots to shards.  A record
never changes its slot; rebalancing edits the map, so only the records of the
edited slots move.  The map has one row per slot: its size is set by
``n_slots``, never by the data, which bounds what the driver sees and what is
broadcast.

A record's slot follows from its id, size and checksum, so rows that share an id
spread; more than ``HOT_ROWS`` equal rows (or a ``HOT_SHARE``-th of the table)
are dealt over slots by their place in it.

Defined results: a null text has size 1 (no bytes, plus one) and the checksum
of an empty text; a null doc_id is hashed like an id; repeated rows keep one
position each; an empty table gives no rows and a map without load; columns
beside doc_id and text are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simcheck.llm.common import text_of
from simcheck.session import materialize, scratch_dir

N_SLOTS = 4096
HOT_ROWS, HOT_SHARE = 1000, 1000
RECORD = ("doc_id", "size", "text_crc32")
MAP_SCHEMA = "virtual_slot int, shard int, slot_bytes long, slot_rows long, first_position long"


def virtual_slot(dealt: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*RECORD, dealt), F.lit(n_slots)).cast("int")


def sized(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot), written once without the texts."""
    rows = materialize(docs.select(
        "doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32")))
    often = materialize(rows.groupBy(*RECORD).count().filter(
        F.col("count") > max(HOT_ROWS, rows.count() // HOT_SHARE))
        .select(F.xxhash64(*RECORD).alias("often")).distinct())      # at most HOT_SHARE rows
    if not often.head(1):
        return rows.withColumn("virtual_slot", virtual_slot(F.lit(0).cast("long"), n_slots))
    dealt = F.when(F.col("often").isNotNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    return materialize(rows.join(F.broadcast(often), F.xxhash64(*RECORD) == F.col("often"), "left")
                       .withColumn("virtual_slot", virtual_slot(dealt, n_slots)).drop("often"))


def slot_loads(rows: DataFrame, n_slots: int = N_SLOTS) -> list[tuple[int, int]]:
    """Bytes and rows of every slot: ``n_slots`` numbers, whatever the input."""
    loads = [(0, 0)] * n_slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        loads[r["virtual_slot"]] = (r["b"], r["n"])
    return loads


def plan_map(loads: list[tuple[int, int]], n_shards: int) -> list[int]:
    """Shard of each slot: the heaviest slot first, always to the lightest shard."""
    heap = [(0, s) for s in range(n_shards)]
    shards = [0] * len(loads)
    for slot in sorted(range(len(loads)), key=lambda s: (-loads[s][0], s)):
        total, shard = heap[0]
        heapq.heapreplace(heap, (total + loads[slot][0], shard))
        shards[slot] = shard
    return shards


def rebalance(shards: list[int], loads: list[tuple[int, int]], n_shards: int) -> list[int]:
    """An edited map: slots move only from shards above the mean to shards below it.

    Adding a shard therefore moves about its share of the bytes and nothing
    between the old ones.
    """
    out = list(shards)
    total = [0] * n_shards
    members: list[list[int]] = [[] for _ in range(n_shards)]
    homeless = []
    for slot, shard in enumerate(out):
        if shard < n_shards:
            total[shard] += loads[slot][0]
            members[shard].append(slot)
        else:
            homeless.append(slot)
    mean = sum(b for b, _ in loads) / n_shards

    def give(slot: int, to: int) -> None:
        out[slot] = to
        total[to] += loads[slot][0]

    for slot in sorted(homeless, key=lambda s: (-loads[s][0], s)):
        give(slot, min(range(n_shards), key=lambda s: (total[s], s)))
    heap = [(total[s], s) for s in range(n_shards) if total[s] < mean]
    heapq.heapify(heap)
    for shard in sorted(range(n_shards), key=lambda s: (-total[s], s)):
        for slot in sorted(members[shard], key=lambda s: (-loads[s][0], s)):
            size = loads[slot][0]
            if not heap or total[shard] <= mean:
                break
            low, to = heap[0]
            if size and low + size < total[shard]:
                total[shard] -= size
                give(slot, to)
                heapq.heapreplace(heap, (total[to], to))
    return out


def write_map(spark: SparkSession, path: str, version: int, shards: list[int],
              loads: list[tuple[int, int]]) -> DataFrame:
    """Store one version of the map under ``path`` and return it as read back."""
    n_shards = max(shards, default=-1) + 1
    position = [0] * n_shards
    rows = []
    for slot, shard in enumerate(shards):
        rows.append((slot, shard, loads[slot][0], loads[slot][1], position[shard]))
        position[shard] += loads[slot][1]
    where = f"{path.rstrip('/')}/version={version}"
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(where)
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path.rstrip('/')}/version={version}")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of every row and its position there, gapless from 0.

    A slot's first position comes from the map, so only the rows of one slot
    are numbered together, never those of a whole shard.
    """
    in_slot = F.row_number().over(
        Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (rows.withColumn("__in", in_slot)
            .join(F.broadcast(slot_map.select("virtual_slot", "shard", "first_position")), "virtual_slot")
            .withColumn("slot", (F.col("first_position") + F.col("__in")).cast("long"))
            .drop("__in", "first_position"))


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS,
                    map_path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot, map_version) for every row."""
    spark = docs.sparkSession
    rows = sized(docs, n_slots)
    loads = slot_loads(rows, n_slots)
    path = map_path or scratch_dir(spark, "slot-map")
    slot_map = write_map(spark, path, 1, plan_map(loads, n_shards), loads)
    return place(rows, slot_map).withColumn("map_version", F.lit(1))
