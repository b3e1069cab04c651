"""Line dedup that stays reversible: cuckoo filters over exact reference counts.

A line's key is the line without white space at its ends and with A-Z in lower
case.  Keys of at least ``min_points`` code points found in at least two
documents lose all their lines except in the smallest doc_id that holds them.

State, in a folder of the shared store:

* ``refs/batch=N``: one row (shard, key, doc_id, step) per key and document of
  a batch; step is +1 for an insertion and -1 for a deletion.  Deleting
  documents appends, nothing is rewritten, so a lost or repeated job leaves
  the earlier batches as they were.
* the exact reference-count table, an aggregate of the references: key, number
  of documents, smallest document.
* per shard of the keys a cuckoo filter (two candidate buckets of four 16-bit
  fingerprints) of the keys that two or more documents hold.  Inserting
  documents adds the keys that become shared, deleting documents takes out the
  keys that no longer are.  A key that the filter does not have cannot be
  shared, so only its hits are looked up in the exact table; a false hit costs
  a lookup and never a line.

The filters are broadcast while their measured size is small; beyond that
references meet their shard's filter in a shuffle, with the same result.  The
number of shards follows from the bytes of the first batch, so a shard's keys
stay few.  A key held by a third
of all documents is one row after the map-side partial aggregate, and its
references are split by the skew join.

Defined results: a null or empty text is one empty line; a null doc_id is one
document that comes after all others; rows that repeat a doc_id are one
document; an empty table gives no rows; columns beside doc_id and text pass
through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simcheck.llm.common import BROADCAST_BYTES, LOWER, UPPER, WS, text_of
from simcheck.session import materialize, scratch_dir

MIN_POINTS = 10
#: Shards at least, and bytes of text a shard; groups that a shard's references are dealt to for a large filter.
N_SHARDS, SHARD_BYTES, SALTS = 64, 64 << 20, 8
NO_ID = (1 << 63) - 1
SLOTS, KICKS = 4, 500


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(WS)), UPPER, LOWER)


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc")


def references(docs: DataFrame, min_points: int = MIN_POINTS, n_shards: int = N_SHARDS) -> DataFrame:
    """(shard, key, doc): the distinct line keys of every document, as 128-bit digests."""
    keys = F.array_distinct(F.filter(F.transform(F.split(text_of(), "\n"), line_key),
                                     lambda k: F.char_length(k) >= min_points))
    digest = F.unhex(F.md5(F.col("line").cast("binary")))
    return (docs.select(doc_key(), F.explode(keys).alias("line"))
            .select(digest.alias("key"), "doc")
            .withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")))


# --- cuckoo filter ---------------------------------------------------------

def _places(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and both buckets of 16-byte keys; n_buckets is a power of two."""
    words = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
    print_ = (words[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
    print_[print_ == 0] = 1
    first = (words[:, 0] & np.uint64(n_buckets - 1)).astype(np.int64)
    return print_, first, other_bucket(first, print_, n_buckets)


def other_bucket(bucket, print_, n_buckets: int):
    return (bucket ^ (print_ * 0x5BD1E995)) & (n_buckets - 1)


class CuckooFilter:
    """Set of 16-byte keys with deletion; false hits are possible, misses are not."""

    def __init__(self, n_buckets: int, cells: np.ndarray | None = None, spare: set[bytes] | None = None):
        self.n_buckets = n_buckets
        self.cells = np.zeros((n_buckets, SLOTS), np.uint16) if cells is None else cells
        self.spare = spare or set()   # whole keys that found no cell

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.8))))))

    def insert(self, keys: list[bytes]) -> None:
        if not len(keys):
            return
        prints, first, second = _places(keys, self.n_buckets)
        rng = np.random.default_rng(0)
        for key, print_, a, b in zip(keys, prints.tolist(), first.tolist(), second.tolist(), strict=True):
            if not (self._put(a, print_) or self._put(b, print_) or self._kick(b, print_, rng)):
                self.spare.add(bytes(key))

    def _put(self, bucket: int, print_: int) -> bool:
        free = np.flatnonzero(self.cells[bucket] == 0)
        if len(free):
            self.cells[bucket, free[0]] = print_
        return len(free) > 0

    def _kick(self, bucket: int, print_: int, rng) -> bool:
        """Push fingerprints to their other bucket until one is free; undone if none is."""
        moves = []
        for _ in range(KICKS):
            slot = int(rng.integers(SLOTS))
            moves.append((bucket, slot, int(self.cells[bucket, slot])))
            self.cells[bucket, slot], print_ = print_, moves[-1][2]
            bucket = int(other_bucket(bucket, print_, self.n_buckets))
            if self._put(bucket, print_):
                return True
        for bucket, slot, was in reversed(moves):
            self.cells[bucket, slot] = was
        return False

    def delete(self, keys: list[bytes]) -> None:
        """Take out keys that were inserted before."""
        if not len(keys):
            return
        for key, print_, a, b in zip(keys, *(x.tolist() for x in _places(keys, self.n_buckets)), strict=True):
            if bytes(key) in self.spare:
                self.spare.discard(bytes(key))
                continue
            for bucket in (a, b):
                at = np.flatnonzero(self.cells[bucket] == print_)
                if len(at):
                    self.cells[bucket, at[0]] = 0
                    break

    def has(self, keys: list[bytes]) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        prints, first, second = _places(keys, self.n_buckets)
        hit = ((self.cells[first] == prints[:, None]) | (self.cells[second] == prints[:, None])).any(axis=1)
        if self.spare:
            hit |= np.fromiter((bytes(k) in self.spare for k in keys), bool, len(keys))
        return hit


FILTER_SCHEMA = "shard int, n_buckets long, cells binary, spare array<binary>"


def _load(row) -> CuckooFilter:
    cells = np.frombuffer(row["cells"], np.uint16).reshape(-1, SLOTS).copy()
    return CuckooFilter(int(row["n_buckets"]), cells, {bytes(k) for k in row["spare"]})


def _row(shard: int, f: CuckooFilter) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "n_buckets": [f.n_buckets], "cells": [f.cells.tobytes()],
                         "spare": [sorted(f.spare)]})


def build_filters(shared: DataFrame) -> DataFrame:
    """One filter per shard from the keys (shard, key) that several documents hold."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.sized(len(pdf))
        f.insert(sorted(map(bytes, pdf["key"])))
        return _row(int(pdf["shard"].iloc[0]), f)

    return shared.select("shard", "key").groupBy("shard").applyInPandas(build, FILTER_SCHEMA)


def update_filters(filters: DataFrame, entering: DataFrame, leaving: DataFrame) -> DataFrame:
    """Filters after keys became shared (``entering``) or no longer are (``leaving``)."""
    changes = (entering.select("shard", "key", F.lit(1).alias("step"))
               .unionByName(leaving.select("shard", "key", F.lit(-1).alias("step"))))

    def apply(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        keys_in = sorted(map(bytes, new.loc[new["step"] > 0, "key"]))
        keys_out = sorted(map(bytes, new.loc[new["step"] < 0, "key"]))
        f = _load(old.iloc[0]) if len(old) else CuckooFilter.sized(len(keys_in))
        f.delete(keys_out)
        f.insert(keys_in)
        return _row(int(key[0]), f)

    return (filters.groupBy("shard").cogroup(changes.groupBy("shard"))
            .applyInPandas(apply, FILTER_SCHEMA))


def probe(refs: DataFrame, filters: DataFrame, limit: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """The references whose key a filter has.

    Filters of up to ``limit`` bytes are sent to every task.  Beyond that each
    reference meets its shard's filter in a shuffle: references of a shard are
    dealt by document over ``salts`` groups, each of which gets the filter first.
    """
    size = filters.agg(F.sum(F.octet_length("cells") + 64 + 24 * F.size("spare"))).first()[0] or 0
    if size > limit:
        return _probe_shuffled(refs, filters, salts)
    sent = refs.sparkSession.sparkContext.broadcast([r.asDict() for r in filters.collect()])

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_shard = {r["shard"]: _load(r) for r in sent.value}
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for shard, at in pdf.groupby("shard").indices.items():
                if shard in by_shard:
                    keep[at] = by_shard[shard].has(pdf["key"].to_numpy()[at])
            yield pdf[keep]

    return refs.mapInPandas(hits, refs.schema)


def _probe_shuffled(refs: DataFrame, filters: DataFrame, salts: int) -> DataFrame:
    parts = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = refs.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    both = (parts.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True)
            .repartition("shard", "salt").sortWithinPartitions("shard", "salt", "asked"))
    names = refs.columns

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, None                        # the group, and its filter
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            place = pdf[["shard", "salt"]].to_numpy()
            edge = np.concatenate(([0], np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1, [len(pdf)]))
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if s == e:
                    continue
                if at != tuple(place[s]):
                    at, own = tuple(place[s]), None
                part = pdf.iloc[s:e]
                asked = part["asked"].to_numpy(bool)
                if not asked[0]:
                    own = _load(part.iloc[0])
                if own is not None and asked.any():
                    keep[s:e][asked] = own.has(part["key"].to_numpy()[asked])
            yield pdf.loc[keep, names].astype({"doc": "int64"})

    return both.mapInPandas(hits, refs.schema)


# --- index -------------------------------------------------------------------

class LineIndex:
    """Reference counts and filters of the lines of a changing set of documents."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_points: int = MIN_POINTS,
                 n_shards: int | None = None):
        self.spark, self.min_points, self.n_shards = spark, min_points, n_shards
        self.path = path or scratch_dir(spark, "line-index")
        self.batches = 0
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None

    def refs(self, docs: DataFrame) -> DataFrame:
        return references(docs, self.min_points, self.n_shards)

    def insert(self, docs: DataFrame) -> None:
        """Add documents; a document stands once in a batch, whether or not rows repeat it."""
        per_doc = docs.groupBy(doc_key()).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
        most, size = per_doc.agg(F.max("rows"), F.sum("bytes")).first()
        self.n_shards = self.n_shards or max(N_SHARDS, (size or 0) // SHARD_BYTES)
        self._append(self.refs(docs).distinct() if (most or 0) > 1 else self.refs(docs), 1)

    def delete(self, docs: DataFrame) -> None:
        """Forget documents; ``docs`` holds them as they were inserted."""
        self._append(self.refs(docs).distinct(), -1)

    def _append(self, refs: DataFrame, step: int) -> None:
        where = f"{self.path}/refs/batch={self.batches}"
        refs.withColumn("step", F.lit(step)).write.mode("overwrite").parquet(where)
        self.batches += 1
        before = self.counts
        self.counts = materialize(self._count())
        shared = self.counts.filter("n_docs > 1")
        if before is None:
            self.filters = materialize(build_filters(shared))
        else:
            was = before.filter("n_docs > 1")
            self.filters = materialize(update_filters(
                self.filters, shared.join(was, ["shard", "key"], "left_anti"),
                was.join(shared, ["shard", "key"], "left_anti")))

    def _count(self) -> DataFrame:
        """Exact table (shard, key, n_docs, min_doc) of the documents that are there now.

        What the last batch that names a document and key did to them holds.
        """
        rows = (self.spark.read.option("basePath", f"{self.path}/refs")
                .parquet(*[f"{self.path}/refs/batch={b}" for b in range(self.batches)]))
        if self.batches > 1:
            rows = rows.groupBy("shard", "key", "doc").agg(F.max_by("step", "batch").alias("last")).filter("last > 0")
        return rows.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("min_doc"))

    def drops(self, refs: DataFrame) -> DataFrame:
        """(doc, keys): the line keys that each of the documents loses."""
        shared = self.counts.filter("n_docs > 1").select("shard", "key", "min_doc")
        return (probe(refs, self.filters).join(shared, ["shard", "key"])
                .filter(F.col("doc") != F.col("min_doc"))
                .groupBy("doc").agg(F.collect_set("key").alias("keys")))


ROWS_OUT = 512
NEW = {"n_lines": T.LongType(), "n_dropped": T.LongType(), "kept_text": T.StringType()}


def strip_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text (columns of these names are replaced).

    Other columns pass through as Arrow arrays.  Results leave a task in small
    batches, so whole texts never pile up on either side of the exchange.
    """
    joined = (docs.drop(*NEW).withColumn("__doc", doc_key())
              .join(drops.withColumnRenamed("doc", "__doc").withColumnRenamed("keys", "__keys"), "__doc", "left")
              .drop("__doc"))
    names = [c for c in joined.columns if c != "__keys"]
    schema = T.StructType([*[joined.schema[c] for c in names], *[T.StructField(n, t) for n, t in NEW.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(start, ROWS_OUT)
                lines, dropped, kept = [], [], []
                for text, keys in zip(part.column("text").to_pylist(), part.column("__keys").to_pylist(), strict=True):
                    own = (text or "").split("\n")
                    stay = own
                    if keys:
                        gone = set(keys)
                        stay = [x for x in own if hashlib.md5(_key(x)).digest() not in gone]
                    lines.append(len(own))
                    dropped.append(len(own) - len(stay))
                    kept.append("\n".join(stay))
                new = [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + new, [*names, *NEW])

    return joined.mapInArrow(run, schema)


def _key(line: str) -> bytes:
    return line.encode().strip(WS.encode()).lower()


def line_dedup(docs: DataFrame, min_points: int = MIN_POINTS, n_shards: int | None = None) -> DataFrame:
    """``docs`` with n_lines (before dropping), n_dropped and kept_text, through a fresh index."""
    index = LineIndex(docs.sparkSession, None, min_points, n_shards)
    index.insert(docs.select("doc_id", "text"))
    refs = docs.sparkSession.read.parquet(f"{index.path}/refs/batch=0").drop("step")
    return strip_lines(docs, index.drops(refs))
