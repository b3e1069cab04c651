"""Merkle manifest of a table: one root for all rows, and a proof for every row.

Rows are leaves.  The leaves of a group ascend by their id; every ``FANOUT``
consecutive nodes become their digest until one node, the group's subroot,
remains; the subroots, in the order of their groups, become the root likewise.

**Proofs by pointer jumping.**  A node starts with one segment, its siblings to
the left and to the right, and a pointer to its parent.  A self-join of the
node table on the pointer appends the segments of the node pointed at and takes
over its pointer, so the distance to the ancestor doubles with every round, and
after ``log2(height)`` rounds all nodes point at the root.  The leaves of one
run have the same ancestors, so their run's parent jumps for all of them and
each leaf puts its own segment in front.

**Scale.**  Leaves are numbered by a range sort with counts per partition, so
no group, however large, meets in one task; a level is one aggregate whose
groups hold at most ``FANOUT`` nodes, and levels shrink by that factor.  Only
nodes higher than the distance reached can be pointed at, so the side of a
self-join that many rows share is small once its keys are few: it is broadcast
if its measured size allows, else shuffled over at least thousands of keys.
Levels and rounds are tables in the shared folder.

Defined results: a null id comes before all others, a null group before all
other groups; rows with one id are ordered by their digest, equal rows are
leaves of their own; a null field is ``-``; a group with one leaf has that leaf
as subroot and one group alone has its subroot as root; a leaf without siblings
has an empty proof; an empty table has no root and no rows.  Columns that are
not named as fields take no part, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simcheck.functions.ordering import global_row_number
from simcheck.llm.common import LOWER, UPPER, small_or_shuffled
from simcheck.session import materialize

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tree of the subroots; the groups' trees count from 0.
TOP = -1
#: Upper bound of the bytes of one segment in a row.
SEGMENT_BYTES = 32 * (FANOUT - 1) + 48


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of a row: its fields in order."""
    return digest(F.concat(*[field(v) for v in fields.values()]))


def tampered_leaf(fields: dict[str, Column]) -> Column:
    """The row's digest after the test tampering: A-Z of ``text`` in lower case where 3 divides the id's CRC."""
    hit = F.crc32(F.encode(fields["doc_id"].cast("string"), "UTF-8")) % 3 == 0
    text = F.when(hit, F.translate(fields["text"], UPPER, LOWER)).otherwise(fields["text"])
    return leaf(fields | {"text": text})


class Manifest(NamedTuple):
    """runs: leaves by run; hops: segments of every higher node to the root; subroots by tree; root, or None."""
    runs: DataFrame
    hops: DataFrame
    subroots: DataFrame
    root: str | None


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda all_, one: F.concat(all_, one))


def _runs(nodes: DataFrame) -> DataFrame:
    """Every FANOUT consecutive nodes of trees that still have several."""
    up = F.expr(f"at div {FANOUT}")
    return (nodes.filter("size > 1").groupBy("tree", "level", "size", up.alias("up_at"))
            .agg(F.sort_array(F.collect_list(F.struct("at", "digest", "own"))).alias("members")))


def _parents(runs: DataFrame) -> DataFrame:
    key = [F.col("tree").alias("tree"), (F.col("level") + 1).alias("level"), F.col("up_at").alias("at")]
    return runs.select(*key, F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size"),
                       digest(as_hex(_joined(F.col("members.digest")))).alias("digest"), F.struct(*key).alias("own"))


def _sides(digests: Column, place: Column) -> Column:
    """The siblings before and after the 0-based ``place`` in a run."""
    return F.struct(_joined(F.slice(digests, 1, place)).alias("left"),
                    _joined(F.slice(digests, place + 2, FANOUT)).alias("right"))


def _first_hops(runs: DataFrame) -> DataFrame:
    """Each member of a run with its segment and a pointer to its parent."""
    each = runs.select("tree", "level", "up_at", "members", F.posexplode("members").alias("place", "member"))
    return each.select(
        "member.own.*", F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), "up_at",
        F.array(_sides(F.col("members.digest"), F.col("place"))).alias("segments"))


def _climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every level, and the last node of each tree; ``most`` is the largest tree's number of nodes."""
    levels, tops = [], nodes.filter("size = 1")
    while most > 1:
        runs = materialize(_runs(nodes))
        levels.append(runs)
        nodes = _parents(runs)
        tops = tops.unionByName(nodes.filter("size = 1"))
        most = -(-most // FANOUT)
    return levels, tops


def _jump(hops: DataFrame, height: int) -> DataFrame:
    """Doubles the distance to the ancestor until every node points at the root."""
    reach = 1
    while reach < height:
        far = hops.filter((F.col("level") > reach) | (F.col("tree") == TOP)).select(
            *[F.col(c).alias(f"far_{c}") for c in hops.columns])
        far = small_or_shuffled(far, F.size("far_segments") * SEGMENT_BYTES + 64)
        met = [F.col(f"up_{c}") == F.col(f"far_{c}") for c in ("tree", "level", "at")]
        hops = materialize(hops.join(far, met, "left").select(
            "tree", "level", "at",
            *[F.coalesce(f"far_up_{c}", f"up_{c}").alias(f"up_{c}") for c in ("tree", "level", "at")],
            F.coalesce(F.concat("segments", "far_segments"), "segments").alias("segments")))
        reach *= 2
    return hops


def build(leaves: DataFrame) -> Manifest:
    """Manifest of (group, id, leaf, row): a digest per row and whatever struct ``row`` is carried along."""
    spread = leaves.select("group", "id", "leaf", "row", F.monotonically_increasing_id().alias("tie"))
    order = [F.asc_nulls_first("group"), F.asc_nulls_first("id"), F.asc("leaf"), F.asc("tie")]
    placed = global_row_number(spread, order, "place").drop("tie")
    groups = placed.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("first"))
    groups = materialize(global_row_number(groups, [F.asc_nulls_first("group")], "tree"))
    n_groups, most = groups.agg(F.count(F.lit(1)), F.max("size")).first()

    numbered = (placed.join(small_or_shuffled(groups.withColumnRenamed("group", "its"), 64),
                            F.col("group").eqNullSafe(F.col("its")))
                .select((F.col("tree") - 1).alias("tree"), "size", (F.col("place") - F.col("first")).alias("at"),
                        "leaf", "row"))
    low = F.when(F.col("size") > 1, 1).otherwise(0)
    runs = materialize(numbered.groupBy("tree", "size", low.alias("level"), F.expr(f"at div {FANOUT}").alias("at"))
                       .agg(F.sort_array(F.collect_list(F.struct(
                           F.col("at").alias("leaf_at"), F.col("leaf").alias("digest"), "row"))).alias("members")))
    key = [F.col(c) for c in ("tree", "level", "at")]
    first = runs.select(*key, F.when(F.col("level") == 0, 1).otherwise(F.expr(f"(size + {FANOUT - 1}) div {FANOUT}"))
                        .alias("size"),
                        F.when(F.col("level") == 0, F.col("members")[0]["digest"])
                        .otherwise(digest(as_hex(_joined(F.col("members.digest"))))).alias("digest"),
                        F.struct(*key).alias("own"))
    levels, tops = _climb(first, -(-(most or 0) // FANOUT))
    subroots = materialize(tops.select("tree", F.col("digest").alias("subroot"), "own"))
    heads = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("at"),
                            F.lit(n_groups).cast("long").alias("size"), F.col("subroot").alias("digest"), "own")
    upper, last = _climb(heads, n_groups)
    root = last.select(as_hex(F.col("digest"))).first()

    hops = reduce(DataFrame.unionByName, map(_first_hops, [*levels, *upper, _runs(first).limit(0)]))
    return Manifest(runs, _jump(materialize(hops), len(levels) + len(upper)), subroots.drop("own"),
                    root and root[0])


def proofs(manifest: Manifest) -> DataFrame:
    """(row, leaf, subroot, segments) for every leaf: its siblings level by level up to the root."""
    hops = manifest.hops.select("tree", "level", "at", F.col("segments").alias("above"))
    hops = small_or_shuffled(hops, F.size("above") * SEGMENT_BYTES + 32)
    each = (manifest.runs.join(hops, ["tree", "level", "at"], "left")
            .join(small_or_shuffled(manifest.subroots, 48), "tree")
            .select("level", "members", "above", "subroot", F.posexplode("members").alias("place", "member")))
    own = F.array(_sides(F.col("members.digest"), F.col("place")))
    path = F.when(F.col("level") == 0, F.coalesce("above", F.slice(own, 1, 0))).otherwise(
        F.coalesce(F.concat(own, "above"), own))
    return each.select("member.row", F.col("member.digest").alias("leaf"), "subroot", path.alias("segments"))


def proof_digest(segments: Column) -> Column:
    return F.sha2(as_hex(_joined(F.transform(segments, lambda s: F.concat(s["left"], s["right"])))), 256)


def fold(leaf_digest: Column, segments: Column) -> Column:
    """The root that follows from a leaf and its proof, as hex text."""
    return F.aggregate(segments, as_hex(leaf_digest), lambda node, s: F.sha2(
        F.concat(as_hex(s["left"]), node, as_hex(s["right"])), 256))


def manifest_of(docs: DataFrame, changed=tampered_leaf) -> DataFrame:
    """Leaf, subroot, root and proof of every row of ``docs``, checked against its ``changed`` leaf."""
    fields = {c: F.col(c) for c in FIELDS}
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf(fields).alias("leaf"),
                         F.struct(F.col("doc_id").alias("doc_id"), changed(fields).alias("seen")).alias("row"))
    made = build(leaves)
    root = F.lit(made.root).cast("string")
    folded = fold(F.col("row.seen"), F.col("segments"))
    return (proofs(made)
            .select(F.col("row.doc_id").alias("doc_id"), as_hex(F.col("leaf")).alias("leaf"),
                    as_hex(F.col("subroot")).alias("subroot"), root.alias("root"),
                    proof_digest(F.col("segments")).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
