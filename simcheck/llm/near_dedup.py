"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set holds its distinct five-word shingles (words in lower case);
two documents are linked when 100 * intersection >= 85 * union on the full
sets, and a component is what links connect.

1. Signatures.  Every set gets K MinHash coordinates.  Documents with the same
   set are one node from here on.
2. Postings.  Nodes are posted under their first L coordinate-value pairs.  A
   linked pair shares at least ``need`` of them and ``match`` of all K but for
   one pair in 10^8 (binomial tail); a node with fewer than ``need`` pairs that
   anyone shares has no link and leaves.
3. Stars.  In each posting list one node, the one that shares most and has the
   smallest id among those (an original rather than an edited copy), is set
   against the others; each node verifies its most frequent partner on the
   full sets.  A second round draws the node by a hash.  That joins the bulk of large groups with a number of pairs that
   is linear in the postings.
4. Merging.  Lists whose nodes still lie in several components are merged
   whole: in blocks of bounded size the collisions of all coordinates are
   counted for pairs of different components.  A pair is counted only in the
   first list it shares and in none of the last need - 1 lists, which a pair
   with enough matches can skip.  Pairs that the sizes rule out are skipped
   too: shingles that no other node of these lists has cannot be in an
   intersection.  What is left is verified on the full sets.

No step lists all pairs of a group: identical sets are one node, pairs within
a component are never formed, and the rest must pass the match threshold.
Full sets are computed from whole texts, only for nodes that share enough.

Defined results: a text without words (null, empty, blank) has an empty set
and no link; a text of fewer than five words has its whole sequence as one
shingle; rows that repeat a doc_id are one document, which links the sets of
all its texts; rows without a doc_id are documents of their own, after all
others; an empty table gives no rows; columns beside doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simcheck.functions.ordering import global_row_number
from simcheck.llm.common import small_or_shuffled
from simcheck.llm.components import components
from simcheck.llm.textwords import chunks, mix64, per_text, stream, words_of
from simcheck.session import materialize

WIDTH, PERCENT = 5, 85
COORDINATES, POSTED = 192, 24
LOSS = 1e-8
BLOCK = 512
NO_ID = (1 << 63) - 1
ROWS_OUT = 2048


def least_matches(n: int, share: float, loss: float = LOSS) -> int:
    """The largest m such that fewer than m of n coordinates agree with a chance of at most ``loss``."""
    tail, m = 0.0, 0
    while tail + (p := comb(n, m) * share**m * (1 - share) ** (n - m)) <= loss:
        tail, m = tail + p, m + 1
    return m


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    keys = stream(width, 1 << 20)
    for part in chunks(texts):
        w = words_of(texts[part])
        first, count = per_text(w)
        if len(w.code) >= width:
            rolled = w.code[:len(w.code) - width + 1] * keys[0]
            for k in range(1, width):
                rolled = rolled + w.code[k:len(w.code) - width + 1 + k] * keys[k]
            rolled = mix64(rolled)
        for f, n in zip(first.tolist(), count.tolist(), strict=True):
            if n >= width:
                out.append(np.unique(rolled[f:f + n - width + 1]))
            elif n:
                whole = (w.code[f:f + n] * keys[:n]).sum(dtype=np.uint64)
                out.append(mix64(np.array([whole + np.uint64(n)])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


_A = stream(COORDINATES, 1 << 21)


def signature(hashes: np.ndarray, step: int = 8192) -> np.ndarray:
    """K coordinates: the smallest of the set under K multiplicative orders."""
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(hashes), step):
        part = hashes[k:k + step]
        best = np.minimum(best, ((_A[:, None] * part[None, :]) >> np.uint64(32)).min(axis=1))
    return best.astype("<u4")


_PLACE = np.arange(POSTED, dtype=np.int64) << 32


def sketches(docs: DataFrame) -> DataFrame:
    """(doc, n, set_id, sig, posts) of every row; no set_id for an empty set."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), ROWS_OUT):
                part = pdf.iloc[k:k + ROWS_OUT]
                sets = shingle_sets([t.encode() if t else b"" for t in part["text"]])
                sigs = [signature(s) if len(s) else None for s in sets]
                yield pd.DataFrame({
                    "doc": part["doc"].to_numpy(), "n": [len(s) for s in sets],
                    "set_id": [_set_id(s.tobytes()) if len(s) else None for s in sets],
                    "sig": [None if g is None else g.tobytes() for g in sigs],
                    "posts": [None if g is None else _PLACE | g[:POSTED].astype(np.int64) for g in sigs]})

    return (docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")
            .mapInPandas(run, "doc long, n long, set_id binary, sig binary, posts array<long>"))


def full_sets(docs: DataFrame, nodes: DataFrame, several: bool) -> DataFrame:
    """(node, hashes): the packed shingle set of every node (node, doc, set_id), from its whole text.

    ``several``: a document may have several sets; the node's own is the one with its set_id.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), ROWS_OUT):
                part = pdf.iloc[k:k + ROWS_OUT]
                sets = shingle_sets([t.encode() if t else b"" for t in part["text"]])
                packed = [s.tobytes() for s in sets]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "hashes": packed,
                                    "own": [_set_id(h) == want for h, want in zip(packed, part["set_id"])] if several else True})

    wanted = small_or_shuffled(nodes.select("node", "doc", "set_id"), 64)
    found = (docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text").join(wanted, "doc")
             .select("node", "text", "set_id").mapInPandas(run, "node long, hashes binary, own boolean").filter("own"))
    return (found.dropDuplicates(["node"]) if several else found).select("node", "hashes")


def _set_id(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as links (u, v)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for i, (x, y) in enumerate(zip(pdf["x"], pdf["y"], strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pdf.loc[keep, ["u", "v"]]

    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
            .select(F.col("a").alias("u"), F.col("b").alias("v"), "x", "y")
            .mapInPandas(run, "u long, v long"))


def with_component(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    return (rows.join(comps, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"))


def star_pairs(posts: DataFrame, order: str) -> DataFrame:
    """(a, b): each node with the hub it meets in most lists, if their components differ."""
    hubs = (posts.groupBy("post").agg(F.max(F.struct(F.expr(order).alias("o"), "node", "comp")).alias("hub"))
            .select("post", F.col("hub.node").alias("a"), F.col("hub.comp").alias("a_comp")))
    met = (posts.join(hubs, "post").filter("comp <> a_comp")
           .groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("met")))
    return met.groupBy("b").agg(F.max(F.struct("met", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")


def merge_lists(members: DataFrame, match: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of different components that agree in enough coordinates.

    ``members``: (post, size, node, comp, sig, n, shared).  A list is cut into
    blocks, and each pair of blocks is one group of at most 2 * block rows.
    """
    n_blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    dealt = (members.withColumn("n_blocks", n_blocks).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
             .select("post", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                     "node", "comp", "sig", "n", "shared"))

    def pairs_of(g: dict[str, np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        place = int(g["post"][0] >> 32)
        sig = np.frombuffer(b"".join(g["sig"]), "<u4").reshape(-1, COORDINATES)
        crossed = g["i"][0] != g["j"][0]
        left, right = [], []
        for r in np.flatnonzero(g["own"] == g["i"][0]):
            if crossed:
                to = np.flatnonzero(g["own"] == g["j"][0])
            else:
                to = np.arange(r + 1, len(sig))
            to = to[g["comp"][to] != g["comp"][r]]
            both = np.minimum(g["shared"][to], g["shared"][r])
            to = to[100 * both >= percent * (g["n"][to] + g["n"][r] - both)]
            if not len(to):
                continue
            same = sig[to] == sig[r]
            to = to[(same.sum(axis=1) >= match) & ~same[:, :place].any(axis=1)]
            left.append(np.full(len(to), g["node"][r]))
            right.append(g["node"][to])
        return left, right

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["post", "i", "j"]].to_numpy()
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            stop = last[-1] + 1 if len(last) else 0
            rest = pdf.iloc[stop:]
            yield from groups(pdf.iloc[:stop], key[:stop])
        if rest is not None:
            yield from groups(rest, rest[["post", "i", "j"]].to_numpy())

    def groups(pdf: pd.DataFrame, key: np.ndarray) -> Iterator[pd.DataFrame]:
        if not len(pdf):
            return
        edge = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(pdf)]))
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        left, right = [], []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if e - s > 1:
                a, b = pairs_of({c: v[s:e] for c, v in columns.items()})
                left += a
                right += b
        if left:
            yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    return (dealt.repartition("post", "i", "j").sortWithinPartitions("post", "i", "j", "node")
            .mapInPandas(run, "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    need = least_matches(POSTED, percent / 100)
    match = least_matches(COORDINATES, percent / 100)
    all_docs = materialize(sketches(docs))
    several = all_docs.groupBy("doc").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"),
                                          F.count("set_id").alias("sets"), F.count(F.lit(1)).alias("all"))
    several = bool(several.filter("low <> high or (sets > 0 and sets < all)").head(1))
    nodes = (all_docs.filter("set_id is not null").groupBy("set_id")
             .agg(F.min("doc").alias("doc"), F.first("sig").alias("sig"), F.first("posts").alias("posts"),
                  F.first("n").alias("n")))
    # a set is named by its smallest document, or, where that may have other sets too, by a number in this order
    nodes = materialize(global_row_number(nodes, ["doc", "set_id"], "node") if several
                        else nodes.withColumn("node", F.col("doc")))

    # nodes that share enough of their posted coordinates, and their posting lists
    posted = nodes.select("node", F.explode("posts").alias("post"))
    lists = materialize(posted.groupBy("post").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    shared = materialize(posted.join(lists, "post"))
    alive = materialize(shared.groupBy("node").agg(F.count(F.lit(1)).alias("met"), F.sum("size").alias("weight"))
                        .filter(F.col("met") >= need).select("node", "weight"))
    posts = materialize(shared.join(small_or_shuffled(alive, 32), "node").select("post", "size", "node", "weight"))
    sets = materialize(full_sets(docs, nodes.select("node", "doc", "set_id").join(
        small_or_shuffled(alive, 32), "node", "left_semi"), several))

    links = same_document(all_docs, nodes) if several else None
    comps = materialize(components(links)) if several else None
    for order in ("struct(weight, ~node)", "struct(xxhash64(node), node)"):
        found = confirmed(materialize(star_pairs(with_component(posts, comps), order)), sets, percent)
        links = materialize(found if links is None else links.unionByName(found))
        comps = materialize(components(links))

    # lists that still hold several components, without the last need - 1 coordinates
    open_posts = with_component(posts.filter(F.shiftright("post", 32) <= POSTED - need), comps)
    several = (open_posts.groupBy("post").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                              F.count(F.lit(1)).alias("size")).filter("low <> high"))
    members = materialize(open_posts.drop("size", "weight").join(materialize(several).select("post", "size"), "post"))
    open_nodes = materialize(members.select("node").distinct())
    reach = materialize(shared_sizes(sets.join(small_or_shuffled(open_nodes, 24), "node", "left_semi"), percent))
    detail = materialize(nodes.select("node", "sig", "n").join(reach, "node"))
    pairs = merge_lists(members.join(detail, "node"), match, percent)
    links = materialize(links.unionByName(confirmed(materialize(pairs.distinct()), sets, percent)))
    comps = materialize(components(links))

    by_set = nodes.select("set_id", "doc", "node").join(comps, "node", "left") \
        .select("set_id", "doc", F.coalesce("root", "node").alias("comp"))
    if several:
        first = by_set.groupBy("comp").agg(F.min("doc").alias("first"))
        by_set = by_set.join(first, "comp").withColumn("comp", F.col("first"))
    by_set = small_or_shuffled(materialize(by_set.select("set_id", "comp")), 48)
    rows = all_docs.select("doc", "n", "set_id").join(by_set, "set_id", "left").withColumn("comp", F.coalesce("comp", "doc"))
    if several:                     # rows of a document go with its texts that have words
        of_doc = materialize(rows.filter(F.col("doc") != NO_ID).groupBy("doc").agg(F.min("comp").alias("least")))
        rows = rows.join(small_or_shuffled(of_doc, 24), "doc", "left").withColumn("comp", F.coalesce("least", "comp"))
    return rows.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
                       F.nullif("comp", F.lit(NO_ID)).alias("component_id"), (F.col("doc") == F.col("comp")).alias("kept"))


def same_document(all_docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v) between the sets of one document, each with the document's first; rows without an id have none."""
    own = materialize(all_docs.filter(f"set_id is not null and doc <> {NO_ID}").select("doc", "set_id").distinct()
                      .join(nodes.select("set_id", "node"), "set_id").select("doc", "node"))
    least = materialize(own.groupBy("doc").agg(F.min("node").alias("v"), F.max("node").alias("last")).filter("v <> last"))
    return materialize(own.join(small_or_shuffled(least, 32), "doc").filter("node <> v").select(F.col("node").alias("u"), "v"))


def shared_sizes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, shared): shingles that another of these nodes has too, of nodes where that is enough for a link."""
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node, packed in zip(pdf["node"], pdf["hashes"], strict=True):
                yield pd.DataFrame({"node": node, "code": np.frombuffer(packed, np.int64)})

    one = sets.mapInPandas(spread, "node long, code long")
    owners = (one.groupBy("code").agg(F.min("node").alias("low"), F.max("node").alias("high"))
              .filter("low <> high").select("code"))
    sizes = sets.select("node", (F.octet_length("hashes") / 8).cast("long").alias("size"))
    return (one.join(owners, "code", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
            .join(sizes, "node").filter(F.col("shared") * 100 >= F.col("size") * percent).select("node", "shared"))
