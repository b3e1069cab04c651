"""Exact top-k inner products by a Voronoi join.

Vectors are turned into integers, floor(256 * x) per component.  Pivots (a
bounded sample) split queries and data into cells.  Two summaries of a bounded
size are collected: of each query cell its radius, of each data cell its
largest radius and norm and the k members nearest to its pivot.  From them
follow, for a group of queries around pivot p with radius r,

* a floor: the k-th best score that each of its queries is sure to reach, as
  q.v >= p.v - r * |v| for every summarised member v;
* per data vector a ceiling: q.v <= p.v + r * |v|.

A vector is sent to a group only if its ceiling reaches the floor.  Data goes
in packed blocks, a group's queries in packed blocks too; each pair of blocks
is solved on its own and yields at most k rows a query, and the best k of
those are kept.  Nothing depends on how full a cell is: a hot cell or one very
common vector only makes more blocks.

The queries are a stated set (ids divisible by 50); it is spread like any
table and never collected.  Scores are exact: by the measured size of the
components, products are taken in float64 while all sums stay below 2^53, in
64-bit integers while they stay below 2^63, else in Python's integers.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part (nor does one that becomes infinite when scaled); a
vector shorter than another counts as ending in zeros; a null id takes no part;
rows that repeat an id are candidates each, but not for a query of their own
id; different vectors of one query id are asked each, equal ones once; fewer
than k candidates give fewer rows; a score beyond a long is returned as the
nearest long, ranked by its true value; columns beside vec_id and embedding are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simcheck.session import materialize

K, STEP = 5, 50
SCALE = 256
PIVOTS, GROUPS = 64, 16
DATA_BLOCK, QUERY_BLOCK = 4096, 512
#: Blocks of data that meet a group's queries under one join key, about.
BLOCKS_PER_KEY = 16
#: From here on every double is a whole number.
WHOLE = float(1 << 53)
LONG = (1 << 63) - 1


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): components of the vectors that take part, whole numbers as doubles."""
    x = F.transform("embedding", lambda c: c.cast("double") * SCALE)
    fine = (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.when(F.abs(c) < WHOLE, F.floor(c).cast("double")).otherwise(c))
    return embeddings.filter("vec_id is not null").filter(F.coalesce(fine, F.lit(False))) \
        .select("vec_id", whole.alias("v"))


def _matrix(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _cells(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row, and the distance to it."""
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)[None, :]
    cell = d.argmin(axis=1)
    return cell, np.linalg.norm(x - pivots[cell], axis=1)


def summaries(vectors: DataFrame, sent, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k members of every cell nearest to its pivot, with their ids, one member an id.

    An id on several rows counts once, over all cells too: all its rows fall
    away together when a query of that id is asked.  Batches keep k a cell before anything is shuffled, so at most pivots * k
    rows of each task meet in the window and pivots * k rows reach the driver.
    """
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["v"], dim)
            cell, far = _cells(x, sent.value)
            part = pd.DataFrame({"cell": cell, "far": far, "vec_id": pdf["vec_id"], "v": pdf["v"]})
            part = part.sort_values(["cell", "far", "vec_id"]).drop_duplicates(["cell", "vec_id"])
            yield part.groupby("cell").head(k)

    rows = (vectors.mapInPandas(near, "cell int, far double, vec_id long, v array<double>")
            .groupBy("cell", "vec_id").agg(F.min(F.struct("far", "v")).alias("best"))
            .select("cell", "best.far", "vec_id", "best.v"))
    nearest = F.row_number().over(Window.partitionBy("cell").orderBy("far", "vec_id"))
    kept = rows.withColumn("rank", nearest).filter(F.col("rank") <= k).select("vec_id", "v").collect()
    kept = list({r["vec_id"]: r for r in kept}.values())
    return np.array([r["vec_id"] for r in kept], np.int64), _matrix([r["v"] for r in kept], dim)


def query_radii(queries: DataFrame, sent, dim: int, n_groups: int) -> np.ndarray:
    """The radius of every query group around its pivot."""
    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, d = _cells(_matrix(pdf["v"], dim), sent.value)
            yield pd.DataFrame({"cell": cell, "far": d}).groupby("cell", as_index=False).max()

    radius = np.full(n_groups, -1.0)
    for r in queries.mapInPandas(far, "cell int, far double").groupBy("cell").agg(F.max("far").alias("far")).collect():
        radius[r["cell"]] = r["far"]
    return radius


def floors(pivots: np.ndarray, radius: np.ndarray, members: np.ndarray, k: int) -> np.ndarray:
    """The score that the k-th best of every query of a group reaches at least.

    The members' ids differ; one more is asked for, as a query is no candidate of its own.
    """
    least = pivots @ members.T - radius[:, None] * np.linalg.norm(members, axis=1)[None, :]
    if members.shape[0] <= k:
        return np.full(len(pivots), -np.inf)
    return np.sort(least, axis=1)[:, -(k + 1)] - 1e-6 * (1 + np.abs(least).max())


def packed(vectors: DataFrame, choose, dim: int, block: int, names: tuple[str, str], kind: str) -> DataFrame:
    """(grp, ids, values, marks): blocks of vectors; ``choose`` yields (group, rows) of a batch."""
    ids, values = names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["v"], dim)
            own, mark = pdf["vec_id"].to_numpy(np.int64), pdf["mark"].to_numpy(np.int64)
            out = []
            for group, at in choose(x):
                at = at[np.argsort(own[at], kind="stable")]
                for s in range(0, len(at), block):
                    part = at[s:s + block]
                    out.append((group, own[part].tobytes(), x[part].astype(kind).tobytes(), mark[part].tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["grp", ids, values, "marks"])

    return vectors.mapInPandas(run, f"grp int, {ids} binary, {values} binary, marks binary")


def best_of(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best scores of each row; ids ascend, so ties go to the smaller."""
    left, right = [], []
    for r in range(len(scores)):
        s = scores[r]
        ok = np.flatnonzero(ids != own[r])
        if len(ok) > k:
            kth = (np.sort(s[ok]) if s.dtype == object else np.partition(s[ok], len(ok) - k))[len(ok) - k]
            above, equal = ok[s[ok] > kth], ok[s[ok] == kth]
            ok = np.concatenate((above, equal[:k - len(above)]))
        left.append(np.full(len(ok), r))
        right.append(ok)
    return np.concatenate(left), np.concatenate(right)


def top_k(embeddings: DataFrame, k: int = K, step: int = STEP, n_pivots: int = PIVOTS,
          n_groups: int = GROUPS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query."""
    spark = embeddings.sparkSession
    vectors = materialize(whole_vectors(embeddings))
    queries = vectors.filter(F.col("vec_id") % step == 0).distinct()
    n, dim, size = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate(
        "v", F.lit(0.0), lambda m, c: F.greatest(m, F.abs(c))))).first()
    schema = "query_id long, mark long, vec_id long, score long, place string"
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = dim * int(size) ** 2                              # no score is larger in size
    kind = "<i4" if size < 1 << 31 else "<f8"

    def sample(rows: DataFrame, n: int) -> np.ndarray:
        drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n).collect()      # n vectors at most
        return np.unique(_matrix([r["v"] for r in drawn], dim), axis=0) if drawn else np.zeros((0, dim))

    pivots, centres = sample(vectors, n_pivots), sample(queries, n_groups)
    if not len(centres):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sc = spark.sparkContext
    sent_pivots, sent_centres = sc.broadcast(pivots), sc.broadcast(centres)
    _, members = summaries(vectors, sent_pivots, dim, k + 1)
    radius = query_radii(queries, sent_centres, dim, len(centres))
    if most < 10 ** 300:
        low = floors(centres, np.maximum(radius, 0), members, k)
    else:                                                    # bounds would overflow: nothing is pruned
        radius, low = np.where(radius < 0, -1.0, 0.0), np.full(len(centres), -np.inf)

    def to_groups(x: np.ndarray):
        """Groups that a vector can reach the floor of."""
        ceiling = x @ centres.T + np.linalg.norm(x, axis=1)[:, None] * radius[None, :]
        for g in np.flatnonzero(radius >= 0):
            at = np.flatnonzero(~(ceiling[:, g] + 1e-6 * (1 + np.abs(ceiling[:, g])) < low[g]))
            if len(at):
                yield int(g), at

    def own_group(x: np.ndarray):
        cell, _ = _cells(x, sent_centres.value)
        for g in np.unique(cell):
            yield int(g), np.flatnonzero(cell == g)

    # a group's blocks of data are dealt over several keys, each of which gets the group's queries
    deals = max(1, n // (DATA_BLOCK * BLOCKS_PER_KEY))
    data = packed(vectors.withColumn("mark", F.lit(0).cast("long")), to_groups, dim, DATA_BLOCK, ("ids", "vs"), kind) \
        .drop("marks").withColumn("deal", F.pmod(F.xxhash64("ids"), F.lit(deals)))
    asked = packed(queries.withColumn("mark", F.xxhash64("v")), own_group, dim, QUERY_BLOCK, ("q_ids", "qs"), kind) \
        .withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))

    def numbers(raw: bytes, rows: int) -> np.ndarray:
        x = np.frombuffer(raw, kind).reshape(rows, dim)
        if most < 1 << 53:
            return x.astype(np.float64)
        return x.astype(np.int64) if most < LONG else np.vectorize(int, otypes=[object])(x)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = len(str(2 * most))
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, q_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                scores = numbers(r.qs, len(q_ids)) @ numbers(r.vs, len(ids)).T
                row, col = best_of(scores, q_ids, ids, k)
                best, place = scores[row, col], [None] * len(row)
                if most >= LONG:                             # the true order, as text of one width
                    place = [str(s + most).zfill(width) for s in best]
                    best = [min(max(s, -LONG - 1), LONG) for s in best]
                yield pd.DataFrame({"query_id": q_ids[row], "mark": np.frombuffer(r.marks, np.int64)[row],
                                    "vec_id": ids[col], "score": np.asarray(best, np.int64), "place": pd.Series(place, dtype=object)})

    found = data.join(asked, ["grp", "deal"]).select("ids", "vs", "q_ids", "qs", "marks").mapInPandas(solve, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(
        F.col("place").desc(), F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
