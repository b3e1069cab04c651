"""Exact cosine similarity operators without cross joins.

A cosine predicate has no equi-key, so Catalyst would plan it as a
BroadcastNestedLoopJoin or a CartesianProduct.  These operators supply the
physical strategy themselves:

* **top-k kernel** — the query side is collected only after its size is
  checked against ``BROADCAST_GUARD_BYTES``; every corpus partition scores its
  Arrow batches against that matrix with NumPy, keeps a running top-k and
  emits it once, so at most k rows per query and partition are shuffled.  A
  larger query side is cut into parts that each fit the guard, and the corpus
  is scanned once per part; the corpus is never copied or shuffled.
* **sentences as corpus** — with ``c_text`` the corpus is a text column.  A task
  encodes its batches itself, so no vector is written, read or sent between
  JVM and Python, and a float32 product leaves out sentences that are below the
  threshold for every query by more than its error; the rest is scored as above.
* **pairs** — the prefix-filter join of ``prefix_join``.

Scores are cosines computed in float64 and rounded to 6 decimals before they
are ranked or compared with a threshold, so ties (exact copies) are broken by
the keys, deterministically, in every engine.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simcheck import params as P
from simcheck.functions import vectors as V
from simcheck.operators import prefix_join as J
from simcheck.session import materialize

SCORE_DECIMALS = 6
# largest score matrix (entries) a kernel holds at once
MAX_MATRIX_ENTRIES = 8_000_000
# sentences encoded at once, and how far a float32 product of unit vectors may be off, with room to spare
ENCODE_ROWS = 4096
SCREEN_SLACK = 1e-3


def _matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0), dtype=np.float64)
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def _cos(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na = np.sqrt(np.einsum("ij,ij->i", a, a))
    nb = np.sqrt(np.einsum("ij,ij->i", b, b))
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (a @ b.T) / (na[:, None] * nb[None, :])
    s = np.nan_to_num(s, nan=0.0)
    return np.round(s, SCORE_DECIMALS)


def _corpus_side(corpus: DataFrame, columns: list[str], vec: str, text: str | None, threshold: float | None) -> DataFrame:
    """``columns`` with the vector, or with the lower-case sentence that tasks encode."""
    if text is None:
        return corpus.select(*columns, F.col(vec).alias("__vec"))
    if threshold is None:
        raise ValueError("a corpus of sentences is screened by a threshold")
    return corpus.select(*columns, F.lower(text).cast("binary").alias("__text"))


def _encoded(batches: Iterator[pd.DataFrame], qmat: np.ndarray, threshold: float | None) -> Iterator[pd.DataFrame]:
    """Batches with a vector a row; of sentences, those that can reach the threshold for some query."""
    known: dict[bytes, int] = {}
    unit = None
    for pdf in batches:
        if "__text" not in pdf:
            yield pdf
            continue
        if unit is None:
            unit = (qmat / np.sqrt(np.einsum("ij,ij->i", qmat, qmat))[:, None]).astype(np.float32)
        step = max(1, min(ENCODE_ROWS, MAX_MATRIX_ENTRIES // len(unit)))
        for s in range(0, len(pdf), step):
            part = pdf.iloc[s:s + step]
            vecs = V.hashed_matrix(part["__text"], known)
            near = np.flatnonzero((unit @ vecs.T).max(axis=0) >= threshold - SCREEN_SLACK)
            if len(near):
                yield part.iloc[near].drop(columns="__text").assign(__vec=list(vecs[near]))


def _side_bytes(df: DataFrame, vec: str) -> tuple[int, int]:
    """Rows, and bytes a side takes on the driver: pandas objects and a float64 matrix."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(vec)), F.lit(0)).alias("d")).first()
    return int(stats["n"]), int(stats["d"]) * 16 + int(stats["n"]) * 256


def _by_parts(q: DataFrame, keys: list[str], guard_bytes: int, parts: int | None, scan) -> DataFrame:
    """``scan`` of the query side in pandas frames that each fit the guard.

    ``scan`` returns rows and the broadcast they need.  With several parts each
    one's rows are written and its broadcast is dropped before the next part is
    collected, so neither driver nor workers hold more than one part.
    """
    if parts is None:
        parts = max(1, math.ceil(_side_bytes(q, "__vec")[1] / max(1, guard_bytes)))
    if parts == 1:
        return scan(q.toPandas().reset_index(drop=True))[0]
    found = []
    for i in range(parts):
        rows, sent = scan(q.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == i).toPandas().reset_index(drop=True))
        found.append(materialize(rows))
        sent.destroy()
    return reduce(DataFrame.unionByName, found)


def _final_top_k(partial: DataFrame, q_keys: list[str], c_keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*q_keys).orderBy(F.col("score").desc(), *[F.col(c).asc() for c in c_keys])
    return (partial.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def _top_k_rows(qmat: np.ndarray, rows: np.ndarray, cpdf: pd.DataFrame, c_keys: list[str], k: int,
                threshold: float | None) -> pd.DataFrame:
    """Top-k of the queries ``rows`` against one corpus chunk (sorted by c_keys): (__q, c_keys, score)."""
    scores = _cos(qmat[rows], _matrix(cpdf["__vec"]))
    if threshold is not None:
        scores = np.where(scores >= threshold, scores, -np.inf)
    kk = min(k, scores.shape[1])
    # stable order: by score desc, then by position (= key order, rows are sorted)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :kk]
    top = np.take_along_axis(scores, order, axis=1)
    qi, pos = np.nonzero(np.isfinite(top))
    res = {"__q": rows[qi]}
    res |= {c: cpdf[c].to_numpy()[order[qi, pos]] for c in c_keys}
    return pd.DataFrame(res | {"score": top[qi, pos]})


def _keep_top(found: pd.DataFrame, c_keys: list[str], k: int) -> pd.DataFrame:
    ranked = found.sort_values(["__q", "score", *c_keys], ascending=[True, False, *[True] * len(c_keys)], kind="stable")
    return ranked.groupby("__q", sort=False).head(k)


def nearest(queries: DataFrame, corpus: DataFrame, q_keys: list[str], c_keys: list[str],
            k: int = 1, threshold: float | None = None, q_vec: str = "vec",
            c_vec: str = "vec", q_filter: str | None = None, c_filter: str | None = None,
            guard_bytes: int = P.BROADCAST_GUARD_BYTES, parts: int | None = None,
            c_text: str | None = None) -> DataFrame:
    """Exact cosine top-k of every query row against the corpus.

    Returns ``q_keys + c_keys + [score, rank]``; rows below ``threshold`` are
    dropped before ranking.  ``q_filter``/``c_filter`` restrict each query to
    corpus rows with an equal filter value (the pre-filter of J2): rows are
    grouped by that value first and only equal groups are scored.
    Ties: score desc, then ``c_keys`` ascending.  ``parts`` overrides the
    number of query parts.  ``c_text`` names a column of sentences that the
    tasks encode (default encoder), in place of ``c_vec``.
    """
    q = queries.select(*q_keys, *( [q_filter] if q_filter else []), F.col(q_vec).alias("__vec"))
    c = _corpus_side(corpus, [*c_keys, *([c_filter] if c_filter else [])], c_vec, c_text, threshold)
    schema = T.StructType(
        [queries.schema[x] for x in q_keys] + [corpus.schema[x] for x in c_keys]
        + [T.StructField("score", T.DoubleType())])
    found = _by_parts(q, q_keys, guard_bytes, parts, lambda qpdf: _scan_top_k(
        qpdf, c, q_keys, c_keys, k, threshold, q_filter, c_filter, schema))
    return _final_top_k(found, q_keys, c_keys, k)


def _scan_top_k(qpdf, c, q_keys, c_keys, k, threshold, q_filter, c_filter, schema):
    """One scan of the corpus against a collected query part."""
    bq = c.sparkSession.sparkContext.broadcast((qpdf.drop(columns=["__vec"]), _matrix(qpdf["__vec"])))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qmeta, qmat = bq.value
        everyone = np.arange(len(qmeta))
        rows_of = {} if q_filter is None else {v: np.asarray(r) for v, r in qmeta.groupby(q_filter).indices.items()}
        best = None
        for pdf in _encoded(batches, qmat, threshold) if len(qmeta) else ():
            groups = [(everyone, pdf)] if q_filter is None else [
                (rows_of[v], g) for v, g in pdf.groupby(c_filter) if v in rows_of]
            for rows, group in groups:
                group = group.sort_values(list(c_keys), kind="stable")
                chunk = max(1, MAX_MATRIX_ENTRIES // len(rows))
                for s in range(0, len(group), chunk):
                    res = _top_k_rows(qmat, rows, group.iloc[s:s + chunk], c_keys, k, threshold)
                    if len(res):
                        best = _keep_top(res if best is None else pd.concat([best, res], ignore_index=True), c_keys, k)
        if best is not None:
            at = best.pop("__q").to_numpy()
            for key in q_keys:
                best[key] = qmeta[key].to_numpy()[at]
            yield best[schema.fieldNames()]

    return c.mapInPandas(kernel, schema), bq


def similar_pairs(sentences: DataFrame, doc_col: str, idx_col: str, threshold: float, vec: str = "vec",
                  strict: bool = False) -> DataFrame:
    """All sentence pairs of *different* documents with cosine >= threshold.

    Output ``doc_a, idx_a, doc_b, idx_b, score`` with ``doc_a < doc_b``, found by
    the prefix-filter join; ``strict`` keeps ``score > threshold`` instead of ``>=``.
    """
    found = J.vector_classes(sentences, [doc_col, idx_col], vec)
    return J.expand(J.class_links(found, threshold, strict), found, own_links=threshold < 1 or not strict)


def pair_matches(sentences: DataFrame, doc_col: str, idx_col: str, threshold: float, vec: str = "vec",
                 strict: bool = False) -> DataFrame:
    """(doc1, doc2, matches), doc1 < doc2: sentences of doc2 with a match in doc1."""
    found = J.vector_classes(sentences, [doc_col, idx_col], vec)
    links = J.class_links(found, threshold, strict, scores=False)
    return J.document_matches(links, found, own_links=threshold < 1 or not strict)


def best_per_group(queries: DataFrame, corpus: DataFrame, q_keys: list[str], group_col: str,
                   order_col: str, threshold: float, vec: str = "vec",
                   guard_bytes: int = P.BROADCAST_GUARD_BYTES, parts: int | None = None,
                   c_text: str | None = None) -> DataFrame:
    """Per (query row, corpus group): best score >= threshold and its first arg-max.

    J10/A11: the column max over one document's sentences and the lowest
    ``order_col`` reaching it.  The corpus is scanned once per query part that
    fits the guard; each batch reduces its own candidates, then a group-by
    with a partial ``max(struct)`` merges them.  ``c_text`` names a column of
    sentences that the tasks encode, in place of the corpus vectors.
    Returns ``q_keys + [group_col, score, arg]``.
    """
    q = queries.select(*q_keys, F.col(vec).alias("__vec"))
    c = _corpus_side(corpus, [group_col, order_col], vec, c_text, threshold)
    schema = T.StructType([queries.schema[x] for x in q_keys] + [
        corpus.schema[group_col],
        T.StructField("score", T.DoubleType()),
        T.StructField("arg", corpus.schema[order_col].dataType)])
    cols = schema.fieldNames()

    def reduce_chunk(qmeta, qmat, part):
        sc = _cos(qmat, _matrix(part["__vec"]))
        qi, ci = np.nonzero(sc >= threshold)
        if len(qi) == 0:
            return None
        res = {k: qmeta[k].to_numpy()[qi] for k in q_keys}
        res[group_col] = part[group_col].to_numpy()[ci]
        res["score"] = sc[qi, ci]
        res["arg"] = part[order_col].to_numpy()[ci]
        df = pd.DataFrame(res).sort_values(["score", "arg"], ascending=[False, True], kind="stable")
        return df.drop_duplicates([*q_keys, group_col])[cols]

    partial = _by_parts(q, q_keys, guard_bytes, parts, lambda qpdf: _scan_groups(
        qpdf, c, schema, threshold, reduce_chunk))
    best = F.max(F.struct(F.col("score"), (-F.col("arg")).alias("neg"))).alias("b")
    return (partial.groupBy(*q_keys, group_col).agg(best)
            .select(*q_keys, group_col, F.col("b.score").alias("score"),
                    (-F.col("b.neg")).cast(corpus.schema[order_col].dataType).alias("arg")))


def _scan_groups(qpdf, c, schema, threshold, reduce_chunk):
    """One scan of the corpus against a collected query part."""
    bq = c.sparkSession.sparkContext.broadcast((qpdf.drop(columns=["__vec"]), _matrix(qpdf["__vec"])))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qmeta, qmat = bq.value
        chunk = max(1, MAX_MATRIX_ENTRIES // max(1, len(qmeta)))
        for pdf in _encoded(batches, qmat, threshold) if len(qmeta) else ():
            for s0 in range(0, len(pdf), chunk):
                out = reduce_chunk(qmeta, qmat, pdf.iloc[s0:s0 + chunk])
                if out is not None:
                    yield out

    return c.mapInPandas(kernel, schema), bq
