"""Whitening of embeddings by their principal components.

Vectors become whole numbers, equal ones are grouped, and the fit runs over the
distinct ones, each with weight one or with its number of copies.  Sums per
dimension are exact whole numbers; the covariance is a weighted GEMM of centred
rows, done per partition in doubles and added up in Spark, so what reaches the
driver is ``dim`` sums and ``dim * dim`` products, whatever the number of rows.
The eigenvectors come from the driver.  Every distinct vector is whitened once
and the rows take its result through a join on the vector's digest; a vector
with very many copies is dealt over several keys there.

Defined results: a null vector, one with a null, NaN or infinite entry, one
whose entries do not fit a long, and an empty one take no part; if lengths
differ, the length that most rows have counts (of equals the longest) and the
others take no part.  A component without variance has no direction: its
``whitened`` is null.  ``deviation`` is null where the exact sum does not fit a
long; ``deviation_exact`` has it as decimal.  Rows with one id are rows of
their own, a null id stays null, an empty table gives no rows, other columns
are ignored.  ``dim`` bounds the driver's matrix: 4096 dimensions take 128 MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simcheck.llm.common import BROADCAST_BYTES
from simcheck.session import materialize

N_COMPONENTS = 4
SCALE = 256
#: Entries beyond this do not fit a long after scaling.
ENTRY_BOUND = float(1 << 54)
#: A vector with more than this share of all rows, or this many rows if that is more, is dealt over several join keys.
HOT_SHARE, HOT_ROWS = 1000, 1000
LONG = 1 << 63
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double, deviation_exact decimal(38,0)")


class Fit(NamedTuple):
    n: int                    # weight of the fit list
    sums: list[int]           # per dimension, exact
    values: np.ndarray        # eigenvalues, falling; those without variance are nan
    vectors: np.ndarray       # dim x components
    trace: float


def whole(embedding: Column) -> Column:
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE))


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, x, key) of the rows that take part: whole-number vectors and their digest."""
    fits = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < ENTRY_BOUND, F.lit(False)))
    rows = df.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fits)
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    dim = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    x = rows.filter(F.size("embedding") == (dim["dim"] if dim else 0)).select("vec_id", whole(F.col("embedding")).alias("x"))
    return x.withColumn("key", F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256)))


def distinct_vectors(rows: DataFrame, weights: str = "one") -> DataFrame:
    """Each vector once: (key, x, copies, weight)."""
    weight = F.lit(1).cast("long") if weights == "one" else F.col("copies")
    return materialize(rows.groupBy("key", "x").agg(F.count(F.lit(1)).alias("copies")).withColumn("weight", weight))


def _matrix(batch: pd.Series) -> np.ndarray:
    return np.stack(batch.to_numpy()).astype(np.int64)


def exact_sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """Weight of the list and its weighted sums per dimension, as whole numbers."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for b in batches:
            if not len(b):
                continue
            x, w = _matrix(b["x"]), b["weight"].to_numpy(np.int64)
            if float(np.abs(x).max()) * float(w.sum()) < 2 ** 62:
                part = (x * w[:, None]).sum(0).astype(object)
            else:
                part = (x.astype(object) * w.astype(object)[:, None]).sum(0)
            n, total = n + int(w.sum()), part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"dim": np.arange(len(total)), "n": [Decimal(n)] * len(total),
                                "total": [Decimal(int(t)) for t in total]})
    parts = distinct.select("x", "weight").mapInPandas(partial, "dim int, n decimal(38,0), total decimal(38,0)")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    sums = {r["dim"]: int(r["total"]) for r in rows}
    return (int(rows[0]["n"]) if rows else 0), [sums[d] for d in range(len(sums))]


def covariance(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Weighted covariance, divisor ``n``, of rows centred before they are multiplied."""
    mean = np.array([s / n for s in sums])

    def gemm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                c = _matrix(b["x"]) - mean
                part = (c * b["weight"].to_numpy(np.float64)[:, None]).T @ c
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "products": list(total)})
    parts = distinct.select("x", "weight").mapInPandas(gemm, "i int, products array<double>")
    cells = (parts.select("i", F.posexplode("products").alias("j", "v")).groupBy("i", "j")
             .agg(F.sum("v").alias("v")).collect())
    out = np.zeros((len(sums), len(sums)))
    for r in cells:
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / (2 * n)


def fit(distinct: DataFrame, components: int = N_COMPONENTS) -> Fit | None:
    n, sums = exact_sums(distinct)
    if not n:
        return None
    v = covariance(distinct, n, sums)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    flat = values <= len(sums) * np.finfo(float).eps * max(values[0], 0.0)
    return Fit(n, sums, np.where(flat, np.nan, values)[:components], axes[:, :components], float(np.trace(v)))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2, exact."""
    most = n * int(np.abs(x).max()) + max(map(abs, sums))
    if len(sums) * most * most < LONG:
        return (((n * x - np.array(sums, np.int64)) ** 2).sum(1)).tolist()
    return [int(t) for t in ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)]


def whiten(distinct: DataFrame, model: Fit) -> DataFrame:
    """(key, copies, weight, deviation, deviation_exact, w) for each distinct vector; written once."""
    mean = np.array([s / model.n for s in model.sums])
    turn = model.vectors / np.sqrt(model.values)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["x"])
                exact = _deviations(x, model.n, model.sums)
                yield pd.DataFrame({
                    "key": b["key"], "copies": b["copies"], "weight": b["weight"],
                    "deviation": pd.array([d if d < LONG else None for d in exact], "Int64"),
                    "deviation_exact": [Decimal(d) if d < 10 ** 38 else None for d in exact],
                    "w": list((x - mean) @ turn)})
    made = materialize(distinct.mapInPandas(
        project, "key binary, copies long, weight long, deviation long, deviation_exact decimal(38,0), w array<double>"))
    return made.withColumn("w", F.transform("w", lambda c: F.when(~F.isnan(c), c)))


def identity_error(whitened: DataFrame, model: Fit) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    kept = [i for i, v in enumerate(model.values) if not np.isnan(v)]
    if not kept:
        return None
    w, c = F.col("weight"), {i: F.col("w")[i] for i in kept}
    means = [F.sum(w * c[i]).alias(f"m{i}") for i in kept]
    products = [F.sum(w * c[i] * c[j]).alias(f"p{i}_{j}") for i in kept for j in kept if i <= j]
    r = whitened.agg(*means, *products).first()
    return max(abs(r[f"p{i}_{j}"] / model.n - r[f"m{i}"] / model.n * (r[f"m{j}"] / model.n) - (i == j))
               for i in kept for j in kept if i <= j)


def join_back(rows: DataFrame, whitened: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows with their vector's result; ``whitened`` is broadcast up to ``limit`` bytes, else shuffled.

    In the shuffle a vector with many copies is dealt over as many keys as it
    has shares of ``1 / HOT_SHARE`` of all rows; at most HOT_SHARE vectors are
    that frequent, so their list is small.
    """
    width = F.size("w") * 8 + 72
    size, total = whitened.agg(F.sum(width.cast("long")), F.sum("copies")).first()
    if (size or 0) <= limit:
        return rows.join(F.broadcast(whitened), "key")
    share = max(HOT_ROWS, total // HOT_SHARE)
    salts = F.when(F.col("copies") > share, F.ceil(F.col("copies") / share)).otherwise(1).cast("int")
    dealt = whitened.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    hot = whitened.filter(F.col("copies") > share).select("key", salts.alias("salts"))
    salted = rows.join(F.broadcast(hot), "key", "left").withColumn(
        "salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int"))
    return salted.join(dealt, ["key", "salt"])


def whitened_rows(df: DataFrame, components: int = N_COMPONENTS, weights: str = "one",
                  limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per remaining row of ``df`` and component, with the fit's figures."""
    rows = vectors(df)
    distinct = distinct_vectors(rows, weights)
    model = fit(distinct, components)
    if model is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    whitened = whiten(distinct, model)
    error = identity_error(whitened, model)
    explained = [float(v / model.trace) if model.trace > 0 and not np.isnan(v) else None for v in model.values]
    share = F.array(*[F.lit(e).cast("double") for e in explained])
    back = join_back(rows.select("vec_id", "key"), whitened, limit)
    each = back.select("vec_id", "deviation", "deviation_exact", F.posexplode("w").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).cast("int").alias("component"),
                       F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       share[F.col("place")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
                       "deviation_exact")
