"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics: shares of kinds of characters, repeats of words and lines and
   lengths are computed for every whole text, by Arrow batches.
2. Rules: a random forest of shallow trees is grown on labelled statistics;
   every path from a root to a node below it is a rule, a conjunction of
   comparisons.
3. Weights: a lasso logistic regression over the rules keeps few of them.
4. The kept rules and weights become one Spark column expression, so scoring
   is a projection.

Trees and weights are fitted on at most ``max_rows`` labelled rows (those with
the smallest hash of their id), a bounded sample whose ids are broadcast; the
documents' other rows are only scored.  Rows with crc32(doc_id) mod 5 = 0 are
held out.  Labels, language, source and id are never inputs of a score.

Defined results: a null or empty text has statistics of 0 and gets the score
of those; without labels of both kinds the score is the share of label 1
among the labels (1 without any); rows that repeat a doc_id are scored each;
a null doc_id is scored and not held out; labels that are null or belong to no
document are ignored; an empty table gives no rows; columns beside doc_id and
text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simcheck.llm.textwords import chunks, per_text, words_of
from simcheck.session import materialize

MAX_ROWS = 20_000
TREES, DEPTH, SEED = 24, 3, 7
LASSO = 0.002
THRESHOLD = 0.3

STATS = ("bytes", "words", "lines", "word_bytes", "line_bytes", "upper", "digit", "space", "bang", "bar", "stop",
         "sign", "other_mark", "high", "distinct_words", "same_as_before", "top_word", "long_words", "caps_words",
         "marked_words", "distinct_lines")

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "bang": b"!?",
          "bar": b"|", "stop": b".,;:", "sign": b"#$%&*@~^=+<>", "other_mark": b"\"'()[]{}-_/\\`",
          "high": bytes(range(128, 256))}


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The statistics of some texts, each an array of their length."""
    w = words_of(texts)
    n = len(texts)
    size = (np.diff(w.at) - 1).astype(float)
    first, words = per_text(w)
    count = words.astype(float)
    out = {"bytes": size, "words": count}

    def over_bytes(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag.astype(np.int64), w.at[:-1])

    def over_words(flag: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, weights=flag, minlength=n)

    for kind, members in _KINDS.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        out[kind] = _share(over_bytes(table[w.raw]), size)
    length = (w.end - w.start).astype(float)
    out["word_bytes"] = _share(over_words(length), count)
    out["long_words"] = _share(over_words(length > 24), count)
    order = np.lexsort((w.code, w.doc))
    doc, code = w.doc[order], w.code[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    out["distinct_words"] = _share(np.bincount(doc, weights=new, minlength=n), count)
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, doc[at], np.diff(np.append(at, len(doc))))
    out["top_word"] = _share(most, count)
    same = np.zeros(len(w.doc), bool)
    same[1:] = (w.doc[1:] == w.doc[:-1]) & (w.code[1:] == w.code[:-1])
    out["same_as_before"] = _share(over_words(same), count)
    capital = (w.raw >= 65) & (w.raw <= 90)
    letters = np.concatenate(([0], np.cumsum(capital)))
    out["caps_words"] = _share(over_words((letters[w.end] - letters[w.start]) >= 2), count)
    marks = np.zeros(256, bool)
    marks[[*_KINDS["bang"], *_KINDS["bar"], *_KINDS["sign"]]] = True
    out["marked_words"] = _share(over_words(marks[w.raw[w.end - 1]] if len(w.end) else np.zeros(0)), count)
    lines = [t.split(b"\n") for t in texts]
    out["lines"] = np.array([len(x) for x in lines], float)
    out["line_bytes"] = _share(size, out["lines"])
    out["distinct_lines"] = np.array([len(set(x)) for x in lines], float) / out["lines"]
    return out


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def text_statistics(text: pd.Series) -> pd.DataFrame:
    raw = [t.encode() for t in text.fillna("")]
    parts = [pd.DataFrame(statistics(raw[s])) for s in chunks(raw)]
    if not parts:
        return pd.DataFrame({s: np.zeros(0) for s in STATS})
    return pd.concat(parts, ignore_index=True)[list(STATS)]


Term = tuple[str, bool, float]      # statistic, whether at most, threshold


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[frozenset[Term], float], ...]
    intercept: float

    def score(self, stats: str = "stats") -> Column:
        """The probability of label 1 as a column over a struct of statistics."""
        total = F.lit(self.intercept)
        for terms, weight in self.rules:
            total = total + F.when(conjunction(terms, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def conjunction(terms: frozenset[Term], stats: str) -> Column:
    out = None
    for name, at_most, bound in sorted(terms):
        c = F.col(f"{stats}.{name}")
        term = c <= F.lit(bound) if at_most else c > F.lit(bound)
        out = term if out is None else out & term
    return out


def tree_paths(node, path: tuple[Term, ...] = ()) -> list[frozenset[Term]]:
    """Conjunctions of all nodes below a root; repeated bounds of a statistic are merged."""
    found = [_merged(path)] if path else []
    if node.numDescendants() == 0:
        return found
    split = node.split()
    name, bound = STATS[split.featureIndex()], split.threshold()
    return (found + tree_paths(node.leftChild(), (*path, (name, True, bound)))
            + tree_paths(node.rightChild(), (*path, (name, False, bound))))


def _merged(path: tuple[Term, ...]) -> frozenset[Term]:
    best: dict[tuple[str, bool], float] = {}
    for name, at_most, bound in path:
        old = best.get((name, at_most))
        best[name, at_most] = bound if old is None else (min if at_most else max)(old, bound)
    return frozenset((n, a, b) for (n, a), b in best.items())


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(label, statistics) of a bounded sample of the labelled documents that are not held out."""
    sample = (labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out())
              .groupBy("doc_id").agg(F.max("quality").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    return (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .select("doc_id", F.col("label").cast("double"), text_statistics("text").alias("stats"))
            .select("doc_id", "label", "stats.*"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, trees: int = TREES, depth: int = DEPTH,
        lasso: float = LASSO, seed: int = SEED) -> RuleModel:
    # one partition in a fixed order: the same sample gives the same trees wherever its rows came from
    rows = materialize(training_rows(docs, labels, max_rows))
    rows = materialize(rows.coalesce(1).sortWithinPartitions("doc_id", *STATS)).coalesce(1)
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        share = min(max((ones or 0) / n if n else 1.0, 1e-6), 1 - 1e-6)
        return RuleModel((), float(np.log(share / (1 - share))))
    ready = materialize(VectorAssembler(inputCols=list(STATS), outputCol="x").transform(rows)
                        .select("label", "x", *STATS)).coalesce(1)
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=trees, maxDepth=depth, seed=seed,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(ready)
    paths = sorted({p for t in forest.trees for p in tree_paths(t._call_java("rootNode"))}, key=sorted)
    flagged = ready.withColumn("stats", F.struct(*STATS)).select(
        "label", *[conjunction(p, "stats").cast("double").alias(f"r{i}") for i, p in enumerate(paths)])
    flagged = VectorAssembler(inputCols=[f"r{i}" for i in range(len(paths))], outputCol="x").transform(flagged)
    fitted = LogisticRegression(labelCol="label", featuresCol="x", elasticNetParam=1.0, regParam=lasso,
                                maxIter=100).fit(materialize(flagged.select("label", "x")).coalesce(1))
    weights = fitted.coefficients.toArray()
    return RuleModel(tuple((p, float(w)) for p, w in zip(paths, weights, strict=True) if w), float(fitted.intercept))


def classify(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1, higher for label 1) and predicted (1 from ``threshold`` on)."""
    return (docs.withColumn("__stats", text_statistics("text"))
            .withColumn("score", model.score("__stats")).drop("__stats")
            .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)))


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, unchanged."""
    return (docs.withColumn("__stats", text_statistics("text"))
            .filter(model.score("__stats") >= threshold).drop("__stats"))
