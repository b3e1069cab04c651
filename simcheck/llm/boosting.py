"""Boosted trees on a bounded sample, and their use on arrays inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tree:
    """Nodes in parent-first order: feature (-1 for a leaf), bound, children, value."""
    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            go_left = x[rows, self.feature[at]] <= self.bound[at]
            at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
        return self.value[at]


@dataclass(frozen=True)
class BoostedTrees:
    trees: tuple[Tree, ...]
    weights: tuple[float, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = sum((w * t.predict(x) for t, w in zip(self.trees, self.weights, strict=True)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-2 * margin))


def _tree(root) -> Tree:
    rows: list[list] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, float(node.prediction())])
        if node.numDescendants():
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2] = add(node.leftChild())
            rows[at][3] = add(node.rightChild())
        return at

    add(root)
    feature, bound, left, right, value = zip(*rows, strict=True)
    return Tree(np.array(feature), np.array(bound), np.array(left), np.array(right), np.array(value))


def fit_boosted(rows: DataFrame, rounds: int, depth: int, seed: int, min_leaf: int = 20) -> BoostedTrees:
    """Trees on rows (label, x); the sample must be bounded by the caller."""
    model = GBTClassifier(labelCol="label", featuresCol="x", maxIter=rounds, maxDepth=depth, seed=seed, minInstancesPerNode=min_leaf,
                          stepSize=0.3).fit(rows)
    return BoostedTrees(tuple(_tree(t._call_java("rootNode")) for t in model.trees), tuple(model.treeWeights))


def isotonic(score: np.ndarray, label: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pooled steps (lowest score, share of label 1) that never fall as the score rises.

    With ``rows``, an entry stands for so many rows and ``label`` is their sum.
    """
    rows = np.ones(len(score)) if rows is None else rows
    order = np.argsort(score, kind="stable")
    steps: list[list[float]] = []          # lowest score, sum of labels, rows
    for s, y, n in zip(score[order].tolist(), label[order].tolist(), rows[order].tolist(), strict=True):
        if steps and steps[-1][0] == s:
            steps[-1][1] += y
            steps[-1][2] += n
        else:
            steps.append([s, y, float(n)])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, y1, n1 = steps.pop()
            steps[-1][1] += y1
            steps[-1][2] += n1
    return np.array([s[0] for s in steps]), np.array([s[1] / s[2] for s in steps])
