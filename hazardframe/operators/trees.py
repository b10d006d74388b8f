"""Exact additive contributions of boosted trees (M8): path-dependent Shapley values, in log-odds.

A tree's value for a row is shared out over its features by weighting all
orders in which they could become known, where an unknown feature sends a row
down both branches in proportion to the training rows there. The recursion keeps,
along a path, how many subsets of each size flow through it; features that
split twice are taken off and put on again. The sum over features and the
expectation give the model's margin exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Tree:
    """Nodes by number: feature (-1 for a leaf), threshold (x <= threshold goes left), children, value, training rows or their hessians, and whether a missing x goes left (right without that)."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    missing_left: np.ndarray | None = None

    def goes_left(self, node: int, x: float) -> bool:
        if x != x:
            return self.missing_left is not None and bool(self.missing_left[node])
        return x <= self.threshold[node]

    def leaf(self, x: np.ndarray) -> float:
        node = 0
        while self.feature[node] >= 0:
            node = self.left[node] if self.goes_left(node, x[self.feature[node]]) else self.right[node]
        return float(self.value[node])

    def expectation(self) -> float:
        """The mean of the leaves by their training rows."""
        ends = self.feature < 0
        return float((self.value[ends] * self.cover[ends]).sum() / self.cover[ends].sum())


@dataclass
class Forest:
    """Trees with their weights, the factor from their sum to the log-odds, and what these start from."""

    trees: list[Tree]
    weights: list[float]
    scale: float = 2.0
    base: float = 0.0

    def margin(self, x: np.ndarray) -> float:
        return self.base + self.scale * sum(w * t.leaf(x) for t, w in zip(self.trees, self.weights, strict=True))

    def expectation(self) -> float:
        return self.base + self.scale * sum(w * t.expectation() for t, w in zip(self.trees, self.weights, strict=True))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t, w in zip(self.trees, self.weights, strict=True):
            out += w * tree_contributions(t, x)
        return self.scale * out


def forest_of(model: PipelineModel) -> Forest:
    """The trees of a fitted pipeline whose last stage is boosted trees over numeric features."""
    stage = model.stages[-1]
    return Forest([_tree(t._java_obj.rootNode()) for t in stage.trees], list(stage.treeWeights))


def _tree(root) -> Tree:
    rows: list[list] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, -1, -1, node.prediction(), float(node.impurityStats().count())])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][:2] = split.featureIndex(), split.threshold()
            rows[at][2] = walk(node.leftChild())
            rows[at][3] = walk(node.rightChild())
        return at

    walk(root)
    return Tree(*(np.array(c, t) for c, t in zip(zip(*rows, strict=True), (int, float, int, int, float, float), strict=True)))


def tree_contributions(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Shapley values of one tree for one row."""
    out = np.zeros(len(x))

    def descend(node: int, path: list[tuple[int, float, float]], share: np.ndarray) -> None:
        # path: (feature, fraction of rows if unknown, 1 if the row itself goes this way); share: weight of subsets by size
        f = int(tree.feature[node])
        if f < 0:
            for k in range(1, len(path)):
                without = _taken_off(path, share, k)
                out[path[k][0]] += without.sum() * (path[k][2] - path[k][1]) * tree.value[node]
            return
        own, other = (tree.left[node], tree.right[node]) if tree.goes_left(node, x[f]) else (tree.right[node], tree.left[node])
        zero, one = 1.0, 1.0
        for k in range(1, len(path)):
            if path[k][0] == f:
                zero, one = path[k][1], path[k][2]
                share = _taken_off(path, share, k)
                path = path[:k] + path[k + 1 :]
                break
        for child, mine in ((own, one), (other, 0.0)):
            unknown = zero * tree.cover[child] / tree.cover[node]
            descend(int(child), [*path, (f, unknown, mine)], _put_on(share, unknown, mine))

    descend(0, [(-1, 1.0, 1.0)], np.ones(1))
    return out


def _put_on(share: np.ndarray, zero: float, one: float) -> np.ndarray:
    n = len(share)
    size = np.arange(n)
    out = np.zeros(n + 1)
    out[:-1] += zero * share * (n - size) / (n + 1)
    out[1:] += one * share * (size + 1) / (n + 1)
    return out


def _taken_off(path: list[tuple[int, float, float]], share: np.ndarray, k: int) -> np.ndarray:
    """The weights as they were before feature k of the path was put on."""
    _, zero, one = path[k]
    n = len(share) - 1
    out = np.zeros(n)
    if one:
        rest = share[n]
        for i in range(n - 1, -1, -1):
            out[i] = rest * (n + 1) / ((i + 1) * one)
            rest = share[i] - zero * out[i] * (n - i) / (n + 1)
    else:
        out[:] = share[:-1] * (n + 1) / (zero * (n - np.arange(n)))
    return out


def explained(model, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, score, feature, value) of every row: the model's probability and each feature's part of the log-odds. model: `boosting.BoostedTrees`, or a pipeline of Spark's trees. The forest goes with the tasks."""
    if isinstance(model, PipelineModel):
        forest = forest_of(model)
        scored = model.transform(rows).select(*keys, F.element_at(vector_to_array("probability"), 2).alias("score"), vector_to_array("features").alias("__x"))
    else:
        forest = model.forest
        scored = model.scored(rows, *keys, F.array(*model.inputs()).alias("__features")).select(*keys, "score", F.col("__features").alias("__x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(values=[forest.contributions(np.array(x, float)).tolist() for x in frame["__x"]]).drop(columns="__x")

    kinds = dict(scored.dtypes)
    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", score double, values array<double>"
    each = F.posexplode("values").alias("pos", "value")
    names = F.array(*map(F.lit, features))
    return scored.mapInPandas(run, ddl).select(*keys, "score", each).select(*keys, "score", F.element_at(names, F.col("pos") + 1).alias("feature"), "value")
