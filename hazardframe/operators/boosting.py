"""Second-order boosted trees: histogram learning in Spark, scoring as expressions, model files of the common JSON layout.

Learning writes the rows once as chunks of bin numbers. A level of a tree is one
aggregate: tasks sort their chunks' rows into the tree so far and return sums of
gradients and hessians by (node, feature, bin), as whole numbers of a fixed unit,
so that the result does not depend on how rows are dealt. What meets on the driver
is as large as nodes x features x bins, whatever the number of rows. Chunks are
written anew, with the margins reached, every `REFRESH` trees.

A model is node arrays. It scores rows inside the plan, as one CASE expression a
tree, so nothing leaves the JVM; files are read and written in the JSON layout
that other libraries exchange such models in.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_folder, work_folder
from .trees import Forest, Tree

#: Bins of a feature; the last number stands for a missing value.
BINS, MISSING = 255, 255
#: Rows of a chunk, chunks of a task on average, trees between two writings of the margins, categories of a column.
CHUNK, TASK_CHUNKS, REFRESH, CATEGORIES = 16_384, 16, 25, 10_000


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class BoostedTrees:
    """Trees over `features`, added to `base`; categories of a feature are numbered in order, unseen ones -1. narrow: values are compared as 32-bit numbers."""

    features: list[str]
    trees: list[Tree]
    base: float = 0.0
    categories: dict[str, list[str]] = field(default_factory=dict)
    narrow: bool = False

    @property
    def forest(self) -> Forest:
        return Forest(self.trees, [1.0] * len(self.trees), 1.0, self.base)

    def inputs(self) -> list[Column]:
        """The features as doubles, categories by their numbers."""
        return [encoded(f, self.categories[f]) if f in self.categories else F.col(_quoted(f)).cast("double") for f in self.features]

    def margin(self, inputs: str = "__x") -> Column:
        """The log-odds of a row whose features are the array column `inputs`."""
        kind = "float" if self.narrow else "double"
        parts = [F.expr(_case(t, inputs, kind)) for t in self.trees]
        while len(parts) > 1:  # added in pairs, so that the expression stays shallow
            parts = [a if b is None else a + b for a, b in zip(parts[::2], [*parts[1::2], None][: len(parts[::2])], strict=True)]
        return F.lit(self.base) + (parts[0] if parts else F.lit(0.0))

    def scored(self, rows: DataFrame, *keep) -> DataFrame:
        """(keep, score): probabilities, computed where the rows are; each input once, not anew at every node (the optimizer puts no expression through an explode)."""
        named = rows.select(*keep, F.explode(F.array(F.array(*self.inputs()))).alias("__x"))
        return named.select(*named.columns[:-1], (F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))).alias("score"))


def encoded(column: str, categories: list[str]) -> Column:
    """The number of the value among the sorted categories, -1 for any other."""
    known = F.array(*map(F.lit, categories)) if categories else F.array().cast("array<string>")
    return (F.coalesce(F.array_position(known, F.col(_quoted(column)).cast("string")), F.lit(0)) - 1).cast("double")


def categories_of(rows: DataFrame, column: str) -> list[str]:
    found = [r[0] for r in rows.select(F.col(_quoted(column)).cast("string")).where(F.col(column).isNotNull()).distinct().limit(CATEGORIES + 1).collect()]
    if len(found) > CATEGORIES:
        raise ValueError(f"{column} has more than {CATEGORIES} categories")
    return sorted(found)


def _case(tree: Tree, inputs: str, kind: str, node: int = 0) -> str:
    if tree.feature[node] < 0:
        return f"{float(tree.value[node])!r}D"
    x, at = f"cast({inputs}[{int(tree.feature[node])}] AS {kind})", f"{float(tree.threshold[node])!r}D"
    missing = f"{x} IS NULL OR isnan({x}) OR " if tree.missing_left is not None and tree.missing_left[node] else ""
    return f"IF({missing}{x} <= {at}, {_case(tree, inputs, kind, int(tree.left[node]))}, {_case(tree, inputs, kind, int(tree.right[node]))})"


# Files -------------------------------------------------------------------------


def read_boosted(spark: SparkSession, path: str) -> BoostedTrees:
    """A model from a file of the exchanged JSON layout (one output, numeric splits), from any store."""
    learner = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))["learner"]
    model, param = learner["gradient_booster"]["model"], learner["learner_model_param"]
    n = int(param["num_feature"])
    if int(param.get("num_class", 0)) > 1:
        raise ValueError("models of several classes are not read")
    start = float(str(param["base_score"]).strip("[]"))
    if learner["objective"]["name"] in ("binary:logistic", "reg:logistic"):
        start = math.log(start / (1 - start))
    trees = []
    for t in model["trees"]:
        if any(t.get("split_type") or []):
            raise ValueError("splits by category are not read")
        left, right = np.array(t["left_children"]), np.array(t["right_children"])
        leaf, at = left < 0, np.array(t["split_conditions"], np.float32).astype(np.float64)
        # the file's x < t is x <= the number before t
        before = np.nextafter(at.astype(np.float32), np.float32(-np.inf)).astype(np.float64)
        trees.append(Tree(np.where(leaf, -1, t["split_indices"]), np.where(leaf, 0.0, before), left, right, np.where(leaf, at, 0.0), np.array(t["sum_hessian"], float), np.array(t["default_left"]) == 1))
    names = learner.get("feature_names") or [f"f{k}" for k in range(n)]
    categories = json.loads(learner.get("attributes", {}).get("categories", "{}"))
    return BoostedTrees(list(names), trees, start, categories, narrow=True)


def write_boosted(spark: SparkSession, model: BoostedTrees, path: str) -> None:
    """The model in that layout. Its numbers have 32 bits, so a threshold goes up to the next of them, and values are compared as such when it is read."""
    trees = []
    for k, t in enumerate(model.trees):
        inner = t.feature >= 0
        at = np.where(inner, np.nextafter(t.threshold.astype(np.float32), np.float32(np.inf)), t.value.astype(np.float32))
        parents = np.full(len(t.feature), 2147483647)
        for node in np.flatnonzero(inner):
            parents[[t.left[node], t.right[node]]] = node
        trees.append(
            {
                "id": k, "left_children": t.left.tolist(), "right_children": t.right.tolist(), "parents": parents.tolist(), "split_indices": np.where(inner, t.feature, 0).tolist(),
                "split_conditions": [float(x) for x in at], "default_left": [int(x) for x in (t.missing_left if t.missing_left is not None else np.zeros(len(inner)))],
                "sum_hessian": t.cover.tolist(), "base_weights": t.value.tolist(), "loss_changes": [0.0] * len(inner), "split_type": [0] * len(inner), "categories": [], "categories_nodes": [], "categories_segments": [], "categories_sizes": [],
                "tree_param": {"num_deleted": "0", "num_feature": str(len(model.features)), "num_nodes": str(len(inner)), "size_leaf_vector": "1"},
            }
        )
    learner = {
        "attributes": {"categories": json.dumps(model.categories)}, "feature_names": model.features, "feature_types": ["float"] * len(model.features),
        "gradient_booster": {"model": {"gbtree_model_param": {"num_parallel_tree": "1", "num_trees": str(len(trees))}, "tree_info": [0] * len(trees), "trees": trees}, "name": "gbtree"},
        "learner_model_param": {"base_score": repr(1 / (1 + math.exp(-model.base))), "boost_from_average": "1", "num_class": "0", "num_feature": str(len(model.features)), "num_target": "1"},
        "objective": {"name": "binary:logistic", "reg_loss_param": {"scale_pos_weight": "1"}},
    }
    text = json.dumps({"learner": learner, "version": [2, 0, 0]})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


# Learning ----------------------------------------------------------------------

_CHUNK_DDL = "chunk long, bins binary, y binary, weight binary, margin binary"
_CHUNK = pa.schema([("chunk", pa.int64()), *((n, pa.binary()) for n in ("bins", "y", "weight", "margin"))])


def _written(spark: SparkSession, path: str, tasks: int) -> DataFrame:
    return spark.read.schema(_CHUNK_DDL).parquet(path).coalesce(tasks).persist()


@dataclass(frozen=True)
class Learner:
    """Depth, step, share of rows and of columns a tree, least hessian of a child, weight of squared leaves, seed: the method's own settings.

    weight: a column, or None for 1 each. Rows whose label is null are left out.
    """

    features: list[str]
    label: str
    rounds: int = 400
    depth: int = 4
    step: float = 0.05
    rows_share: float = 0.8
    columns_share: float = 0.8
    least_hessian: float = 5.0
    leaf_weight: float = 1.0
    seed: int = 42
    weight: str | None = "weight"
    categorical: tuple[str, ...] = ()

    def fit(self, rows: DataFrame) -> BoostedTrees:
        spark, path = rows.sparkSession, work_folder(rows.sparkSession, "boosting")
        shell = BoostedTrees(list(self.features), [], 0.0, {c: categories_of(rows, c) for c in self.categorical})
        weight = F.coalesce(F.col(self.weight).cast("double"), F.lit(0.0)) if self.weight else F.lit(1.0)
        used = rows.where(F.col(self.label).isNotNull()).select(F.array(*shell.inputs()).alias("x"), F.col(self.label).cast("double").alias("y"), weight.alias("w"))
        cuts = self._cuts(used)
        total, mean = used.agg(F.sum("w"), F.sum(F.col("w") * F.col("y")) / F.sum("w")).head()
        if not total:
            return shell
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        shell.base = math.log(mean / (1 - mean))
        unit = 2.0 ** min(30, 62 - math.ceil(math.log2(total + 1)))
        chunk = CHUNK
        used.mapInArrow(lambda it: _chunked(it, cuts, shell.base, chunk), _CHUNK_DDL).write.parquet(f"{path}/0")
        # few rows are one task, whose sums need no exchange; jobs so short and alike gain nothing from plans that adapt
        spark = spark.newSession()
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        tasks = max(1, math.ceil(spark.read.parquet(f"{path}/0").count() / TASK_CHUNKS))
        chunks, since = _written(spark, f"{path}/0", tasks), []
        for k in range(self.rounds):
            chosen = np.random.default_rng([self.seed, k])
            columns = np.sort(chosen.choice(len(self.features), max(1, int(self.columns_share * len(self.features))), replace=False))
            binned, tree = self._grow(chunks, since, columns, cuts, k, unit)
            shell.trees.append(tree)
            since.append(binned)
            if len(since) == REFRESH and k + 1 < self.rounds:
                done, before = list(since), chunks
                chunks.mapInArrow(lambda it, done=done: _moved(it, done), _CHUNK_DDL).write.parquet(f"{path}/{k + 1}")
                chunks, since = _written(spark, f"{path}/{k + 1}", tasks), []
                before.unpersist()
        chunks.unpersist()
        drop_folder(spark, path)
        return shell

    def _cuts(self, used: DataFrame) -> list[np.ndarray]:
        """For each feature the values at which it may be split: its distinct ones, or about `BINS` quantiles."""
        at = [k / BINS for k in range(1, BINS)]
        known = lambda f: F.when(~F.isnan(F.col("x")[f]), F.col("x")[f])
        row = used.agg(*[F.percentile_approx(known(f), at, 100_000).alias(str(f)) for f in range(len(self.features))]).head()
        return [np.unique(np.array(c or [], float)) for c in row]

    def _grow(self, chunks: DataFrame, since: list[Tree], columns: np.ndarray, cuts: list[np.ndarray], number: int, unit: float) -> tuple[Tree, Tree]:
        """A tree over bin numbers and the same over values, level by level."""
        grown, frontier = _Growing(), [0]
        for level in range(self.depth):
            sums = _histograms(chunks, since, grown.tree(), frontier, columns, (self.seed, number, self.rows_share), unit)
            if not level:
                grown.totals[0] = sums[0, 0].sum(axis=0)
            frontier = [child for at, node in enumerate(frontier) for child in self._split(grown, node, sums[at], columns, cuts)]
            if not frontier:
                break
        leaf = np.array([-self.step * g / (h + self.leaf_weight) if h + self.leaf_weight else 0.0 for g, h in grown.totals])
        binned = grown.tree()
        binned.value = np.where(binned.feature < 0, leaf, 0.0)
        at = np.array([cuts[f][int(b)] if f >= 0 else 0.0 for f, b in zip(binned.feature, binned.threshold, strict=True)])
        return binned, Tree(binned.feature, at, binned.left, binned.right, binned.value, binned.cover, binned.missing_left)

    def _split(self, grown: _Growing, node: int, sums: np.ndarray, columns: np.ndarray, cuts: list[np.ndarray]) -> list[int]:
        """Splits the node where that gains most, the first of equals, and returns its children."""
        total, best = grown.totals[node], (1e-6, None)
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + self.leaf_weight + 1e-300)
        for at, f in enumerate(columns):
            n = len(cuts[f])
            lost = sums[at, MISSING]
            for missing_left in (False, True) if lost[1] else (False,):
                left = np.cumsum(sums[at, :n], axis=0) + (lost if missing_left else 0)
                right = total - left
                gain = score(left) + score(right) - score(total)
                gain[(left[:, 1] < self.least_hessian) | (right[:, 1] < self.least_hessian)] = -np.inf
                if n and gain.max() > best[0]:
                    b = int(gain.argmax())
                    best = (float(gain[b]), (int(f), b, missing_left, left[b], right[b]))
        return grown.split(node, *best[1]) if best[1] else []


class _Growing:
    """Nodes of a tree that still grows, with their sums of gradient and hessian."""

    def __init__(self) -> None:
        self.rows, self.totals = [[-1, 0, -1, -1, False]], [np.zeros(2)]

    def split(self, node: int, feature: int, at: int, missing_left: bool, left: np.ndarray, right: np.ndarray) -> list[int]:
        children = [len(self.rows), len(self.rows) + 1]
        self.rows[node] = [feature, at, *children, missing_left]
        self.rows += [[-1, 0, -1, -1, False] for _ in children]
        self.totals += [left, right]
        return children

    def tree(self) -> Tree:
        feature, at, left, right, missing = (np.array(c) for c in zip(*self.rows, strict=True))
        return Tree(feature, at.astype(float), left, right, np.zeros(len(feature)), np.array([t[1] for t in self.totals], float), missing.astype(bool))


def _chunked(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], base: float, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Chunks of bin numbers: how many cuts are below the value, or MISSING."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for at in range(0, batch.num_rows, chunk):
            part = batch.slice(at, chunk)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
            bins = np.empty(x.shape, np.uint8)
            for f, cut in enumerate(cuts):
                # a value above the last cut goes with it: no split lies beyond
                bins[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.minimum(np.searchsorted(cut, x[:, f]), max(0, len(cut) - 1)))
            margin = np.full(part.num_rows, base)
            columns = [[number], [bins.tobytes()], *([part.column(c).to_numpy(zero_copy_only=False).astype("<f8").tobytes()] for c in (1, 2)), [margin.tobytes()]]
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CHUNK.types, strict=True)], schema=_CHUNK)


def _nodes(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node at which each row of bin numbers ends."""
    at = np.zeros(len(bins), np.int64)
    while True:
        inner = np.flatnonzero(tree.feature[at] >= 0)
        if not len(inner):
            return at
        node = at[inner]
        b = bins[inner, tree.feature[node]]
        left = np.where(b == MISSING, tree.missing_left[node], b <= tree.threshold[node])
        at[inner] = np.where(left, tree.left[node], tree.right[node])


def _read(batch: pa.RecordBatch, since: list[Tree]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(chunk, bins, y, weight, margin) with the margins that the trees since the chunk was written make."""
    for row in batch.to_pylist():
        y, weight, margin = (np.frombuffer(row[c], "<f8") for c in ("y", "weight", "margin"))
        bins = np.frombuffer(row["bins"], np.uint8).reshape(len(y), -1)
        for tree in since:
            margin = margin + tree.value[_nodes(tree, bins)]
        yield row["chunk"], bins, y, weight, margin


def _moved(batches: Iterator[pa.RecordBatch], since: list[Tree]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            for chunk, bins, y, weight, margin in _read(batch.slice(at, 1), since):
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "bins": bins.tobytes(), "y": y.tobytes(), "weight": weight.tobytes(), "margin": margin.tobytes()}], schema=_CHUNK)


def drawn(chunk: int, n: int, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows of a chunk a tree learns from."""
    return np.random.default_rng([seed, tree, chunk & 0xFFFFFFFF, chunk >> 32]).random(n) < share


def gradients(y: np.ndarray, weight: np.ndarray, margin: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted logistic loss, as whole numbers of 1 / unit."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) * weight * unit), np.rint(np.maximum(p * (1 - p), 1e-16) * weight * unit)


def _histograms(chunks: DataFrame, since: list[Tree], tree: Tree, frontier: list[int], columns: np.ndarray, draw: tuple[int, int, float], unit: float) -> np.ndarray:
    """Sums of gradients and hessians (node, column, bin, 2) over the rows that the tree learns from and that end at the frontier's nodes."""
    number = np.full(len(tree.feature), -1)
    number[frontier] = np.arange(len(frontier))
    size = len(frontier) * len(columns) * 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size), np.int64)
        for batch in batches:
            for chunk, bins, y, weight, margin in _read(batch, since):
                node = number[_nodes(tree, bins)]
                mine = np.flatnonzero((node >= 0) & drawn(chunk, len(y), *draw))
                slots = ((node[mine, None] * len(columns) + np.arange(len(columns))) * 256 + bins[mine][:, columns]).ravel()
                for at, values in enumerate(gradients(y[mine], weight[mine], margin[mine], unit)):
                    sums[at] += np.bincount(slots, np.repeat(values, len(columns)), size).astype(np.int64)
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[0, some]), pa.array(sums[1, some])], ["slot", "g", "h"])

    found = chunks.mapInArrow(run, "slot long, g long, h long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = np.zeros((size, 2))
    slots = found.column("slot").to_numpy()
    out[slots, 0], out[slots, 1] = found.column("g").to_numpy() / unit, found.column("h").to_numpy() / unit
    return out.reshape(len(frontier), len(columns), 256, 2)
