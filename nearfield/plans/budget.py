"""Learned search budgets: how many candidates a query needs, predicted from its distances to the centroids.

A first look at the centroids gives twelve features; gradient-boosted trees, fitted by Spark ML on queries with
known neighbours, predict the logarithm of the budget.  Off by default.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import ivf, kmeans
from nearfield.operators.topk import pages, top_k_batch
from nearfield.sources.log import Store

FEATURES = ("log_nearest", "best_over_entry", "kth_over_entry", "kth_over_best", "next_over_kth", "log_near_cells", "step", "log_probed", "log_rows", "fill", "selectivity", "log_n")
#: Ratios are cut off here.
CAP = 1e3
LOOK = 8


def features(q: np.ndarray, cells: ivf.Cells, k: int, selectivity: float = 1.0) -> list[float]:
    """What the centroids tell about a query."""
    d = np.sort(kmeans.squared(q[None, :], cells.centroids)[0].clip(min=1e-12))
    order = cells.ranked(q)
    look = min(LOOK, len(d))
    ratio = lambda a, b: float(min(CAP, a / max(b, 1e-12)))
    held = cells.counts[order[:look]]
    return [
        math.log(d[0]),
        ratio(d[0], d[-1]),
        ratio(d[look - 1], d[-1]),
        ratio(d[look - 1], d[0]),
        ratio(d[min(look, len(d) - 1)], d[look - 1]),
        math.log2(1 + int((d < 1.5 * d[0]).sum())),
        ratio(d[min(1, len(d) - 1)] - d[0], d[0]),
        math.log2(1 + look),
        math.log2(1 + int(held.sum())),
        ratio(held[0], cells.counts.mean() or 1),
        selectivity,
        math.log2(1 + int(cells.counts.sum())),
    ]


@dataclass
class Tree:
    """One regression tree in flat arrays; a leaf has feature -1 and a value."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def predict(self, x: list[float]) -> float:
        at = 0
        while self.feature[at] >= 0:
            at = self.left[at] if x[self.feature[at]] <= self.threshold[at] else self.right[at]
        return self.value[at]


@dataclass
class BudgetModel:
    """A forest whose weighted sum is log2 of the budget."""

    trees: list[Tree]
    weights: list[float]
    multiplier: float = 1.0

    def predict(self, x: list[float]) -> float:
        return sum(w * t.predict(x) for w, t in zip(self.weights, self.trees, strict=True))

    def budget(self, q: np.ndarray, cells: ivf.Cells, k: int, selectivity: float = 1.0) -> int:
        return max(k, min(1 << 20, math.ceil(self.multiplier * 2 ** self.predict(features(q, cells, k, selectivity)))))

    def dumps(self) -> str:
        return json.dumps({"weights": self.weights, "multiplier": self.multiplier, "trees": [vars(t) for t in self.trees]})

    @classmethod
    def loads(cls, text: str) -> BudgetModel:
        d = json.loads(text)
        return cls([Tree(**t) for t in d["trees"]], d["weights"], d["multiplier"])


def save(spark: SparkSession, model: BudgetModel, path: str) -> None:
    """Write a model as one file, on any file system that Spark reaches."""
    folder, name = path.rsplit("/", 1)
    Store(spark, folder).write_text(model.dumps(), name)


def load(spark: SparkSession, path: str) -> BudgetModel:
    """The model that `save` wrote."""
    folder, name = path.rsplit("/", 1)
    return BudgetModel.loads(Store(spark, folder).read_text(name))


def flatten(node) -> Tree:
    """A Spark ML tree (its root, on the JVM) in flat arrays."""
    tree = Tree([], [], [], [], [])

    def add(n) -> int:
        at = len(tree.feature)
        leaf = n.getClass().getSimpleName() == "LeafNode"
        for column, value in ((tree.feature, -1 if leaf else n.split().featureIndex()), (tree.threshold, 0.0 if leaf else n.split().threshold()), (tree.left, 0), (tree.right, 0), (tree.value, float(n.prediction()))):
            column.append(value)
        if not leaf:
            tree.left[at], tree.right[at] = add(n.leftChild()), add(n.rightChild())
        return at

    add(node)
    return tree


def training_rows(spark: SparkSession, assigned: DataFrame, cells: ivf.Cells, queries: DataFrame, k: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """(qid, features..., label): label is log2 of the smallest budget whose cells hold all true neighbours."""
    truth = top_k_batch(assigned, queries, k, id, vector).join(assigned.select(id, "cell"), id)
    needed = {r.qid: set(r.cells) for r in truth.groupBy("qid").agg(F.collect_set("cell").alias("cells")).collect()}
    rows = []
    for q_ids, q in pages(queries, "qid", "qv"):
        for i, v in zip(q_ids.tolist(), q, strict=True):
            order = cells.ranked(v)
            last = max((int(np.flatnonzero(order == c)[0]) for c in needed.get(i, ())), default=0)
            before = int(cells.counts[order[:last]].sum())
            rows.append((i, *features(v, cells, k), math.log2(max(k, 1 + before / cells.oversample))))
    return spark.createDataFrame(rows, "qid long, " + ", ".join(f"{f} double" for f in FEATURES) + ", label double")


def train(rows: DataFrame, trees: int = 40, depth: int = 4, seed: int = 1) -> BudgetModel:
    """Gradient-boosted trees with a tenth of the queries held out to stop early."""
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.withColumn("held", F.pmod(F.xxhash64("qid"), F.lit(10)) == 0))
    fitted = GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed, validationIndicatorCol="held").fit(data)
    return BudgetModel([flatten(t._call_java("rootNode")) for t in fitted.trees], list(fitted.treeWeights))
