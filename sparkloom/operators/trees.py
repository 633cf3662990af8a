"""Ensembles of decision trees as flat arrays: prediction and exact Shapley values over many rows at once.

A row reaches a leaf if each feature on the leaf's path lies in an interval, so a leaf is
a product over its features of 1 or 0 where the feature is known, and of the share of
training rows that went that way where it is not. The Shapley value of a factor of such a
product is the integral, over t from 0 to 1, of the product of the other features'
`known * t + share * (1 - t)`: a polynomial in t, which Gauss-Legendre nodes integrate
exactly. So a leaf of d features costs d times d / 2 steps a row, in whole arrays, where
sums over subsets cost 2 to the power of d.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.scratch import new_folder

#: Doubles that one step of a Shapley sum holds.
STEP_CELLS = 1 << 21


@dataclass
class Trees:
    """Nodes of all trees one after another; children are places in these arrays, -1 at leaves.

    Rows with x <= threshold go left; missing values go left where missing_left says so.
    value: what each leaf adds, by output; cover: the training rows (or weight) of a node.
    """

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    base: np.ndarray
    paths: list | None = field(default=None, repr=False)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        at = np.tile(self.roots, len(x))
        row, flat, missing = np.repeat(np.arange(len(x)), len(self.roots)) * (x.shape[1] if x.ndim > 1 else 0), np.ravel(x), bool(np.isnan(x).any())
        under_way = np.flatnonzero(self.left[at] >= 0)
        while len(under_way):
            node = at[under_way]
            own = flat[row[under_way] + self.feature[node]]
            goes_left = own <= self.threshold[node]
            if missing:
                goes_left |= np.isnan(own) & self.missing_left[node]
            node = np.where(goes_left, self.left[node], self.right[node])
            at[under_way] = node
            under_way = under_way[self.left[node] >= 0]
        return at.reshape(len(x), len(self.roots))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaf values by output, rows at a time."""
        step = max(1, (STEP_CELLS >> 3) // max(1, len(self.roots) * self.value.shape[1]))
        parts = [self.value[self.leaves(x[k : k + step])].sum(axis=1) for k in range(0, len(x), step)]
        return self.base + (np.concatenate(parts) if parts else np.zeros((0, self.value.shape[1])))

    def expected(self) -> np.ndarray:
        """The mean output when nothing is known."""
        return self.base + sum((share.prod(axis=1)[:, None] * value).sum(axis=0) for _, _, _, _, share, value in self._paths())

    def _paths(self) -> list[tuple[np.ndarray, ...]]:
        """For each tree: feature, low, high, missing and share by (leaf, place on the path), each feature once, and the leaves' values."""
        if self.paths is None:
            self.paths = [self._tree_paths(int(root)) for root in self.roots]
        return self.paths

    def _tree_paths(self, root: int) -> tuple[np.ndarray, ...]:
        found, todo = [], [(root, {})]
        while todo:
            node, path = todo.pop()
            if self.left[node] < 0:
                found.append((node, path))
                continue
            f, t, missing = int(self.feature[node]), float(self.threshold[node]), bool(self.missing_left[node])
            low, high, with_missing, share = path.get(f, (-np.inf, np.inf, True, 1.0))
            total = self.cover[node]
            for child, own in ((int(self.left[node]), (low, min(high, t), with_missing and missing)), (int(self.right[node]), (max(low, t), high, with_missing and not missing))):
                todo.append((child, {**path, f: (*own, share * (self.cover[child] / total if total else 0.0))}))
        depth = max(1, max(len(p) for _, p in found))
        shape = (len(found), depth)
        feature, low, high = np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf)
        missing, share = np.ones(shape, bool), np.ones(shape)
        for k, (_, path) in enumerate(found):
            for d, (f, (a, b, with_missing, part)) in enumerate(path.items()):
                feature[k, d], low[k, d], high[k, d], missing[k, d], share[k, d] = f, a, b, with_missing, part
        return feature, low, high, missing, share, self.value[[n for n, _ in found]]

    def shapley(self, x: np.ndarray, output: int) -> np.ndarray:
        """Path-dependent Shapley values of one output, by row and feature; they add up to the prediction less `expected`."""
        rows, features = x.shape
        out = np.zeros((rows, features))
        for feature, low, high, missing, share, values in self._paths():
            depth = feature.shape[1]
            nodes, weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
            nodes, weights = (nodes + 1) / 2, weights / 2
            step = max(1, STEP_CELLS // feature.size)
            for first in range(0, rows, step):
                own = x[first : first + step][:, feature]
                known = np.where(np.isnan(own), missing, (own > low) & (own <= high))
                total = np.zeros(known.shape)
                for t, w in zip(nodes, weights):
                    factor = np.where(known, t, 0.0) + share * (1 - t)
                    total += w * (factor.prod(axis=2)[:, :, None] / np.where(factor > 0, factor, 1.0)) if share.all() else w * _others(factor)
                part = (known - share) * total * values[:, output][None, :, None]
                at = (np.arange(len(own))[:, None, None] * features + feature).ravel()
                out[first : first + step] += np.bincount(at, part.ravel(), len(own) * features).reshape(len(own), features)
        return out


def _others(factor: np.ndarray) -> np.ndarray:
    """The product of all factors but one, also where some are 0: products from the left times products from the right."""
    ones = np.ones((*factor.shape[:2], 1))
    before = np.concatenate([ones, np.cumprod(factor, axis=2)[:, :, :-1]], axis=2)
    after = np.concatenate([np.cumprod(factor[:, :, ::-1], axis=2)[:, :, ::-1][:, :, 1:], ones], axis=2)
    return before * after


def from_nodes(trees: list[list[dict]], base: np.ndarray) -> Trees:
    """trees: for each its nodes {feature, threshold, left, right, missing_left, value, cover}, children by place in the tree, -1 at leaves."""
    start = np.cumsum([0, *[len(t) for t in trees]])
    nodes = [n for t in trees for n in t]
    offset = np.repeat(start[:-1], [len(t) for t in trees])
    child = lambda side: np.array([n[side] for n in nodes], np.int64) + np.where([n[side] >= 0 for n in nodes], offset, 0)
    take = lambda name, kind: np.array([n[name] for n in nodes], kind)
    return Trees(start[:-1], take("feature", np.int64), take("threshold", float), child("left"), child("right"), take("missing_left", bool), np.stack([np.asarray(n["value"], float) for n in nodes]), take("cover", float), np.asarray(base, float))


def from_spark(model, spark: SparkSession) -> Trees:
    """Trees of a fitted forest or boosted ensemble of Spark, through its saved form: one read, whatever the number of nodes.

    A forest of classes has an output for each class, the mean of its leaves' shares; other
    ensembles have one, the weighted sum of their leaves.
    """
    path = new_folder(spark, "trees")
    model.save(path)
    n = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", n["id"].alias("id"), n["prediction"].alias("prediction"), n["impurityStats"].alias("stats"), n["rawCount"].alias("cover"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), n["split"]["leftCategoriesOrThreshold"].alias("at"), n["split"]["numCategories"].alias("categories"),
    ).toArrow().to_pylist()
    if any(r["left"] >= 0 and r["categories"] != -1 for r in rows):
        raise ValueError("splits on categories are not supported: encode them first")
    shares = hasattr(model, "numClasses") and type(model).__name__.startswith("RandomForest")
    weights = [1.0 / len(model.trees)] * len(model.trees) if type(model).__name__.startswith("RandomForest") else list(model.treeWeights)
    trees: list[list[dict]] = [[] for _ in weights]
    for r in sorted(rows, key=lambda r: (r["treeID"], r["id"])):
        weight, stats = weights[r["treeID"]], np.array(r["stats"])
        value = weight * stats / max(stats.sum(), 1e-300) if shares else [weight * r["prediction"]]
        inner = r["left"] >= 0
        trees[r["treeID"]].append({"feature": max(r["feature"], 0), "threshold": r["at"][0] if inner else 0.0, "left": r["left"], "right": r["right"], "missing_left": False, "value": value, "cover": float(stats.sum()) if shares else float(r["cover"])})
    return from_nodes(trees, np.zeros(len(trees[0][0]["value"])))
