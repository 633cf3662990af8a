"""Second-order gradient boosting over binned features.

Several members (the folds of a cross-validation and the final fit, say) grow together: a
row names its member, rows of equal bins, label and weight are one with their number
(`cells`), and one job a level adds up the gradients and second derivatives of all members'
nodes by feature and bin. Tasks add up what they read in arrays, Spark adds the tasks' sums
by cell, and the driver picks splits from a table whose size does not depend on the rows.
Missing values have a bin of their own; each split learns their side.

Margins are written every SAVE rounds; between that, tasks apply the few trees since.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import cells as C
from sparkloom.operators.trees import Trees, from_nodes

#: Rounds between two tables of margins.
SAVE = 8
#: Sums of tasks that the driver adds up itself: cells times tasks. Beyond that Spark adds them up by cell first.
DIRECT = 1 << 22
_CELL = ("member", "bins", "label", "weight", "seed", "n")
_STAT = "member int, bins binary, label double, weight double, seed long, n long, margin binary"


@dataclass(frozen=True)
class Boosting:
    """classes: 0 for a number, 2 for two classes (one output), more for a softmax. rows, columns: the shares that each tree sees. least: the smallest sum of second derivatives of a child."""

    classes: int = 0
    rounds: int = 250
    depth: int = 5
    rate: float = 0.08
    rows: float = 0.9
    columns: float = 0.9
    bins: int = 64
    l2: float = 1.0
    least: float = 1.0
    seed: int = 42

    @property
    def outputs(self) -> int:
        return self.classes if self.classes > 2 else 1


class Level:
    """Splits of one round's trees, as heaps: the children of node i are 2 i + 1 and 2 i + 2."""

    def __init__(self, trees: int, depth: int):
        shape = (trees, 2 ** (depth + 1) - 1)
        self.feature, self.bin = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.missing_left, self.split = np.zeros(shape, bool), np.zeros(shape, bool)
        self.value, self.cover = np.zeros(shape), np.zeros(shape)

    def walk(self, tree: np.ndarray, bins: np.ndarray, missing: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row. missing: the bin of missing values by (tree, feature)."""
        at, rows = np.zeros(len(tree), np.int64), np.arange(len(tree))
        for _ in range(depth):
            f = self.feature[tree, at]
            own = bins[rows, f]
            left = np.where(own == missing[tree, f], self.missing_left[tree, at], own <= self.bin[tree, at])
            at = np.where(self.split[tree, at], 2 * at + 2 - left, at)
        return at


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, by row and output."""
    if classes == 0:
        return weight[:, None] * (margin - label[:, None]), np.repeat(weight[:, None], margin.shape[1], axis=1)
    if classes == 2:
        p, y, twice = 1 / (1 + np.exp(-margin)), label[:, None], 1.0
    else:
        p = np.exp(margin - margin.max(axis=1, keepdims=True))
        p, y, twice = p / p.sum(axis=1, keepdims=True), label[:, None] == np.arange(classes), 2.0
    return weight[:, None] * (p - y), np.maximum(twice * weight[:, None] * p * (1 - p), 1e-16)


def _start(data: DataFrame, s: Boosting, members: int) -> np.ndarray:
    """Margins before the first tree: the mean, its log odds, or the log shares of classes."""
    out = np.zeros((members, s.outputs))
    if s.classes > 2:
        for r in data.groupBy("member", "label").agg(F.sum("weight").alias("w")).collect():  # a row a class
            out[r["member"], int(r["label"])] = r["w"]
        share = np.maximum(out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300), 1e-6)
        return np.log(share)
    for r in data.groupBy("member").agg((F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("mean")).collect():
        p = min(max(r["mean"], 1e-6), 1 - 1e-6) if s.classes else r["mean"]
        out[r["member"]] = np.log(p / (1 - p)) if s.classes else p
    return out


def _started(start: np.ndarray):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _CELL], C.packed(start[batch.column("member").to_numpy()])], names=[*_CELL, "margin"])

    return run


def _state(batch, bins: C.Bins, pending: list[Level], s: Boosting):
    """(member, binned features, margins) of a batch, the pending trees added."""
    member = batch.column("member").to_numpy()
    binned = C.unpacked(batch.column("bins"), np.uint16, bins.width).astype(np.int64)
    margin = C.unpacked(batch.column("margin"), np.float64, s.outputs).copy()
    missing = np.repeat(bins.missing, s.outputs, axis=0)
    for level in pending:
        for k in range(s.outputs):
            tree = member * s.outputs + k
            margin[:, k] += level.value[tree, level.walk(tree, binned, missing, s.depth)]
    return member, binned, margin, missing


def _moved(bins: C.Bins, pending: list[Level], s: Boosting):
    def run(batches):
        for batch in batches:
            _, _, margin, _ = _state(batch, bins, pending, s)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _CELL], C.packed(margin)], names=[*_CELL, "margin"])

    return run


def _histogram(bins: C.Bins, pending: list[Level], level: Level, depth: int, round_: int, s: Boosting):
    """(cell, g, h) of what a task reads, for the nodes at `depth`."""

    def run(batches):
        nodes, first = 2**depth, 2**depth - 1
        size = len(bins.edges) * s.outputs * nodes * bins.slots
        sums = np.zeros((2, size))
        for batch in batches:
            member, binned, margin, missing = _state(batch, bins, pending, s)
            g, h = gradients(margin, batch.column("label").to_numpy(), batch.column("weight").to_numpy(), s.classes)
            drawn = C.taken(C.uniform(batch.column("seed").to_numpy(), round_), batch.column("n").to_numpy(), s.rows)
            g, h = g * drawn[:, None], h * drawn[:, None]
            keep = np.flatnonzero(drawn)
            member, binned = member[keep], binned[keep]
            for k in range(s.outputs):
                tree = member * s.outputs + k
                node = level.walk(tree, binned, missing, depth) - first
                at = np.flatnonzero(node >= 0)
                start = (tree[at] * nodes + node[at]) * bins.slots
                cell = (start[:, None] + bins.first[member[at]] + binned[at]).ravel()
                real = (np.arange(bins.width)[None, :] < np.array([len(e) for e in bins.edges])[member[at]][:, None]).ravel()
                for row, own in zip(sums, (g, h)):
                    row += np.bincount(cell[real], np.repeat(own[keep[at], k], bins.width)[real], size)
        full = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[0][full]), pa.array(sums[1][full])], names=["cell", "g", "h"])

    return run


def best_split(g: np.ndarray, h: np.ndarray, s: Boosting) -> tuple[np.ndarray, ...]:
    """Gain, bin, side of missing values, and left sums by (tree, node), for one feature's bins (the last axis); the last bin is that of missing values. No gain: 0."""
    total_g, total_h = g.sum(axis=-1, keepdims=True), h.sum(axis=-1, keepdims=True)
    weigh = lambda a, b: a * a / (b + s.l2)
    shape = g.shape[:-1]
    best = (np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape, bool), np.zeros(shape), np.zeros(shape))
    left_g, left_h = np.cumsum(g[..., :-2], axis=-1), np.cumsum(h[..., :-2], axis=-1)
    if not left_g.shape[-1]:
        return best
    for missing in (False, True):
        a, b = left_g + missing * g[..., -1:], left_h + missing * h[..., -1:]
        ok = (b >= s.least) & (total_h - b >= s.least)
        gain = np.where(ok, weigh(a, b) + weigh(total_g - a, total_h - b) - weigh(total_g, total_h), 0.0)
        at = np.argmax(gain, axis=-1)[..., None]
        own = [np.take_along_axis(x, at, -1)[..., 0] for x in (gain, a, b)]
        better = own[0] > best[0] + 1e-12
        best = tuple(np.where(better, new, old) for new, old in zip((own[0], at[..., 0], np.full(shape, missing), own[1], own[2]), best))
    return best


def _split_level(level: Level, g: np.ndarray, h: np.ndarray, bins: C.Bins, depth: int, allowed: list[np.ndarray], s: Boosting) -> bool:
    """Sets the splits of the nodes at `depth` and the values below them; whether any was split. g, h: by (tree, node, bin)."""
    at = np.arange(2**depth - 1, 2 ** (depth + 1) - 1)
    for m in range(len(bins.edges)):
        trees = slice(m * s.outputs, (m + 1) * s.outputs)
        part = lambda f: slice(bins.first[m, f], bins.first[m, f] + bins.missing[m, f] + 1)  # noqa: B023, E731
        total_g, total_h = (x[trees, :, part(0)].sum(axis=-1) for x in (g, h))
        best, chosen = (np.zeros(total_g.shape),) * 5, np.full(total_g.shape, -1)
        for f in allowed[m]:
            own = best_split(g[trees, :, part(f)], h[trees, :, part(f)], s)
            better = own[0] > best[0]
            best, chosen = tuple(np.where(better, new, old) for new, old in zip(own, best)), np.where(better, f, chosen)
        _, cut, missing_left, left_g, left_h = best
        alive = (chosen >= 0) & (level.split[trees, (at - 1) // 2] if depth else True)
        if depth == 0:
            level.value[trees, at], level.cover[trees, at] = -s.rate * total_g / (total_h + s.l2), total_h
        level.split[trees, at], level.feature[trees, at], level.bin[trees, at], level.missing_left[trees, at] = alive, np.where(alive, chosen, 0), cut, missing_left.astype(bool)
        for child, x, y in ((2 * at + 1, left_g, left_h), (2 * at + 2, total_g - left_g, total_h - left_h)):
            level.value[trees, child], level.cover[trees, child] = np.where(alive, -s.rate * x / (y + s.l2), 0.0), np.where(alive, y, 0.0)
    return bool(level.split[:, at].any())


def _nodes(level: Level, tree: int, bins: C.Bins, s: Boosting) -> list[dict]:
    """One tree's nodes that exist, as records."""
    member, k = divmod(tree, s.outputs)
    places, order, todo = {}, [], [0]
    while todo:
        at = todo.pop()
        places[at] = len(order)
        order.append(at)
        if level.split[tree, at]:
            todo += [2 * at + 2, 2 * at + 1]
    out = []
    for at in order:
        f, inner = int(level.feature[tree, at]), bool(level.split[tree, at])
        value = np.zeros(s.outputs)
        value[k] = level.value[tree, at]
        edges = bins.edges[member][f] if inner else ()
        threshold = (edges[level.bin[tree, at]] if level.bin[tree, at] < len(edges) else np.inf) if inner else 0.0
        out.append({"feature": f, "threshold": threshold, "left": places.get(2 * at + 1, -1) if inner else -1, "right": places.get(2 * at + 2, -1) if inner else -1, "missing_left": bool(level.missing_left[tree, at]), "value": value, "cover": level.cover[tree, at]})
    return out


def fit(data: DataFrame, members: int, s: Boosting) -> list[Trees]:
    """data: (member int, x array<double>, label double, weight double, seed long), x of one length in each member. NaN and null are missing."""
    spark = data.sparkSession
    data = data.select("member", F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x"), "label", "weight", "seed")
    bins, start = C.edges(data, members, s.bins), _start(data, s, members)
    base = C.saved(C.counted(data, bins).mapInArrow(_started(start), _STAT), "boosting")
    tasks = base.rdd.getNumPartitions()
    rng, rounds, pending = np.random.default_rng(s.seed), [], []
    shape = (members * s.outputs, -1, bins.slots)
    for r in range(s.rounds):
        level = Level(members * s.outputs, s.depth)
        allowed = [np.sort(rng.permutation(len(e))[: max(1, round(s.columns * len(e)))]) for e in bins.edges]
        for depth in range(s.depth):
            sums = np.zeros((2, members * s.outputs * 2**depth * bins.slots))
            cells = base.mapInArrow(_histogram(bins, pending, level, depth, r, s), "cell long, g double, h double")
            if sums.shape[1] * tasks > DIRECT:
                cells = cells.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            cells = cells.toArrow()
            at = cells.column("cell").to_numpy()
            for row, name in zip(sums, ("g", "h")):
                row += np.bincount(at, cells.column(name).to_numpy(), len(row))
            if not _split_level(level, sums[0].reshape(shape), sums[1].reshape(shape), bins, depth, allowed, s):
                break
        rounds.append(level)
        pending.append(level)
        if len(pending) == SAVE and r + 1 < s.rounds:
            old, base, pending = base, C.saved(base.mapInArrow(_moved(bins, pending, s), _STAT), "boosting"), []
            old.unpersist()
    base.unpersist()
    return [from_nodes([_nodes(level, m * s.outputs + k, bins, s) for level in rounds for k in range(s.outputs)], start[m]) for m in range(members)]


def shares(margin: np.ndarray, classes: int) -> np.ndarray:
    """Probabilities by class of margins; a number stays as it is."""
    if classes == 2:
        share = 1 / (1 + np.exp(-margin))
        return np.concatenate([1 - share, share], axis=1)
    if classes:
        margin = np.exp(margin - margin.max(axis=1, keepdims=True))
        return margin / margin.sum(axis=1, keepdims=True)
    return margin


@dataclass
class Boosted:
    """A fitted ensemble that predicts rows of a table."""

    trees: Trees
    classes: int

    link = staticmethod(shares)

    def outputs(self, inputs: list[str], spark: SparkSession, sent: list | None = None) -> Column:
        """Shares of classes, or the number alone, as an array. sent: gets the broadcast, for a caller that destroys it."""
        shared, classes, link = spark.sparkContext.broadcast(self.trees), self.classes, self.link
        if sent is not None:
            sent.append(shared)

        @F.pandas_udf("array<double>")
        def run(x):
            import pandas as pd

            own = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, len(inputs)))
            return pd.Series(list(link(shared.value.predict(own), classes)))

        return run(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in inputs]))

    def named(self, out: Column) -> tuple[Column, Column | None]:
        """p and, for classes, proba of what outputs() gave."""
        return ((F.array_position(out, F.array_max(out)) - 1).cast("double"), out) if self.classes else (out[0], None)

    def transform(self, rows: DataFrame, inputs: list[str]) -> DataFrame:
        """Adds p and, for classes, proba."""
        p, proba = self.named(F.col("_out"))
        made = rows.withColumn("_out", self.outputs(inputs, rows.sparkSession))
        return made.withColumns({"p": p} if proba is None else {"p": p, "proba": proba}).drop("_out")

    def save(self, spark: SparkSession, path: str) -> None:
        t, n = self.trees, len(self.trees.feature)
        root = np.zeros(n, bool)
        root[t.roots] = True
        values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * t.value.shape[1]), pa.array(t.value.ravel()))
        rows = {"id": np.arange(n), "root": root, "feature": t.feature, "threshold": t.threshold, "left": t.left, "right": t.right, "missing_left": t.missing_left, "value": values, "cover": t.cover}
        spark.createDataFrame(pa.table(rows)).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.classes, [float(b) for b in t.base])], "classes int, base array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/base")

    @classmethod
    def load(cls, path: str) -> Boosted:
        spark = SparkSession.active()
        rows = spark.read.parquet(f"{path}/nodes").orderBy("id").toArrow()
        take = lambda c: rows.column(c).to_numpy()
        base = spark.read.parquet(f"{path}/base").first()
        value = np.array(rows.column("value").combine_chunks().flatten()).reshape(rows.num_rows, -1)
        return cls(Trees(np.flatnonzero(take("root")), take("feature"), take("threshold"), take("left"), take("right"), take("missing_left"), value, take("cover"), np.array(base["base"])), base["classes"])
