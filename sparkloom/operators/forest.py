"""Random forests over binned features.

The forests of several members grow together from one table of cells. Each tree draws its
own bootstrap of the rows. A node of more than LOCAL cells is split by sums that all tasks
add up, level by level; the cells of a smaller one go to a task, which grows what lies
below. Where cells are few from the beginning, a task grows some whole trees of a member.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import cells as C
from sparkloom.operators.boosting import Boosted
from sparkloom.operators.trees import Trees

#: Cells of a node that one task takes.
LOCAL = 1 << 16
#: Sums that a task holds at once.
SUMS = 1 << 21
#: Parts that the trees of a member of few cells are dealt to.
PARTS = 16
_CELL = "part int, bins binary, label double, weight double, seed long, n long"
_NODE = "tree int, top int, id int, feature int, cut int, left int, right int, cover double, value array<double>"


@dataclass(frozen=True)
class Forest:
    """classes: 0 for a number. leaf: the fewest rows of a leaf, as the tree's bootstrap counts them."""

    classes: int = 0
    trees: int = 200
    depth: int = 14
    leaf: int = 2
    bins: int = 32
    seed: int = 42

    @property
    def outputs(self) -> int:
        return max(1, self.classes)

    def tried(self, features: int) -> int:
        """Features that a node may be split by: the root of their number, or a third for numbers."""
        return int(np.ceil(np.sqrt(features) if self.classes else features / 3))


def _rng(s: Forest, tree: int, node: int) -> np.random.Generator:
    return np.random.default_rng([s.seed, tree, node])


def _amounts(label: np.ndarray, weight: np.ndarray, center: float, s: Forest) -> tuple[np.ndarray, np.ndarray]:
    """For each row the output that it adds to, and what it adds."""
    if s.classes:
        return label.astype(np.int64), weight
    return np.zeros(len(label), np.int64), weight * (label - center)


def _size(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (m * m).sum(axis=-1) / np.maximum(w, 1e-300)


def best_cut(m: np.ndarray, w: np.ndarray, n: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Gain in purity (Gini's, or of the variance) times weight, and cut, of each node. m: sums by (node, bin, output), w and n: weight and rows by (node, bin). No gain: 0."""
    m, w, n = np.cumsum(m, axis=1), np.cumsum(w, axis=1), np.cumsum(n, axis=1)
    parts = _size(m[:, :-1], w[:, :-1]) + _size(m[:, -1:] - m[:, :-1], w[:, -1:] - w[:, :-1])
    ok = (n[:, :-1] >= leaf) & (n[:, -1:] - n[:, :-1] >= leaf)
    gain = np.where(ok, parts - _size(m[:, -1:], w[:, -1:]), 0.0)
    gain[gain <= 1e-12 * parts] = 0.0
    cut = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), cut], cut


def grow(binned: np.ndarray, bins: int, where: np.ndarray, amount: np.ndarray, weight: np.ndarray, n: np.ndarray, features: int, depth: int, rng: np.random.Generator, s: Forest) -> tuple[np.ndarray, ...]:
    """A tree of these rows as (feature, cut, left, right, sums by output, weight) of its nodes, level by level; feature -1: a leaf. bins: the most bins of a feature."""
    k, tried = s.outputs, s.tried(features)
    levels, node, here, made = [], np.zeros(len(n), np.int64), 1, 1
    while True:
        m = np.bincount(node * k + where, amount, here * k).reshape(here, k)
        w, rows = np.bincount(node, weight, here), np.bincount(node, n, here)
        feature, cut = np.full(here, -1), np.zeros(here, np.int64)
        levels.append((feature, cut, m, w))
        able = rows >= 2 * s.leaf
        if s.classes:
            able &= (m > 0).sum(axis=1) > 1
        if len(levels) > depth or not able.any():
            break
        keep = able[node]
        binned, where, amount, weight, n, node = binned[keep], where[keep], amount[keep], weight[keep], n[keep], (np.cumsum(able) - 1)[node[keep]]
        todo = np.flatnonzero(able)
        chosen = np.argsort(rng.random((len(todo), features)), axis=1)[:, :tried]
        best, step = np.zeros(len(todo)), max(1, SUMS // (bins * (k + 2)))
        if step < len(todo):
            order = np.argsort(node, kind="stable")
            binned, where, amount, weight, n, node = (v[order] for v in (binned, where, amount, weight, n, node))
        for first in range(0, len(todo), step):
            own = slice(*np.searchsorted(node, [first, first + step])) if step < len(todo) else slice(None)
            at, count = node[own] - first, min(step, len(todo) - first)
            for f in chosen[first : first + step].T:
                place = at * bins + binned[own][np.arange(len(at)), f[at]]
                sums = np.bincount(place * k + where[own], amount[own], count * bins * k).reshape(count, bins, k)
                gain, place = best_cut(sums, np.bincount(place, weight[own], count * bins).reshape(count, bins), np.bincount(place, n[own], count * bins).reshape(count, bins), s.leaf)
                better = np.flatnonzero(gain > best[first : first + step])
                best[first + better], feature[todo[first + better]], cut[todo[first + better]] = gain[better], f[better], place[better]
        split = feature[todo] >= 0
        if not split.any():
            break
        keep = split[node]
        binned, where, amount, weight, n, node = binned[keep], where[keep], amount[keep], weight[keep], n[keep], node[keep]
        right = binned[np.arange(len(node)), feature[todo][node]] > cut[todo][node]
        node = 2 * (np.cumsum(split) - 1)[node] + right
        here = 2 * int(split.sum())
        made += here
    feature, cut, m, w = (np.concatenate(v) for v in zip(*levels))
    inner = feature >= 0
    left = np.where(inner, 2 * np.cumsum(inner) - 1, -1)  # children follow in the order of their parents
    return _pruned(feature, cut, left, np.where(inner, left + 1, -1), m, w, [len(level[0]) for level in levels]) if s.classes else (feature, cut, left, np.where(inner, left + 1, -1), m, w)


def _pruned(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, m: np.ndarray, w: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, ...]:
    """Without splits whose two leaves name the same class."""
    most, feature, stop = m.argmax(axis=1), feature.copy(), len(feature)
    for size in reversed(sizes):
        at = stop - size + np.flatnonzero(feature[stop - size : stop] >= 0)
        same = (feature[left[at]] < 0) & (feature[right[at]] < 0) & (most[left[at]] == most[right[at]])
        feature[at[same]] = -1
        stop -= size
    reached, start = np.zeros(len(feature), bool), 0
    reached[0] = True
    for size in sizes:
        at = start + np.flatnonzero(reached[start : start + size] & (feature[start : start + size] >= 0))
        reached[left[at]] = reached[right[at]] = True
        start += size
    place = np.where(reached, np.cumsum(reached) - 1, -1)
    inner = feature >= 0
    return feature[reached], cut[reached], np.where(inner, place[left], -1)[reached], np.where(inner, place[right], -1)[reached], m[reached], w[reached]


class Top:
    """The splits of a tree's large nodes; the cells of its open ones go to tasks."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right, self.depth, self.sums = [-1], [0], [-1], [-1], [0], [None]
        self.open: set[int] = {0}

    def split(self, node: int, feature: int, cut: int, sums: list) -> list[int]:
        """The two new nodes. sums: of each, by output, and its weight."""
        new = [len(self.feature), len(self.feature) + 1]
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, *new
        self.sums[node] = tuple(a + b for a, b in zip(*sums))
        for own in sums:
            for values, value in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.depth, self.depth[node] + 1), (self.sums, own)):
                values.append(value)
        self.open = self.open - {node} | set(new)
        return new

    def walk(self, binned: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        while (inner := feature[at] >= 0).any():
            at = np.where(inner, np.where(binned[rows, feature[at]] <= cut[at], left[at], right[at]), at)
        return at


def _columns(batch, bins: C.Bins) -> tuple[np.ndarray, ...]:
    return C.unpacked(batch.column("bins"), np.uint16, bins.width), *(batch.column(c).to_numpy() for c in ("label", "weight", "seed", "n"))


def _node_sums(bins: C.Bins, tops: dict[tuple[int, int], Top], nodes: list[tuple[int, int, int]], tried: np.ndarray, most: int, center: np.ndarray, s: Forest):
    """(place, amount) by node, tried feature, bin and measure: outputs, weight, rows and cells. nodes: (member, tree, node)."""
    places = {}
    for k, (m, t, node) in enumerate(nodes):
        places.setdefault((m, t), {})[node] = k

    def run(batches):
        wide = s.outputs + 3
        sums = np.zeros(tried.size * most * wide)
        for batch in batches:
            member = batch.column("member").to_numpy()
            binned, label, weight, seed, n = _columns(batch, bins)
            for (m, t), own in places.items():
                drawn = np.where(member == m, C.copies(C.uniform(seed, t), n), 0)
                rows = np.flatnonzero(drawn)
                known = np.full(len(tops[m, t].feature), -1)
                known[list(own)] = list(own.values())
                node = known[tops[m, t].walk(binned[rows])]
                rows, node = rows[node >= 0], node[node >= 0]
                drawn = drawn[rows]
                output, amount = _amounts(label[rows], weight[rows] * drawn, center[m], s)
                for j in range(tried.shape[1]):
                    at = ((node * tried.shape[1] + j) * most + binned[rows, tried[node, j]]) * wide
                    for place, value in ((output, amount), (s.outputs, weight[rows] * drawn), (s.outputs + 1, drawn), (s.outputs + 2, np.ones(len(rows)))):
                        np.add.at(sums, at + place, value)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], names=["place", "amount"])

    return run


def _split_large(base: DataFrame, bins: C.Bins, sizes: list[int], most: int, center: np.ndarray, s: Forest) -> dict[tuple[int, int], Top]:
    """The tops of all trees, whose open nodes hold at most LOCAL cells."""
    tops = {(m, t): Top() for m in range(len(sizes)) for t in range(s.trees)}
    todo = [(m, t, 0) for m, t in tops if sizes[m] > LOCAL]
    k = s.outputs
    while todo:
        tried_by = [np.sort(_rng(s, t, node).permutation(len(bins.edges[m]))[: s.tried(len(bins.edges[m]))]) for m, t, node in todo]
        wide = max(len(f) for f in tried_by)
        step, later = max(1, SUMS // (wide * most * (k + 3))), []
        for first in range(0, len(todo), step):
            nodes = todo[first : first + step]
            tried = np.array([[*f, *[f[0]] * (wide - len(f))] for f in tried_by[first : first + step]])
            found = base.mapInArrow(_node_sums(bins, {(m, t): tops[m, t] for m, t, _ in nodes}, nodes, tried, most, center, s), "place long, amount double").groupBy("place").agg(F.sum("amount").alias("amount")).toArrow()
            sums = np.bincount(found.column("place").to_numpy(), found.column("amount").to_numpy(), tried.size * most * (k + 3)).reshape(*tried.shape, most, k + 3)
            for (m, t, node), features, own in zip(nodes, tried, sums):
                gain, cut = best_cut(own[..., :k], own[..., k], own[..., k + 1], s.leaf)
                j, top = int(gain.argmax()), tops[m, t]
                if gain[j] <= 0:
                    top.sums[node] = (own[0, :, :k].sum(axis=0), own[0, :, k].sum())
                    top.open.discard(node)
                    continue
                left, right = own[j, : cut[j] + 1].sum(axis=0), own[j, cut[j] + 1 :].sum(axis=0)
                for new, part in zip(top.split(node, int(features[j]), int(cut[j]), [(v[:k], v[k]) for v in (left, right)]), (left, right)):
                    if part[k + 2] > LOCAL and top.depth[new] >= s.depth:
                        top.open.discard(new)
                    elif part[k + 2] > LOCAL:
                        later.append((m, t, new))
        todo = later
    return tops


def _dealt(bins: C.Bins, parts: list[tuple[int, list[int], int]], tops: dict[tuple[int, int], Top]):
    """Each cell once for each part that grows from it: all of a member's for whole trees, and those that a tree drew for its open nodes."""
    whole, below = [], {}
    for k, (m, trees, node) in enumerate(parts):
        if (m, trees[0]) in tops:
            below.setdefault((m, trees[0]), np.full(len(tops[m, trees[0]].feature), -1, np.int32))[node] = k
        else:
            whole.append((k, m))

    def run(batches):
        for batch in batches:
            member = batch.column("member").to_numpy()
            binned, _, _, seed, n = _columns(batch, bins)
            rows_of = {m: np.flatnonzero(member == m) for m in np.unique(member)}

            def found():
                for k, m in whole:
                    if m in rows_of:
                        yield rows_of[m], np.full(len(rows_of[m]), k, np.int32)
                for (m, t), known in below.items():
                    if m in rows_of:
                        own = rows_of[m][C.copies(C.uniform(seed[rows_of[m]], t), n[rows_of[m]]) > 0]
                        part = known[tops[m, t].walk(binned[own])]
                        yield own[part >= 0], part[part >= 0]

            for own, part in found():
                taken = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(part), *[taken.column(c) for c in ("bins", "label", "weight", "seed", "n")]], names=["part", "bins", "label", "weight", "seed", "n"])

    return run


def _grown(bins: C.Bins, parts: list[tuple[int, list[int], int]], depths: list[int], most: int, center: np.ndarray, s: Forest):
    """The nodes of what grows from a part's cells."""

    def run(key, table):
        k = key[0].as_py()
        m, trees, top = parts[k]
        binned, label, weight, seed, n = _columns(table, bins)
        order = np.lexsort((label, weight, seed))  # sums do not depend on how rows arrive
        binned, label, weight, seed, n = (v[order] for v in (binned, label, weight, seed, n))
        drawn = C.copies(np.stack([C.uniform(seed, t) for t in trees], axis=1), n)
        out = []
        for t, own in zip(trees, drawn.T):
            rows = np.flatnonzero(own)
            weights = weight[rows] * own[rows]
            feature, cut, left, right, sums, cover = grow(binned[rows], most, *_amounts(label[rows], weights, center[m], s), weights, own[rows], len(bins.edges[m]), s.depth - depths[k], _rng(s, t, top), s)
            fixed = [np.full(len(feature), v, np.int32) for v in (m * s.trees + t, top)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(feature) + 1, dtype=np.int32) * s.outputs), pa.array(sums.ravel()))
            out.append(pa.Table.from_arrays([*map(pa.array, fixed), *[pa.array(v.astype(np.int32)) for v in (np.arange(len(feature)), feature, cut, left, right)], pa.array(cover), flat], names=["tree", "top", "id", "feature", "cut", "left", "right", "cover", "value"]))
        return pa.concat_tables(out)

    return run


def _assembled(found: pa.Table, member: int, tops: dict[tuple[int, int], Top], bins: C.Bins, center: np.ndarray, s: Forest) -> Trees:
    """A member's trees: its tops, with what has grown below."""
    take = lambda c: found.column(c).to_numpy()
    order = np.lexsort((take("id"), take("top"), take("tree")))
    feature, cut, left, right = (take(c)[order].astype(np.int64) for c in ("feature", "cut", "left", "right"))
    cover, sums = take("cover")[order], np.array(found.column("value").combine_chunks().flatten()).reshape(-1, s.outputs)[order]
    tree, top = take("tree")[order] - member * s.trees, take("top")[order]
    starts = np.flatnonzero(take("id")[order] == 0)
    shift = np.repeat(starts, np.diff([*starts, len(order)]))
    left, right = (np.where(feature >= 0, v + shift, -1) for v in (left, right))
    roots, known = np.zeros(s.trees, np.int64), {(int(tree[k]), int(top[k])): int(k) for k in starts}
    more: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "cover": [], "sums": []}
    for t in range(s.trees):
        own, place = tops[member, t], {}
        for node in range(len(own.feature)):
            place[node] = known[t, node] if (t, node) in known else len(feature) + len(more["feature"])
            if (t, node) not in known:
                m, w = own.sums[node] or (np.zeros(s.outputs), 0.0)
                for name, value in (("feature", own.feature[node]), ("cut", own.cut[node]), ("left", node), ("right", node), ("cover", w), ("sums", m)):
                    more[name].append(value)
        for node, at in place.items():
            if at >= len(feature):
                inner = own.feature[node] >= 0
                more["left"][at - len(feature)], more["right"][at - len(feature)] = (place[own.left[node]], place[own.right[node]]) if inner else (-1, -1)
        roots[t] = place[0]
    if more["feature"]:
        feature, cut, left, right, cover = (np.concatenate([v, np.array(more[name], v.dtype)]) for v, name in ((feature, "feature"), (cut, "cut"), (left, "left"), (right, "right"), (cover, "cover")))
        sums = np.concatenate([sums, np.stack(more["sums"])])
    inner, threshold = feature >= 0, np.zeros(len(feature))
    for f, edges in enumerate(bins.edges[member]):
        at = np.flatnonzero(feature == f)
        threshold[at] = np.append(edges, np.inf)[np.minimum(cut[at], len(edges))]  # beyond all cuts only missing values go right
    value = np.where(inner[:, None], 0.0, sums / np.maximum(cover, 1e-300)[:, None] / s.trees)
    return Trees(roots, np.maximum(feature, 0), threshold, left, right, np.zeros(len(feature), bool), value, cover, np.zeros(s.outputs) if s.classes else center[member : member + 1])


def fit(data: DataFrame, members: int, s: Forest) -> list[Trees]:
    """data: (member int, x array<double>, label double, weight double, seed long), x of one length in each member. NaN and null are missing. Outputs are shares of classes, or the number."""
    data = data.select("member", F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x"), "label", "weight", "seed")
    bins = C.edges(data, members, s.bins)
    base = C.saved(C.counted(data, bins), "forest")
    sizes, center = [0] * members, np.zeros(members)
    for r in base.groupBy("member").agg(F.count("*").alias("cells"), (F.sum(F.col("weight") * F.col("n") * F.col("label")) / F.sum(F.col("weight") * F.col("n"))).alias("mean")).collect():  # a row a member
        sizes[r["member"]], center[r["member"]] = r["cells"], 0.0 if s.classes else r["mean"]
    most = int(bins.missing.max()) + 1
    tops = _split_large(base, bins, sizes, most, center, s)
    block = -(-s.trees // PARTS)
    parts = [(m, [*range(t, min(t + block, s.trees))], 0) for m in range(members) if sizes[m] <= LOCAL for t in range(0, s.trees, block)]
    parts += [(m, [t], node) for (m, t), top in tops.items() if sizes[m] > LOCAL for node in sorted(top.open)]
    large = {key: top for key, top in tops.items() if sizes[key[0]] > LOCAL}
    depths = [tops[m, trees[0]].depth[node] for m, trees, node in parts]
    nodes = base.mapInArrow(_dealt(bins, parts, large), _CELL).groupBy("part").applyInArrow(_grown(bins, parts, depths, most, center, s), _NODE)
    nodes = C.saved(nodes.withColumn("member", F.floor(F.col("tree") / s.trees).cast("int")), "forest")
    base.unpersist()
    try:
        return [_assembled(nodes.where(F.col("member") == m).drop("member").toArrow(), m, tops, bins, center, s) for m in range(members)]
    finally:
        nodes.unpersist()


class Forested(Boosted):
    """A fitted forest: its outputs are shares of classes, or the number."""

    link = staticmethod(lambda margin, classes: margin)
