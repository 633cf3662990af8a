"""Hard negatives of anchors, from exact integer scores of tiles by Strassen's multiplication.

Anchors go to the executors in blocks of a fixed size, candidates are read where they
lie. In a task, a tile of anchors by candidates is one product of int64 matrices, made
by Strassen's recursion: both sides are padded with zeros to even sizes, seven products
of halves take the place of eight, and sums are exact (what wraps around on the way
unwraps in the end, as scores fit). Two passes over the candidates follow: one keeps for
each anchor the best candidates of its label, one keeps for each of these positives the
best of other labels inside the positive's window. What a task keeps is a heap of fixed
size, and heaps of tasks merge by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.session import written

#: Anchors of a block times their components: 8 MB.
BLOCK_CELLS = 1 << 20
#: Anchors and candidates of a tile.
TILE_ANCHORS, TILE_CANDIDATES = 256, 2048
#: Products with a side of this size or less are not split further.
LEAF = 8
#: dims * largest component ** 2 is at most this, so that a hundred times any score fits in 64 bits.
LARGEST = 1 << 56


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6, p7 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _matrix(column) -> np.ndarray:
    """Rows of a list column whose lists are of one size."""
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


class Heaps:
    """The first `size` of (score, id) for each key: highest score first, equal ones by smaller id."""

    def __init__(self, size: int):
        self.size, self.kept = size, {}

    def least(self, key) -> int | None:
        """The lowest score that still matters, once the heap is full."""
        own = self.kept.get(key)
        return None if own is None or own.shape[1] < self.size else int(own[0, -1])

    def add(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.size:  # what is under the size-th score goes before the sort
            at = np.flatnonzero(scores >= np.partition(scores, len(scores) - self.size)[len(scores) - self.size])
            scores, ids = scores[at], ids[at]
        if len(scores):
            own = np.stack([scores, ids])
            if key in self.kept:
                own = np.concatenate([self.kept[key], own], axis=1)
            self.kept[key] = own[:, np.lexsort((own[1], -own[0]))[: self.size]]

    def rows(self) -> pa.RecordBatch:
        keys = np.repeat(np.array(list(self.kept), np.int64), [x.shape[1] for x in self.kept.values()])
        scores, ids = np.concatenate(list(self.kept.values()), axis=1) if self.kept else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(scores)], names=["key", "vec_id", "score"])


def _tiles(batches, anchors: np.ndarray):
    """(first anchor, scores, ids, labels) of each tile."""
    for batch in batches:
        for k in range(0, batch.num_rows, TILE_CANDIDATES):
            own = batch.slice(k, TILE_CANDIDATES)
            side = np.ascontiguousarray(_matrix(own.column("v")).T)
            ids, labels = (own.column(c).to_numpy() for c in ("vec_id", "label"))
            for first in range(0, len(anchors), TILE_ANCHORS):
                yield first, strassen(anchors[first : first + TILE_ANCHORS], side), ids, labels


def _positives(shared, size: int):
    """Heaps of rows of the anchors' labels, by the anchor's place in its block."""

    def run(batches):
        ids_of, labels_of, anchors = shared.value
        heaps = Heaps(size)
        for first, tile, ids, labels in _tiles(batches, anchors):
            for k, scores in enumerate(tile, first):
                ok = (labels == labels_of[k]) & (ids != ids_of[k])
                if (least := heaps.least(k)) is not None:
                    ok &= scores >= least
                heaps.add(k, scores[ok], ids[ok])
        yield heaps.rows()

    return run


def _negatives(shared, size: int, low: int, high: int):
    """Heaps of rows of other labels inside each positive's window, by the positive's place in its block."""

    def run(batches):
        labels_of, anchors, windows = shared.value  # windows: for each anchor, [(place, positive's score)]
        heaps = Heaps(size)
        for first, tile, ids, labels in _tiles(batches, anchors):
            for k, scores in enumerate(tile, first):
                other = np.flatnonzero(labels != labels_of[k]) if windows[k] else ()
                hundred = 100 * scores[other] if len(other) else other
                for place, positive in windows[k] if len(other) else ():
                    ok = (hundred >= low * positive) & (hundred <= high * positive)
                    if (least := heaps.least(place)) is not None:
                        ok &= hundred >= 100 * least
                    at = other[ok]
                    heaps.add(place, scores[at], ids[at])
        yield heaps.rows()

    return run


class HardNegatives:
    """For each anchor its best rows of the same label, and for each of these the best rows of other labels in a window under it.

    Components become floor(scale * x); scores are integer inner products. Rows without a
    vec_id, label or vector take no part, nor do those with null or non-finite components,
    none at all, or so large ones that a hundred times a score may not fit in 64 bits
    (LARGEST). Vectors meet only those with as many components. Rows are judged one by
    one: repeated rows are candidates each, a row is no candidate of anchors of its own
    vec_id, and each different row of an anchor's vec_id is an anchor with results of its own
    (equal rows are one). Ties go to the smaller vec_id. An anchor without positives, and a positive without rows in its
    window, give no rows. Further columns are ignored.

    Anchors are read in blocks of BLOCK_CELLS components; each block is compared with all
    rows in two jobs, whatever the rows' number, and its results are written.
    """

    def __init__(self, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256):
        """low, high: the window, in hundredths of the positive's score."""
        if min(positives, negatives, scale) < 1 or not 0 <= low <= high <= 100:
            raise ValueError("sizes are at least 1 and 0 <= low <= high <= 100")
        self.positives, self.negatives, self.low, self.high, self.scale = positives, negatives, low, high, scale

    def rows(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, label, dims, v) of the rows that take part."""
        x = F.col("embedding")
        fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(float(LARGEST))))
        scaled = F.transform(x, lambda c: F.floor(c.cast("double") * self.scale).cast("long"))
        most = F.array_max(F.transform("v", F.abs)).cast("double")
        out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
        out = out.where("vec_id is not null and label is not null and size(embedding) > 0").where(fine).select("vec_id", "label", F.size("embedding").alias("dims"), scaled.alias("v"))
        return out.where(most * most * F.col("dims") <= float(LARGEST))

    def _block(self, rows: DataFrame, anchors: DataFrame) -> DataFrame:
        """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for one block."""
        spark = rows.sparkSession
        sc, block = spark.sparkContext, sorted((r["vec_id"], r["label"], r["v"]) for r in anchors.collect())  # BLOCK_CELLS components
        ids, labels, matrix = np.array([r[0] for r in block]), np.array([r[1] for r in block]), np.array([r[2] for r in block], np.int64)
        first = lambda df, size: df.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= size)
        heap = "key long, vec_id long, score long"
        found = first(rows.mapInArrow(_positives(sc.broadcast((ids, labels, matrix)), self.positives), heap), self.positives)
        pairs = sorted((r["key"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())  # `positives` rows an anchor
        windows: list[list[tuple[int, int]]] = [[] for _ in block]
        for place, (k, _, _, score) in enumerate(pairs):
            windows[k].append((place, score))
        own = first(rows.mapInArrow(_negatives(sc.broadcast((labels, matrix, windows)), self.negatives, self.low, self.high), heap), self.negatives)
        named = spark.createDataFrame([(place, int(ids[k]), i, score) for place, (k, _, i, score) in enumerate(pairs)], "key long, anchor_id long, positive_id long, positive_score long")
        return own.join(named, "key").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

    def run(self, vectors: DataFrame, is_anchor: Column) -> DataFrame:
        """vectors: (vec_id, label, embedding). is_anchor: a condition on vec_id and label."""
        rows = written(self.rows(vectors))
        anchors = rows.where(is_anchor).distinct()
        out = None
        for dims, count in sorted((r["dims"], r["count"]) for r in anchors.groupBy("dims").count().collect()):  # a row for each number of components
            mine, blocks = anchors.where(F.col("dims") == dims), -(-count * dims // BLOCK_CELLS)
            for b in range(blocks):
                part = mine if blocks == 1 else mine.where(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)) == b)
                own = self._block(rows.where(F.col("dims") == dims), part)
                own = own if blocks == 1 else written(own)
                out = own if out is None else out.unionByName(own)
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out
