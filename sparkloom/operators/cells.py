"""Binned rows counted by cell, for models that see bins only.

Several members (the folds of a cross-validation and the final fit, say) lie in one table:
a row names its member. Rows of one member with equal bins, label and weight are one cell
with their number, so a table of few columns is small whatever its rows; where all rows
differ, a cell is a row. What a model draws for each row (kept or not, how often) is drawn
for a cell as the sum over its rows, by the exact distribution of that sum.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.scratch import new_folder

_BINNED = "member int, bins binary, label double, weight double, seed long"


class Bins:
    """Where each member's features are cut, and the places of their bins in one table."""

    def __init__(self, edges: list[list[np.ndarray]]):
        self.edges = edges
        width = max(len(e) for e in edges)
        self.missing = np.zeros((len(edges), width), np.int64)
        self.first = np.zeros((len(edges), width), np.int64)
        self.slots = 0
        for m, own in enumerate(edges):
            sizes = [len(e) + 2 for e in own]
            self.missing[m, : len(own)] = [s - 1 for s in sizes]
            self.first[m, : len(own)] = np.cumsum([0, *sizes[:-1]])
            self.slots = max(self.slots, sum(sizes))

    @property
    def width(self) -> int:
        return self.missing.shape[1]

    def of(self, member: int, x: np.ndarray) -> np.ndarray:
        """Bins of rows, as wide as the widest member; the last bin of a feature is that of missing values."""
        out = np.zeros((len(x), self.width), np.uint16)
        for f, edges in enumerate(self.edges[member]):
            out[:, f] = np.where(np.isnan(x[:, f]), len(edges) + 1, np.searchsorted(edges, x[:, f], side="left"))
        return out


def edges(data: DataFrame, members: int, bins: int) -> Bins:
    """At most bins - 1 cuts of each member's features, at quantiles; a cut is a value, and larger values lie to its right."""
    value = data.select("member", F.posexplode("x").alias("feature", "value")).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    rows = value.groupBy("member", "feature").agg(F.percentile_approx("value", [k / bins for k in range(1, bins)], 10_000).alias("cuts"), F.max("value").alias("most")).collect()  # a row a feature
    found: list[list[np.ndarray]] = [[] for _ in range(members)]
    for r in sorted(rows, key=lambda r: (r["member"], r["feature"])):
        cuts = np.unique(np.array(r["cuts"] or [], float))
        found[r["member"]].append(cuts[cuts < r["most"]] if r["most"] is not None else cuts)
    return Bins(found)


def _binned(bins: Bins):
    def run(batches):
        for batch in batches:
            member = batch.column("member").to_numpy()
            lists = batch.column("x")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(sizes)])
            made = np.zeros((batch.num_rows, bins.width), np.uint16)
            for m in np.unique(member):
                at = np.flatnonzero(member == m)
                made[at] = bins.of(m, values[first[at][:, None] + np.arange(len(bins.edges[m]))])
            yield pa.RecordBatch.from_arrays([batch.column("member"), packed(made), *[batch.column(c) for c in ("label", "weight", "seed")]], names=["member", "bins", "label", "weight", "seed"])

    return run


def counted(data: DataFrame, bins: Bins) -> DataFrame:
    """(member, bins, label, weight, seed, n) of each cell, from rows of (member, x, label, weight, seed)."""
    return data.mapInArrow(_binned(bins), _BINNED).groupBy("member", "bins", "label", "weight").agg(F.min("seed").alias("seed"), F.count("*").alias("n"))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder, and read from there into memory."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).persist()


def packed(rows: np.ndarray) -> pa.Array:
    """Each row of a table of numbers as bytes."""
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """What packed() made, as a table again."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset :]
    size = len(column) * width * np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2] or b"", np.uint8, size, int(offsets[0]) if size else 0).view(kind).reshape(len(column), width)


def uniform(seed: np.ndarray, stream: int) -> np.ndarray:
    """Numbers from 0 to 1 that depend on seed and stream alone."""
    x = seed.view(np.uint64) + np.uint64((stream + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _table(lowest: int, ratios: np.ndarray) -> tuple[int, np.ndarray]:
    """The smallest outcome, and the distribution function from there, of probabilities with these ratios between neighbours."""
    logs = np.concatenate([[0.0], np.cumsum(np.log(ratios))])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return lowest, sums / sums[-1]


@lru_cache(maxsize=1 << 12)
def _copies(n: int) -> tuple[int, np.ndarray]:
    """Poisson(n), up to tails beyond 12 deviations."""
    low, high = max(0, int(n - 12 * n**0.5)), int(n + 12 * n**0.5 + 30)
    return _table(low, n / np.arange(low + 1, high + 1))


@lru_cache(maxsize=1 << 12)
def _left_out(n: int, share: float) -> tuple[int, np.ndarray]:
    """Rows of n that are not taken where each is with this share, up to tails beyond 12 deviations."""
    mean, spread = n * (1 - share), 12 * (n * share * (1 - share)) ** 0.5 + 30
    low, high = max(0, int(mean - spread)), min(n, int(mean + spread))
    k = np.arange(low + 1, high + 1)
    return _table(low, (n - k + 1) / k * ((1 - share) / share))


def _by_count(u: np.ndarray, n: np.ndarray, table) -> np.ndarray:
    out = np.zeros(u.shape, np.int64)
    order = np.argsort(n, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
        low, sums = table(int(n[own[0]]))
        out[own] = low + np.searchsorted(sums, u[own], side="right")
    return out


def copies(u: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often a bootstrap (Poisson, mean 1 a row) takes the n rows of each cell; u: uniform numbers by cell, or by cell and tree."""
    return _by_count(u, n, _copies)


def taken(u: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """How many of the n rows of each cell are taken, where each row is with this share."""
    return n.copy() if share >= 1 else n - _by_count(u, n, lambda k: _left_out(k, share))
