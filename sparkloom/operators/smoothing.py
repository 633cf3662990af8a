"""Damped Holt-Winters for many series side by side, start values included in the fit.

For given smoothing parameters every one-step error is linear in the start values (level,
trend and season), so the best ones solve a least-squares problem: the recurrences run once
over the values from a zero start, and once over zero values from each unit start, as
columns of one array. Pieces of (series, grid of parameters) are dealt to tasks; then each
series goes on from its best row to the best of the neighbours, with halving steps.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where each parameter may lie: level, trend, season, damping.
BOUNDS = ((0.01, 0.99), (0.0, 0.99), (0.0, 0.99), (0.8, 0.98))
#: The grid that the search begins with.
GRID = ((0.02, 0.1, 0.2, 0.4, 0.65, 0.9), (0.0, 0.05, 0.2, 0.5), (0.0, 0.05, 0.2, 0.5), (0.8, 0.9, 0.98))
#: Steps of the rounds after the grid, by parameter in proportion to its bounds' distance.
STEPS = (0.1, 0.05, 0.025, 0.0125, 0.006)
#: Pieces that the grid is dealt to tasks in.
CHUNKS = 8
_BLOCK = 256


def seasonal(n: int, season: int | None) -> int:
    """The season's length, 0 where n values are too few for it."""
    return season if season and season > 1 and n >= 2 * season + 2 else 0


def sweep(y: np.ndarray, m: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each parameter row: the least sum of squared one-step errors over all start values, and the last level, trend and season (by place in the season) that go with it."""
    rows, columns = len(p), m + 3
    a, b, g, phi = (p[:, k : k + 1] for k in range(4))
    level, trend, season = np.zeros((rows, columns)), np.zeros((rows, columns)), np.zeros((m, rows, columns))
    level[:, 1], trend[:, 2] = 1, 1
    for k in range(m):
        season[k, :, 3 + k] = 1
    gram = np.zeros((rows, columns, columns))
    own = np.zeros(columns)
    own[0] = 1  # values go to the first column only
    for start in range(0, len(y), _BLOCK):
        part = y[start : start + _BLOCK]
        error = np.empty((rows, len(part), columns))
        for t, v in enumerate(part):
            ahead = level + phi * trend
            value = v * own
            if m:
                at = season[(start + t) % m]
                error[:, t] = value - ahead - at
                new = a * (value - at) + (1 - a) * ahead
                season[(start + t) % m] = g * (value - new) + (1 - g) * at
            else:
                error[:, t] = value - ahead
                new = a * value + (1 - a) * ahead
            trend = b * (new - level) + (1 - b) * phi * trend
            level = new
        for x in (level, trend, season):
            x[np.abs(x) < 1e-150] = 0  # what is left of a unit start
        gram += error.transpose(0, 2, 1) @ error
    begin = np.ones((rows, columns))
    for k in range(rows):
        begin[k, 1:] = np.linalg.lstsq(gram[k, 1:, 1:], -gram[k, 1:, 0], rcond=1e-11)[0]
    total = np.einsum("pi,pij,pj->p", begin, gram, begin)
    return np.maximum(total, 0), (level * begin).sum(axis=1), (trend * begin).sum(axis=1), (season * begin).sum(axis=2)


def candidates(m: int, best: np.ndarray | None, step: float) -> np.ndarray:
    """Parameter rows of a round: the grid, or the neighbours of the best row."""
    if best is None:
        return np.array(list(product(GRID[0], GRID[1], GRID[2] if m else (0.0,), GRID[3])))
    moves = np.array(list(product((0, -1, 1), (0, -1, 1), (0, -1, 1) if m else (0,), (0, -1, 1))))
    low, high = np.array(BOUNDS).T
    return np.unique(np.clip(best + moves * step * (high - low), low, high), axis=0)


def _standard(y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Values less their mean and by their spread: forecasts follow shifts and scales of the values."""
    mean, spread = float(y.mean()), float(y.std())
    return (y - mean) / (spread or 1.0), mean, spread or 1.0


def _arrays(column) -> list[np.ndarray]:
    return [np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=float) for x in column]


def _best(y: np.ndarray, m: int, rows: np.ndarray) -> tuple[float, list[float]]:
    total = sweep(y, m, rows)[0]
    k = min(range(len(rows)), key=lambda i: (total[i], tuple(rows[i])))
    return float(total[k]), rows[k].tolist()


def _try_grid(season: int | None, names: list[str]):
    """The best of each chunk of the grid."""

    def run(batches):
        for batch in batches:
            found = []
            for y, chunk in zip(_arrays(batch.column("ys")), batch.column("chunk").to_pylist()):
                m = seasonal(len(y), season)
                rows = candidates(m, None, 0)[chunk::CHUNKS]
                found.append(_best(_standard(y)[0], m, rows))
            yield pa.RecordBatch.from_arrays([batch.column("series"), batch.column("ys"), *_columns(found)], names=names)

    return run


def _refine(season: int | None, names: list[str]):
    """From the best row of the grid to that of its neighbours, with smaller and smaller steps."""

    def run(batches):
        for batch in batches:
            found = []
            for y, p in zip(_arrays(batch.column("ys")), batch.column("p").to_pylist()):
                m, y = seasonal(len(y), season), _standard(y)[0]
                for step in STEPS:
                    total, p = _best(y, m, candidates(m, np.array(p), step))
                found.append((total, p))
            yield pa.RecordBatch.from_arrays([batch.column("series"), batch.column("ys"), *_columns(found)], names=names)

    return run


def _columns(found: list) -> list:
    return [pa.array([e for e, _ in found], pa.float64()), pa.array([p for _, p in found], pa.list_(pa.float64()))]


def _ahead(season: int | None, periods: int):
    def run(batches):
        for batch in batches:
            out = []
            for y, p in zip(_arrays(batch.column("ys")), batch.column("p").to_pylist()):
                m = seasonal(len(y), season)
                values, mean, spread = _standard(y)
                _, level, trend, seasons = sweep(values, m, np.array([p]))
                h = np.arange(1, periods + 1)
                guess = level[0] + np.cumsum(p[3] ** h) * trend[0] + (seasons[(len(y) + h - 1) % m, 0] if m else 0.0)
                out.append(mean + spread * guess)
            yield pa.RecordBatch.from_arrays([batch.column("series"), pa.array(out, pa.list_(pa.float64()))], names=["series", "ahead"])

    return run


def fit(series: DataFrame, season: int | None, by: tuple[str, ...] = ()) -> DataFrame:
    """(series, ys, sse, p): the values of each series in time order, and the parameters (level, trend, season, damping) with the least squared error of its standardised values.

    series has ts, y and the columns `by` that tell series apart. Rows with null y or ts are
    left out; a series without values has no row. A series is one array of at most
    max_periods values; a task tries a piece of the grid for one series at a time.
    """
    name = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    rows = series.where(F.col("ts").isNotNull() & F.col("y").isNotNull()).select(name.alias("series"), "ts", F.col("y").cast("double").alias("y"))
    values = rows.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "y"))), lambda r: r["y"]).alias("ys"))
    names = ["series", "ys", "sse", "p"]
    kind = T.StructType([values.schema["series"], T.StructField("ys", T.ArrayType(T.DoubleType())), T.StructField("sse", T.DoubleType()), T.StructField("p", T.ArrayType(T.DoubleType()))])
    dealt = values.select("series", "ys", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))).alias("chunk")).repartition(F.xxhash64("series", "chunk"))
    tried = dealt.mapInArrow(_try_grid(season, names), kind)
    best = tried.groupBy("series").agg(F.any_value("ys").alias("ys"), F.min(F.struct("sse", "p")).alias("b")).select("series", "ys", "b.p")
    return best.mapInArrow(_refine(season, names), kind)


def forecast(fitted: DataFrame, season: int | None, periods: int) -> DataFrame:
    """(series, step, y) after each fitted series; steps from 1."""
    kind = T.StructType([fitted.schema["series"], T.StructField("ahead", T.ArrayType(T.DoubleType()))])
    return fitted.select("series", "ys", "p").mapInArrow(_ahead(season, periods), kind).select("series", F.posexplode("ahead").alias("step", "y")).select("series", (F.col("step") + 1).alias("step"), "y")
