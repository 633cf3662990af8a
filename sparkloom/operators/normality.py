"""Shapiro-Wilk test of normality over all rows.

The statistic needs for each value the sum of normal scores over the ranks it takes. Ranks
of distinct values come from ranges (`cumulative`), a value that takes very many ranks is
dealt out in pieces, and the scores are added up where they lie.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.common import cumulative, finite, top_n

#: Ranks whose scores are added up at a time.
PIECE = 1 << 16


def _scores(first: int, last: int, n: int) -> np.ndarray:
    """Normal scores of ranks first .. last of n."""
    cdf = NormalDist().inv_cdf
    return np.array([cdf((k - 0.375) / (n + 0.25)) for k in range(first, last + 1)])


def _ends(n: int, ss: float) -> tuple[float, float, float]:
    """Weights of the last value and the one before, and the root that other scores are divided by. ss: the sum of squared scores."""
    before, last = _scores(n - 1, n, n)
    u = 1 / math.sqrt(n)
    # Coefficients of the published polynomials.
    a_last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, last / math.sqrt(ss)], u)
    a_before = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, before / math.sqrt(ss)], u)
    phi = (ss - 2 * last**2 - 2 * before**2) / (1 - 2 * a_last**2 - 2 * a_before**2)
    return float(a_last), float(a_before), math.sqrt(phi)


def _p_value(w: float, n: int) -> float:
    if n <= 11:
        g = np.polyval([0.459, -2.273], n)
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        z = (-math.log(max(g - math.log(max(1 - w, 1e-300)), 1e-300)) - mu) / sigma
    else:
        ln = math.log(n)
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
        z = (math.log(max(1 - w, 1e-300)) - mu) / sigma
    return 1 - NormalDist().cdf(z)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's 1995 approximation, for 8 values or more."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    m = _scores(1, n, n)
    last, before, root = _ends(n, float(m @ m))
    a = m / root
    a[-1], a[-2], a[0], a[1] = last, before, -last, -before
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    return w, _p_value(w, n)


def _added(batches):
    """Sums of the normal scores, and of their squares, over each row's ranks."""
    for batch in batches:
        sums = [[], []]
        for first, last, n in zip(*(batch.column(c).to_pylist() for c in ("first", "last", "n"))):
            m = _scores(first, last, n)
            sums[0].append(float(m.sum()))
            sums[1].append(float(m @ m))
        yield pa.RecordBatch.from_arrays([batch.column("column"), batch.column("d"), *[pa.array(s, pa.float64()) for s in sums]], names=["column", "d", "m", "mm"])


def normality(df: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """(column, n, w, p, verdict) from all rows of each numeric column; none for columns below 8 values or 3 distinct ones.

    The verdict says only whether normality is rejected. The approximation of p was made for
    up to 5000 values; beyond, small departures are already rejected. The number of jobs
    does not depend on that of the columns.
    """
    spark, schema = df.sparkSession, "column string, n long, w double, p double, verdict string"
    cells = F.array(*[F.struct(F.lit(c).alias("column"), finite(F.col(f"`{c}`")).alias("v")) for c in columns])
    counts = df.select(F.inline(cells)).where("v is not null").groupBy("column", "v").agg(F.count("*").alias("c"))
    heads = counts.groupBy("column").agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")).where("n >= 8 and distinct >= 3").select("column", "n", "mean").collect()
    if not heads:
        return spark.createDataFrame([], schema)
    own = F.broadcast(spark.createDataFrame(heads, "column string, n long, mean double"))  # a row for each column
    counts = counts.join(own, "column").withColumn("d", F.col("v") - F.col("mean"))
    ranked = cumulative(counts, "v", ["c"], "column")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / PIECE).cast("long")))
    pieces = ranked.select("column", "n", "d", "c", "before_c", piece.alias("k"))
    pieces = pieces.select("column", "n", "d", (F.col("before_c") + F.col("k") * PIECE + 1).alias("first"), F.least(F.col("before_c") + F.col("c"), F.col("before_c") + (F.col("k") + 1) * PIECE).alias("last"))
    added = pieces.repartition(F.xxhash64("column", "d", "first")).mapInArrow(_added, "column string, d double, m double, mm double")
    sums = {r["column"]: r for r in added.groupBy("column").agg(F.sum(F.col("d") * F.col("m")).alias("dm"), F.sum("mm").alias("ss")).collect()}
    spreads = {r["column"]: r["s"] for r in counts.groupBy("column").agg(F.sum(F.col("c") * F.col("d") * F.col("d")).alias("s")).collect()}
    ends: dict = {(r["column"], way): [] for r in heads for way in (0, 1)}
    outer = [top_n(counts.select("column", "d", "c"), 2, [order], ["column"]).withColumn("way", F.lit(way)) for way, order in enumerate((F.asc("d"), F.desc("d")))]
    for r in sorted(outer[0].unionByName(outer[1]).collect(), key=lambda r: r["rank"]):
        ends[r["column"], r["way"]] += [r["d"]] * min(r["c"], 2)
    out = []
    for r in heads:
        c, n = r["column"], r["n"]
        low, high = ends[c, 0], ends[c, 1]
        last, before, root = _ends(n, sums[c]["ss"])
        m_before, m_last = _scores(n - 1, n, n)
        # The four outermost values have weights of their own.
        b = sums[c]["dm"] / root + (last - m_last / root) * (high[0] - low[0]) + (before - m_before / root) * (high[1] - low[1])
        w = min(1.0, b * b / spreads[c])
        p = _p_value(w, n)
        out.append((c, n, float(w), float(p), "normality rejected" if p < alpha else "normality not rejected"))
    return spark.createDataFrame(out, schema)


def shapiro(df: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """One row (n, w, p, verdict) of one column, or none; see normality."""
    return normality(df, [column], alpha).drop("column")
