"""NaN and infinities are missing in every numeric statistic."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import association as A
from sparkloom.operators import common, features, normality, quality, stats

BAD = [float("nan"), float("inf"), float("-inf"), None]


@pytest.fixture(scope="module")
def tables(spark):
    """A table with values that are no numbers, and the same with nulls in their place."""
    rng = random.Random(4)
    rows = []
    for k in range(400):
        x = rng.gauss(0, 1)
        rows.append((k, x, 2 * x + rng.gauss(0, 0.1), float(rng.randrange(6)), "ab"[k % 2]))
    odd = [(k, *(BAD[rng.randrange(4)] if rng.random() < 0.2 else v for v in row), c) for k, *row, c in rows]
    clean = [(k, *(v if v is not None and math.isfinite(v) else None for v in row), c) for k, *row, c in odd]
    return [spark.createDataFrame(r, "id long, x double, y double, z double, c string").repartition(3).persist() for r in (odd, clean)]


def same(a, b):
    plain = lambda v: "-" if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    rows = lambda df: sorted(str([plain(v) for v in r]) for r in df.collect())
    assert rows(a) == rows(b)


def test_known_values(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, float("nan"), float("inf"), float("-inf"))], "v double")
    r = stats.numeric_summary(df).first()
    assert (r["count"], r["missing"], r["mean"], r["q1"], r["median"], r["q3"], r["min"], r["max"]) == (4, 3, 2.5, 1.75, 2.5, 3.25, 1.0, 4.0)
    bins = stats.histogram(df, "v").collect()
    assert sum(b["n"] for b in bins) == 4 and (min(b["low"] for b in bins), max(b["high"] for b in bins)) == (1.0, 4.0)
    assert stats.numeric_summary(df.where(F.isnan("v"))).first()["count"] == 0
    assert stats.histogram(df.where(F.isnan("v")), "v").count() == 0 and stats.outliers(df.where(F.isnan("v"))).count() == 0


@pytest.mark.parametrize("exact", [True, False])
def test_summary(tables, exact):
    same(*[stats.numeric_summary(t, ["x", "y", "z"], exact=exact) for t in tables])


@pytest.mark.parametrize("measure", [
    lambda t: stats.outliers(t, ["x", "y", "z"]), lambda t: stats.histogram(t, "x"), lambda t: stats.kde(t, "x"), lambda t: A.pearson(t, ["x", "y", "z"]), lambda t: A.spearman(t, "x", "z"), lambda t: A.spearman_matrix(t, ["x", "y", "z"]),
    lambda t: A.high_pairs(t, ["x", "y", "z"]), lambda t: A.correlation_ratio(t, "c", "x"), lambda t: common.mean_ranks(t, "z"), lambda t: common.cumulative(common.mean_ranks(t, "z"), "value", ["n"]), lambda t: normality.shapiro(t, "x"),
    lambda t: quality.missing_columns(t), lambda t: quality.missing_per_row(t, "id"), lambda t: quality.missing_totals(t, "id"), lambda t: features.expand_features(t, features.make_spec(t, ["x", "z", "c"]), ["id"]),
])
def test_as_if_null(tables, measure):
    same(*[measure(t) for t in tables])


def test_quantiles_and_medians(tables):
    odd, clean = [common.exact_quantiles(t, {"x": F.col("x"), "z": F.col("z")}, [0.1, 0.5, 0.9]) for t in tables]
    assert odd == clean
    assert [features.medians(features.expand_features(t, features.make_spec(t, ["x"]), []), ["x"]) for t in tables][0] == features.medians(tables[1], ["x"])
