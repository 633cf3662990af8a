"""Statistics of many columns in a fixed number of jobs, equal to those of each column alone."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest

from sparkloom.engine import Engine
from sparkloom.operators import normality as N
from sparkloom.operators import stats as S


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    columns = {
        "plain": r.normal(size=200), "skew`ed": r.exponential(size=200) * 1e6, "few": r.integers(0, 4, 200).astype(float), "same": np.full(200, 7.0),
        "holes": np.where(r.random(200) < 0.9, np.nan, r.normal(size=200)), "ties": np.round(r.normal(size=200), 1),
    }
    names = list(columns)
    rows = [tuple(float(v) for v in row) for row in np.column_stack(list(columns.values()))]
    return spark.createDataFrame(rows, [n.replace("`", "_") for n in names]).repartition(3), {n.replace("`", "_"): v[~np.isnan(v)] for n, v in columns.items()}


def test_histograms(spark, table):
    df, values = table
    got: dict = {}
    for r in S.histograms(df, list(values)).collect():
        got.setdefault(r["column"], {})[r["bin"]] = r["n"]
    for c, v in values.items():
        bins = int(min(30, max(5, len(v) ** 0.5)))
        lo, hi = (v.min() - 0.5, v.max() + 0.5) if v.min() == v.max() else (v.min(), v.max())
        assert [got[c][k] for k in range(bins)] == np.histogram(v, bins, (lo, hi))[0].tolist() and len(got[c]) == bins
    assert S.histograms(df.limit(0), list(values)).count() == 0 and S.histograms(df, []).count() == 0


def test_densities(table):
    df, values = table
    got: dict = {}
    for r in S.densities(df, list(values)).collect():
        got.setdefault(r["column"], {})[r["k"]] = (r["x"], r["y"])
    assert set(got) == {"plain", "skew_ed", "ties"}
    for c, points in got.items():
        v = values[c]
        h = v.std(ddof=1) * len(v) ** -0.2
        for k, x in enumerate(np.linspace(v.min(), v.max(), 80)):
            y = np.exp(-(((x - v) / h) ** 2) / 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))
            assert points[k] == (pytest.approx(x, abs=1e-9 * np.ptp(v)), pytest.approx(y))


def test_normality(table):
    df, values = table
    got = {r["column"]: r for r in N.normality(df, list(values)).collect()}
    assert set(got) == set(values) - {"same"}
    for c, r in got.items():
        w, p = N.shapiro_wilk(values[c])
        assert r["n"] == len(values[c]) and abs(r["w"] - w) < 1e-9 and abs(r["p"] - p) < 1e-6
    assert N.normality(df.limit(0), list(values)).count() == 0


def test_jobs_do_not_depend_on_the_number_of_columns(spark, table):
    df, _ = table
    found = []
    for names in (["plain", "ties"], ["plain", "ties", "skew_ed", "few", "holes", "same"]):
        spark.sparkContext.setJobGroup(f"columns-{len(names)}", "")
        for f in (S.histograms, S.densities, N.normality):
            f(df, names).collect()
        found.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"columns-{len(names)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] > 0


def test_exploration_of_a_dataset(spark, tmp_path):
    r = np.random.default_rng(1)
    lines = ["when,amount,size,note"]
    begin = dt.datetime(2024, 1, 1, 5)
    words = ["alpha", "beta", "gamma", "delta"]
    notes = []
    for k in range(120):
        notes.append(" ".join(words[int(i)] for i in r.integers(0, 4, 12)) + f" number {k}")
        lines.append(f"{(begin + dt.timedelta(days=k)).isoformat(sep=' ')},{r.normal():.6f},{r.exponential():.6f},{notes[-1]}")
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    data = Engine(spark, tmp_path / "store").ingest(str(tmp_path / "t.csv"))
    out = data.eda()
    assert {len(out["histograms"][c]) for c in ("amount", "size")} == {10} and [b["bin"] for b in out["histograms"]["amount"]] == list(range(10))
    assert [len(out["kde"][c]) for c in ("amount", "size")] == [80, 80] and out["normality"]["size"][0]["verdict"] == "normality rejected"
    count = Counter(w for n in notes for w in n.split() if len(w) > 2 and not w.isdigit())
    (text,) = out["text"]
    assert {t["token"]: t["n"] for t in text["tokens"]} == dict(count)
    (when,) = out["datetime"]
    assert when["parts"]["month"] == [{"month": m, "n": n} for m, n in sorted(Counter((begin + dt.timedelta(days=k)).month for k in range(120)).items())]
    assert when["parts"]["hour"] == [{"hour": 5, "n": 120}] and when["frequency"]["freq"] == "D"
