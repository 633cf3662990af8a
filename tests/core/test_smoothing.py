"""Holt-Winters: start values against a numeric search, parameters against plain recurrences, many series against each alone."""

import datetime as dt

import numpy as np
import pytest

from sparkloom.operators import forecast as FC
from sparkloom.operators import smoothing as SM


def plain(y, m, p, level, trend, season):
    """Squared error and last state from given start values."""
    a, b, g, phi = p
    season, error = list(season), 0.0
    for t, v in enumerate(y):
        s = season[t % m] if m else 0.0
        error += (v - level - phi * trend - s) ** 2
        old, level = level, a * (v - s) + (1 - a) * (level + phi * trend)
        trend = b * (level - old) + (1 - b) * phi * trend
        if m:
            season[t % m] = g * (v - level) + (1 - g) * s
    return error, level, trend, season


def rough(y, m, p):
    """Start values from the first two seasons."""
    level = float(y[: max(m, 1)].mean())
    return plain(y, m, p, level, float((y[m : 2 * m].mean() - y[:m].mean()) / m) if m else 0.0, (y[:m] - level) if m else [])[0]


def wave(n, m, seed=0, slope=0.2):
    r = np.random.default_rng(seed)
    return 50 + slope * np.arange(n) + 8 * np.sin(2 * np.pi * np.arange(n) / max(m, 2)) + r.normal(size=n)


@pytest.mark.parametrize("n,m", [(40, 7), (33, 0), (600, 12), (3, 0), (16, 7)])
def test_start_values_are_the_best(n, m):
    y = wave(n, m)
    p = np.array([[0.3, 0.1, 0.2, 0.9], [0.02, 0.0, 0.0, 0.98], [0.9, 0.5, 0.5, 0.8]])
    total, level, trend, season = SM.sweep(y, m, p)
    for k in range(len(p)):
        unit = np.eye(m + 2)
        at = lambda x: plain(y, m, p[k], x[0], x[1], x[2:])[0]  # noqa: B023, E731
        zero = np.zeros(m + 2)
        # The error is a quadratic form: its gradient at the best start is 0.
        base, grad = at(zero), np.array([(at(u) - at(-u)) / 2 for u in unit])
        hess = np.array([[at(u + v) - at(u) - at(v) + base for v in unit] for u in unit])
        best = np.linalg.lstsq(hess, -grad, rcond=1e-10)[0]
        wanted = plain(y, m, p[k], best[0], best[1], best[2:])
        assert total[k] == pytest.approx(wanted[0], rel=1e-6, abs=1e-6)
        assert total[k] <= rough(y, m, p[k]) + 1e-9
        ahead = lambda lv, tr, se: lv + p[k][3] * tr + (se[n % m] if m else 0)  # noqa: B023, E731
        assert ahead(level[k], trend[k], season[:, k]) == pytest.approx(ahead(*wanted[1:]), rel=1e-4)


def test_search_reaches_the_best_of_a_fine_grid():
    y = SM._standard(wave(90, 7, 3))[0]
    best, step = None, 0.0
    for step in (0.0, *SM.STEPS):
        rows = SM.candidates(7, best, step)
        total = SM.sweep(y, 7, rows)[0]
        best, found = rows[int(total.argmin())], float(total.min())
    fine = np.array([(a, b, g, f) for a in np.linspace(0.01, 0.99, 12) for b in np.linspace(0, 0.99, 7) for g in np.linspace(0, 0.99, 7) for f in (0.8, 0.86, 0.92, 0.98)])
    assert found <= SM.sweep(y, 7, fine)[0].min() * 1.001
    low, high = np.array(SM.BOUNDS).T
    assert (best >= low).all() and (best <= high).all()


def test_many_series(spark):
    begin = dt.datetime(2024, 1, 1)
    series = {"a": wave(60, 7, 1), "b": wave(45, 7, 2, -0.5), None: wave(9, 7, 4), "flat": np.full(30, 5.0), "one": np.array([3.0])}
    rows = [(k, begin + dt.timedelta(days=i), float(v)) for k, y in series.items() for i, v in enumerate(y)] + [("a", None, 1.0), ("gone", begin, None)]
    df = spark.createDataFrame(rows, "shop string, ts timestamp_ntz, y double").repartition(3)
    out = {}
    for r in FC.ets(df, "D", 14, 7, ("shop",)).collect():
        out.setdefault(r["shop"], {})[r["step"]] = (r["ts"], r["y"])
    assert set(out) == set(series)
    for k, y in series.items():
        assert sorted(out[k]) == list(range(1, 15)) and out[k][1][0] == begin + dt.timedelta(days=len(y))
        alone = FC.ets(df.where(df["shop"].eqNullSafe(k)), "D", 14, 7) if k == "b" else None
        for r in alone.collect() if alone is not None else []:
            assert out[k][r["step"]] == (r["ts"], pytest.approx(r["y"]))
    assert all(v == pytest.approx(5.0) for _, v in out["flat"].values()) and all(v == pytest.approx(3.0) for _, v in out["one"].values())
    true = 50 + 0.2 * np.arange(60, 67) + 8 * np.sin(2 * np.pi * np.arange(60, 67) / 7)
    assert np.abs(np.array([out["a"][s][1] for s in range(1, 8)]) - true).max() < 4
    assert FC.ets(df.limit(0), "D", 3, 7, ("shop",)).count() == 0 and FC.ets(df.limit(0), "D", 3, None).count() == 0


def test_business_days(spark):
    days = [d for d in (dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)) if d.weekday() < 5]
    df = spark.createDataFrame([(s, d, float(i + 10 * s)) for s in (1, 2) for i, d in enumerate(days[: 20 + s])], "s int, ts timestamp_ntz, y double")
    got = sorted((r["s"], r["step"], r["ts"]) for r in FC.ets(df, "B", 5, None, ("s",)).collect())
    assert got == [(s, k + 1, days[20 + s + k]) for s in (1, 2) for k in range(5)]
