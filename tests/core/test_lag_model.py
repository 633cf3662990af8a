"""The lag model rolls forward in tasks as its Spark model would step by step."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sparkloom.operators import forecast as FC
from sparkloom.operators.trees import Trees


def series(spark, n=140):
    return spark.range(n).select(F.expr("timestamp_ntz'2023-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("ts"), (50 + 0.2 * F.col("id") + 10 * F.sin(F.col("id") * 2 * np.pi / 7) + F.sin(F.col("id") * 12.9898) * 2).alias("y"))


def test_recursion_in_a_task_equals_recursion_on_the_driver(spark, monkeypatch):
    fitted = []
    keep = FC.from_spark
    monkeypatch.setattr(FC, "from_spark", lambda model, s: (fitted.append(model), keep(model, s))[1])
    s = series(spark)
    model = FC.LagModel(7, trees=8, depth=3, rate=0.3).fit(s)
    stamps = FC.future_stamps(s, "D", 20)
    got = [(r["step"], r["ts"], r["y"]) for r in model.forecast(stamps).orderBy("step").collect()]
    y, want = list(model.tail), []
    for r in stamps.select("step", "ts", *FC._calendar(F.col("ts"))).orderBy("step").collect():
        x = [y[-k] for k in model.lags] + [float(np.mean(y[-w:])) for w in model.widths] + [float(r[c]) for c in FC._PARTS]
        y.append(float(fitted[0].predict(Vectors.dense(x))))
        want.append((r["step"], r["ts"], y[-1]))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    weights = model.importances()
    assert set(weights) == set(model.inputs) and abs(sum(weights.values()) - 1) < 1e-9 and list(weights.values()) == sorted(weights.values(), reverse=True)
    assert next(iter(weights)) in ("lag_7", "lag_14")


def test_series_roll_side_by_side():
    split = Trees(np.array([0]), np.array([0, 0, 0]), np.array([2.0, 0, 0]), np.array([1, -1, -1]), np.array([2, -1, -1]), np.zeros(3, bool), np.array([[0.0], [10.0], [1.0]]), np.ones(3), np.zeros(1))
    parts = np.zeros((2, 3, 4))
    assert FC.roll(split, [1], [2], np.array([[0.0, 1.0], [0.0, 5.0]]), parts).tolist() == [[10.0, 1.0, 10.0], [1.0, 10.0, 1.0]]


def test_leaderboard_reports_importances(spark):
    r = FC.train(series(spark, 200).withColumnRenamed("ts", "date"), "date", "y", season=7, horizon=5, trees=4, keys=("naive", "lag_gbt"))
    row = next(m for m in r["models"] if m["key"] == "lag_gbt")
    assert row["status"] == "ok" and abs(sum(row["importances"].values()) - 1) < 1e-9 and r["future"].count() == 5


def test_another_process_forecasts_from_a_stored_run(spark, tmp_path):
    """An engine over the same folder goes on from what the first one saved, with the leader's model or another."""
    import csv

    from sparkloom.engine import Engine

    rows = [(str(r["ts"])[:10], f"{r['y']:.3f}") for r in series(spark, 160).orderBy("ts").collect()]
    with open(tmp_path / "s.csv", "w", newline="") as f:
        csv.writer(f).writerows([("day", "sales"), *rows])
    engine = Engine(spark, tmp_path / "store")
    for keys in (("naive", "lag_gbt"), ("naive", "ets")):
        doc = engine.forecast(engine.ingest(str(tmp_path / "s.csv")), "day", "sales", season=7, horizon=4, trees=4, keys=keys)
        assert doc["status"] == "completed", doc.get("error")
        again = Engine(spark, tmp_path / "store")
        for key in (None, "naive"):
            first, later = ([tuple(r) for r in e.future(doc["id"], 9, key).orderBy("step").collect()] for e in (engine, again))
            assert first == later and len(first) == 9
        assert [r[2] for r in first] == [first[0][2]] * 9  # naive
