"""Forecasts of regular series: naive, seasonal naive, damped Holt-Winters, and boosted trees on lags."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.config import DEFAULT, Config
from sparkloom.operators import smoothing as SM
from sparkloom.operators import timeseries as TS
from sparkloom.operators.trees import Trees, from_spark

METRICS = ("mae", "rmse", "smape", "mape")
BASELINES = ("naive", "snaive")


def future_stamps(series: DataFrame, freq: str, periods: int, by: tuple[str, ...] = ()) -> DataFrame:
    """([by columns,] step, ts) of the periods after the last one, of each series."""
    if not 1 <= periods <= 1000:
        raise ValueError("periods must be 1 to 1000")
    keys = [F.col(f"`{c}`") for c in by]
    last = series.groupBy(*keys).agg(F.max("ts").alias("last"))
    if freq == "B":
        days = last.select(*keys, "last", F.explode(F.sequence(F.lit(1), F.lit(periods * 2 + 4))).alias("k")).select(*keys, F.expr("last + make_interval(0, 0, 0, k)").cast("timestamp_ntz").alias("ts")).where(F.weekday("ts") < 5)
        step = F.row_number().over(Window.partitionBy(*keys).orderBy("ts"))  # 2 periods + 4 days a series
        return days.select(*keys, step.alias("step"), "ts").where(F.col("step") <= periods)
    steps = last.select(*keys, F.posexplode(F.sequence(F.col("last"), F.col("last") + TS.interval(freq) * periods, TS.interval(freq))).alias("step", "ts"))
    return steps.where("step > 0").select(*keys, "step", "ts")


def naive(series: DataFrame, freq: str, periods: int) -> DataFrame:
    """(step, ts, y): the last value."""
    last = series.agg(F.max_by("y", "ts").alias("y"))
    return future_stamps(series, freq, periods).crossJoin(F.broadcast(last))


def seasonal_naive(series: DataFrame, freq: str, periods: int, season: int) -> DataFrame:
    """(step, ts, y): the last season, over and over."""
    n = series.count()
    tail = TS.positions(series).where(F.col("pos") >= n - season).select((F.col("pos") - (n - season)).alias("place"), "y")
    ahead = future_stamps(series, freq, periods).withColumn("place", ((F.col("step") - 1) % season).cast("long"))
    return ahead.join(F.broadcast(tail), "place").select("step", "ts", "y")


def ets(series: DataFrame, freq: str, periods: int, season: int | None, by: tuple[str, ...] = ()) -> DataFrame:
    """([by columns,] step, ts, y) by Holt-Winters with damped additive trend, and additive season where 2 m + 2 values allow; see `smoothing`.

    With `by`, a forecast for each of many series; they may end at different stamps.
    """
    values = SM.forecast(SM.fit(series, season, by), season, periods)
    values = values.select(*[F.col(f"series.`{c}`").alias(c) for c in by], "step", "y")
    stamps = future_stamps(series.where("y is not null"), freq, periods, by)
    if not by:
        return stamps.join(values, "step").select("step", "ts", "y")
    same = F.col("a.step") == F.col("b.step")
    for c in by:  # a series may be named by null
        same &= F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    return stamps.alias("a").join(values.alias("b"), same).select(*[F.col(f"a.`{c}`") for c in by], "a.step", "a.ts", "b.y")


def _calendar(ts) -> list:
    return [F.month(ts).alias("month"), F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour"), F.dayofyear(ts).alias("yearday")]


_PARTS = ("month", "weekday", "hour", "yearday")


def roll(trees: Trees, lags: list[int], widths: list[int], tails: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Forecasts of several series side by side, step by step: each feeds the lags of later ones. tails: the last values by series; parts: calendar parts by series and step."""
    y = np.array(tails, dtype=float)
    for step in range(parts.shape[1]):
        x = np.column_stack([*[y[:, -k] for k in lags], *[y[:, -w:].mean(axis=1) for w in widths], parts[:, step]])
        y = np.column_stack([y, trees.predict(x)[:, 0]])
    return y[:, len(tails[0]) :]


class LagModel:
    """Gradient-boosted trees on lags, rolling means and calendar, applied recursively.

    Fitting is distributed. The fitted trees are arrays that go to the tasks once, and a
    task rolls whole series forward.
    """

    def __init__(self, season: int | None, trees: int = 300, depth: int = 4, rate: float = 0.05):
        self.lags, self.widths = TS.lag_names(season)
        self.n_trees, self.depth, self.rate = trees, depth, rate
        self.inputs = [*(f"lag_{k}" for k in self.lags), *(f"mean_{w}" for w in self.widths), *_PARTS]

    def fit(self, series: DataFrame) -> LagModel:
        rows = TS.lag_features(series.select("ts", "y"), self.lags, self.widths).dropna().select("y", *[F.col(c) for c in self.inputs[:-4]], *_calendar(F.col("ts"))).persist()
        try:
            if rows.count() < 20:
                raise ValueError("fewer than 20 rows with all lags")
            data = VectorAssembler(inputCols=self.inputs, outputCol="features").transform(rows).select("y", "features")
            model = GBTRegressor(labelCol="y", maxIter=self.n_trees, maxDepth=self.depth, stepSize=self.rate, seed=42).fit(data)
        finally:
            rows.unpersist()
        self.weights = dict(zip(self.inputs, map(float, model.featureImportances.toArray())))
        self.trees = from_spark(model, series.sparkSession)
        self.tail = [r["y"] for r in series.orderBy(F.desc("ts")).limit(max(*self.lags, *self.widths)).select("y").collect()][::-1]
        return self

    def importances(self) -> dict[str, float]:
        """The share of each input in what the splits gain, the largest first."""
        return dict(sorted(self.weights.items(), key=lambda x: (-x[1], x[0])))

    def forecast(self, stamps: DataFrame) -> DataFrame:
        """(step, ts, y) for stamps (step, ts), at most 1000 periods a series; predictions feed the lags of later steps."""
        shared = stamps.sparkSession.sparkContext.broadcast((self.trees, self.lags, self.widths, self.tail))

        def run(batches):
            for batch in batches:
                trees, lags, widths, tail = shared.value
                parts = np.array([[[p[c] for c in _PARTS] for p in own] for own in batch.column("ahead").to_pylist()], float)
                values = roll(trees, lags, widths, np.repeat([tail], len(parts), axis=0), parts)
                yield pa.RecordBatch.from_arrays([batch.column("ahead"), pa.array(list(values), pa.list_(pa.float64()))], names=["ahead", "values"])

        part = F.struct("step", "ts", *_calendar(F.col("ts")))
        ahead = stamps.groupBy(F.lit(0).alias("series")).agg(F.array_sort(F.collect_list(part)).alias("ahead")).select("ahead")
        rolled = ahead.mapInArrow(run, f"ahead {ahead.schema['ahead'].dataType.simpleString()}, values array<double>")
        return rolled.select(F.explode(F.arrays_zip("ahead", "values")).alias("r")).select("r.ahead.step", "r.ahead.ts", F.col("r.values").alias("y"))


def future(result: dict, periods: int, key: str | None = None) -> DataFrame:
    """(step, ts, y) after a training run's series, by its leader or another model."""
    key = key or result["leader"]
    return run_model(key, result["series"], result["info"]["freq"], periods, result["season"], result["trees"], result["lag_model"])


def run_model(key: str, series: DataFrame, freq: str, periods: int, season: int | None, trees: int = 300, lag_model: LagModel | None = None) -> DataFrame:
    """(step, ts, y) of one model; lag_model is one that was fitted on the series."""
    if key == "lag_gbt":
        return (lag_model or LagModel(season, trees).fit(series)).forecast(future_stamps(series, freq, periods))
    if key == "naive":
        return naive(series, freq, periods)
    if key == "snaive":
        return seasonal_naive(series, freq, periods, season)
    if key == "ets":
        return ets(series, freq, periods, season)
    raise ValueError(f"unknown model {key}")


def metrics(pairs: DataFrame) -> DataFrame:
    """One row of mae, rmse, mape and smape over (y, p); mape is null where a value is near 0, smape where all are."""
    y, p = F.col("y"), F.col("p")
    e, d = F.abs(y - p), F.abs(y) + F.abs(p)
    return pairs.agg(
        F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(F.min(F.abs(y)) >= 1e-8, F.avg(F.when(y != 0, e / F.abs(y))) * 100).alias("mape"), (F.avg(F.when(d > 1e-12, 2 * e / F.when(d > 1e-12, d))) * 100).alias("smape")
    )


def train(df: DataFrame, ts: str, y: str, primary: str = "rmse", season: int | None = None, horizon: int = 30, trees: int = 300, keys: tuple[str, ...] = ("naive", "snaive", "ets", "lag_gbt"), cfg: Config = DEFAULT) -> dict:
    """Chronological comparison: fit on train, choose on validation, score on test after refitting; the leader is never a baseline.

    Returns the leaderboard rows, the leader, whether it beats the baselines on test, its
    forecast from all data, and what preparing did. A model that fails is recorded.
    """
    if primary not in METRICS:
        raise ValueError(f"unknown metric {primary}")
    series, info = TS.prepare(df, ts, y, cfg=cfg)
    series = series.select("ts", "y").persist()
    n = series.count()
    a, b = TS.split_bounds(n, cfg)
    found, strength = (season, None) if season else TS.detect_season(series, info["freq"], n)
    parts = TS.chrono_split(series, n, cfg).persist()

    lag_model = None

    def score(key: str, upto: int, to: int) -> dict:
        nonlocal lag_model
        known, ahead = parts.where(F.col("pos") < upto).select("ts", "y"), parts.where((F.col("pos") >= upto) & (F.col("pos") < to))
        if key == "lag_gbt":
            lag_model = LagModel(found, trees).fit(known)
        guess = run_model(key, known, info["freq"], to - upto, found, trees, lag_model).select("ts", F.col("y").alias("p"))
        return metrics(ahead.join(guess, "ts")).first().asDict()

    board = []
    for key in keys:
        if key == "snaive" and not found:
            continue
        began = time.time()
        try:
            row = {"key": key, "baseline": key in BASELINES, "status": "ok", "validation": score(key, a, b), "test": score(key, b, n)}
        except Exception as e:  # one model's failure is a row of the result
            row = {"key": key, "baseline": key in BASELINES, "status": "failed", "error": str(e)[:200]}
        if key == "lag_gbt" and row["status"] == "ok":
            row["importances"] = lag_model.importances()
        board.append(row | {"seconds": time.time() - began})
    ok = [r for r in board if r["status"] == "ok" and r["validation"][primary] is not None]
    able = [r for r in ok if not r["baseline"]]
    if not able:
        raise ValueError("no model could be fitted and scored")
    leader = min(able, key=lambda r: r["validation"][primary])
    base = min((r["test"][primary] for r in ok if r["baseline"] and r["test"][primary] is not None), default=None)
    final = LagModel(found, trees).fit(series) if leader["key"] == "lag_gbt" else None
    ahead = run_model(leader["key"], series, info["freq"], horizon, found, trees, final)
    return {
        "models": board, "leader": leader["key"], "beats_baseline": base is not None and leader["test"][primary] < base, "improvement_pct": (base - leader["test"][primary]) / base * 100 if base else None,
        "season": found, "season_acf": strength, "info": info, "split": (a, b, n), "future": ahead, "series": series, "trees": trees, "lag_model": final,
    }
