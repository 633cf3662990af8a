"""Queries over regular series and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import forecast as FC
from sparkloom.operators import timeseries as TS
from sparkloom.plans.registry import query, rounded

_DAILY = "d AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, avg(o_totalprice) AS y FROM orders GROUP BY 1)"
_GRID = f"{_DAILY}, g AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM d), r AS (SELECT g.ts, d.y FROM g LEFT JOIN d USING (ts))"
_FULL = f"{_GRID}, s AS (SELECT ts, last_value(y IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS y, y IS NULL AS filled FROM r), p AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM s)"


def daily(t):
    return TS.dedupe_timestamps(t("orders"), "o_orderdate", "o_totalprice")


def full(t):
    return TS.forward_fill(TS.reindex(daily(t), "D"))


@query("dedupe_timestamps", f"WITH {_DAILY} SELECT ts, round(y, 6) AS y FROM d")
def _(t):
    return rounded(daily(t))


@query("reindex_calendar", f"WITH {_GRID} SELECT ts, round(y, 6) AS y FROM r")
def _(t):
    return rounded(TS.reindex(daily(t), "D"))


@query("forward_fill", f"WITH {_FULL} SELECT ts, round(y, 6) AS y, filled FROM s")
def _(t):
    return rounded(full(t))


@query("prepare_series", f"WITH {_FULL} SELECT ts, round(y, 6) AS y, filled FROM s")
def _(t):
    return rounded(TS.prepare(t("orders"), "o_orderdate", "o_totalprice", freq="D")[0])


@query("median_gap", f"WITH {_DAILY}, x AS (SELECT date_diff('second', lag(ts) OVER (ORDER BY ts), ts) / 86400.0 AS days FROM d) SELECT CAST(median(days) AS DOUBLE) AS median, CAST(max(days) AS DOUBLE) AS longest FROM x")
def _(t):
    return TS.gaps(t("orders"), "o_orderdate").agg(F.percentile("days", F.lit(0.5), F.col("n")).alias("median"), F.max("days").alias("longest"))


@query(
    "infer_frequency",
    f"""WITH {_DAILY}, m AS (SELECT median(days) AS s FROM (SELECT date_diff('second', lag(ts) OVER (ORDER BY ts), ts) AS days FROM d)), g AS (SELECT CAST(s AS BIGINT) AS s, (SELECT date_diff('second', min(ts), max(ts)) FROM d) // CAST(s AS BIGINT) + 1 AS grid, (SELECT count(*) FROM d) AS n FROM m)
SELECT f AS freq, CASE f WHEN 'D' THEN 'daily' WHEN 'h' THEN 'hourly' WHEN 'min' THEN 'minutely' WHEN 's' THEN 'secondly' WHEN 'W' THEN 'weekly' ELSE 'custom (' || f || ')' END AS label, greatest(grid - n, 0) AS gaps, grid <= n AS regular
FROM (SELECT *, CASE WHEN s = 604800 THEN 'W' ELSE (CASE WHEN s = u THEN '' ELSE CAST(s // u AS VARCHAR) END) || (CASE u WHEN 86400 THEN 'D' WHEN 3600 THEN 'h' WHEN 60 THEN 'min' ELSE 's' END) END AS f
      FROM (SELECT *, CASE WHEN s % 86400 = 0 THEN 86400 WHEN s % 3600 = 0 THEN 3600 WHEN s % 60 = 0 THEN 60 ELSE 1 END AS u FROM g))""",
)
def _(t):
    df = t("orders")
    i = TS.frequency(df, "o_orderdate")
    return df.sparkSession.createDataFrame([(i["freq"], i["label"], i["gaps"], i["regular"])], "freq string, label string, gaps long, regular boolean")


_STEPS = "SELECT '{kind}' AS kind, CASE WHEN min(k) = max(k) THEN (CASE WHEN min(k) = {one} THEN '' ELSE CAST(min(k) // {one} AS VARCHAR) END) || '{name}' END AS rule FROM (SELECT p - lag(p) OVER (ORDER BY p) AS k FROM (SELECT DISTINCT {at} AS p FROM orders))"


@query(
    "frequency_rules",
    " UNION ALL ".join(
        _STEPS.format(kind=kind, one=one, name=name, at=at)
        for kind, one, name, at in (
            ("month", 1, "MS", "year(o_orderdate) * 12 + month(o_orderdate)"), ("month end", 1, "ME", "year(o_orderdate) * 12 + month(o_orderdate)"), ("quarter", 1, "QS-OCT", "year(o_orderdate) * 4 + quarter(o_orderdate)"),
            ("week", 1, "W-MON", "CAST(date_diff('day', DATE '1970-01-05', CAST(o_orderdate AS DATE)) // 7 AS BIGINT)"),
        )
    ),
)
def _(t):
    """The calendars that order dates follow once they are months, month ends, quarters and weeks."""
    d = F.col("o_orderdate")
    kinds = {"month": F.date_trunc("month", d), "month end": F.last_day(d), "quarter": F.date_trunc("quarter", d), "week": F.date_trunc("week", d)}
    df = t("orders")
    rows = [(kind, (TS.frequency(df.select(c.cast("timestamp_ntz").alias("ts")), "ts") or {}).get("rule")) for kind, c in kinds.items()]
    return df.sparkSession.createDataFrame(rows, "kind string, rule string")


@query("freq_gaps", f"WITH {_GRID} SELECT ts FROM r WHERE y IS NULL")
def _(t):
    return TS.reindex(daily(t), "D").where("y is null").select("ts")


@query("regularize_index", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS quarter, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS year FROM orders")
def _(t):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", TS.snap(d, "MS").alias("month"), TS.snap(d, "QS").alias("quarter"), TS.snap(d, "YS").alias("year"))


@query("lag_features", f"WITH {_FULL} SELECT ts, round(y, 6) AS y, " + ", ".join(f"round(lag(y, {k}) OVER (ORDER BY ts), 6) AS lag_{k}" for k in (1, 2, 3, 7, 14)) + " FROM s")
def _(t):
    return rounded(TS.lag_features(full(t), [1, 2, 3, 7, 14], []))


@query("rolling_means", f"WITH {_FULL} SELECT ts, " + ", ".join(f"CASE WHEN pos >= {w} THEN round(avg(y) OVER (ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 6) END AS mean_{w}" for w in (3, 7)) + " FROM p")
def _(t):
    return rounded(TS.lag_features(full(t), [1], [3, 7]).select("ts", "mean_3", "mean_7"))


@query("acf_season", f"WITH {_FULL}, l AS (SELECT regr_slope(y, pos) AS b, regr_intercept(y, pos) AS a FROM p), e AS (SELECT ts, y - a - b * pos AS r FROM p, l), q AS (SELECT r, lag(r, 7) OVER (ORDER BY ts) AS q FROM e) SELECT 7 AS lag, round(sum(r * q) / sum(r * r), 6) AS acf FROM q")
def _(t):
    return rounded(TS.acf(full(t), 7))


@query("chrono_split", f"WITH {_FULL} SELECT ts, pos, CASE WHEN pos < floor(n * 0.7) THEN 'train' WHEN pos < floor(n * 0.85) THEN 'validation' ELSE 'test' END AS part FROM p")
def _(t):
    s = full(t)
    return TS.chrono_split(s, s.count()).select("ts", "pos", "part")


@query("stride_thin", f"WITH {_FULL} SELECT ts, pos FROM p WHERE pos % (n // 500) = 0")
def _(t):
    s = full(t)
    return TS.thin(s, s.count(), 500).select("ts", "pos")


_AHEAD = "h AS (SELECT CAST(k AS INT) AS step, (SELECT max(ts) FROM s) + to_days(CAST(k AS INT)) AS ts FROM range(1, 31) x(k))"


@query("fc_naive", f"WITH {_FULL}, {_AHEAD} SELECT step, h.ts, round((SELECT arg_max(y, ts) FROM s), 6) AS y FROM h")
def _(t):
    return rounded(FC.naive(full(t), "D", 30))


@query("fc_snaive", f"WITH {_FULL}, {_AHEAD} SELECT step, h.ts, round(p.y, 6) AS y FROM h JOIN p ON p.pos = p.n - 7 + (step - 1) % 7")
def _(t):
    return rounded(FC.seasonal_naive(full(t), "D", 30, 7))


@query(
    "fc_metrics",
    f"WITH {_FULL}, e AS (SELECT p.y, l.y AS f FROM p, (SELECT y FROM p WHERE pos = floor(n * 0.85) - 1) l WHERE pos >= floor(n * 0.85)) SELECT round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg(pow(y - f, 2))), 6) AS rmse, round(avg(abs(y - f) / abs(y)) * 100, 6) AS mape, round(avg(2 * abs(y - f) / (abs(y) + abs(f))) * 100, 6) AS smape FROM e",
)
def _(t):
    s = full(t)
    parts = TS.chrono_split(s, s.count())
    known, ahead = parts.where("part <> 'test'"), parts.where("part = 'test'")
    last = known.agg(F.max_by("y", "ts").alias("p"))
    return rounded(FC.metrics(ahead.crossJoin(F.broadcast(last)).select("y", "p")))


@query("fc_ets")
def _(t):
    return FC.ets(full(t), "D", 30, 7)


@query("fc_ets_many")
def _(t):
    """Monthly values of each order priority, as series side by side."""
    o = t("orders")
    monthly = o.groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.avg("o_totalprice").alias("y"))
    return FC.ets(monthly, "MS", 12, 12, ("o_orderpriority",))


_LAG_MODELS: dict = {}


def _lag_model(t):
    """The lag model of all 300 trees, fitted once for each table and session."""
    orders = t("orders")
    key = (id(orders.sparkSession), orders.inputFiles()[0])
    if key not in _LAG_MODELS:
        _LAG_MODELS.clear()
        _LAG_MODELS[key] = FC.LagModel(7).fit(full(t))
    return _LAG_MODELS[key]


@query("fc_lag_gbt")
def _(t):
    s, model = full(t), _lag_model(t)
    return model.forecast(FC.future_stamps(s, "D", 14))


@query("fc_lag_importance")
def _(t):
    """What each lag, mean and calendar part gains in the lag model's splits."""
    return t("orders").sparkSession.createDataFrame(list(_lag_model(t).importances().items()), "feature string, importance double")


@query("fc_future")
def _(t):
    return FC.run_model("ets", full(t), "D", 60, None)


@query("fc_leaderboard")
def _(t):
    df = t("orders")
    r = FC.train(df, "o_orderdate", "o_totalprice", season=7, horizon=14, trees=60)
    rows = [(m["key"], m["baseline"], m["status"], m["validation"]["rmse"], m["test"]["rmse"], m["key"] == r["leader"]) for m in r["models"]]
    return df.sparkSession.createDataFrame(rows, "model string, baseline boolean, status string, validation_rmse double, test_rmse double, leader boolean")
