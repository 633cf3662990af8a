"""Frequencies of generated calendars, each named as pandas names it."""

import datetime as dt
import random

import pandas as pd
import pytest

from sparkloom.operators import forecast as FC
from sparkloom.operators import timeseries as TS

CALENDARS = [
    "D", "2D", "10D", "W-SUN", "W-WED", "3W-FRI", "h", "6h", "25h", "min", "15min", "90min", "s", "90s", "250ms", "B", "MS", "ME", "BMS", "BME", "2MS", "5ME", "QS-JAN", "QS-FEB", "QE-DEC", "QE-NOV", "BQS-JAN", "BQE-OCT",
    "2QS-JAN", "YS-JAN", "YS-JUL", "YE-MAR", "2YS-JAN", "BYE-DEC", "BYS-JAN", "WOM-2MON", "WOM-1FRI", "bh",
]


def frame(spark, stamps, seed=0):
    rows = [(s.to_pydatetime(),) for s in stamps]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame([*rows, rows[0], (None,)], "ts timestamp_ntz").repartition(3)


@pytest.mark.parametrize("freq", CALENDARS)
def test_each_calendar_is_named(spark, freq):
    stamps = pd.date_range("2003-02-11 08:00" if freq == "bh" else "2003-02-11", periods=46, freq=freq)
    found = TS.frequency(frame(spark, stamps), "ts")
    assert found["rule"] == pd.infer_freq(stamps)
    if freq != "bh":
        assert found["regular"] and found["gaps"] == 0, found


def test_grids_labels_and_what_follows(spark):
    for freq, grid, label, then in (("ME", "MS", "monthly", dt.datetime(2003, 8, 1)), ("15min", "15min", "custom (15min)", dt.datetime(2003, 2, 11, 1, 30)), ("W-WED", "W", "weekly", dt.datetime(2003, 3, 26)), ("2QS-JAN", "2QS", "custom (2QS)", dt.datetime(2006, 4, 1)), ("YE-MAR", "YS", "yearly", dt.datetime(2009, 1, 1))):
        df = frame(spark, pd.date_range("2003-02-11", periods=6, freq=freq))
        found = TS.frequency(df, "ts")
        assert (found["freq"], found["label"]) == (grid, label)
        series = df.where("ts is not null").select(TS.snap(df["ts"], grid).alias("ts")).distinct().selectExpr("ts", "1.0 as y")
        assert FC.future_stamps(series, grid, 1).first()["ts"] == then, freq
        assert TS.calendar(series, grid).count() == series.count() == TS._span(series, grid)[0]


def test_without_a_rule_the_median_decides(spark):
    days = list(pd.date_range("2024-01-01", periods=40, freq="D"))
    for drop, freq, gaps in (([11], "D", 1), ([3, 4, 20], "D", 3)):
        found = TS.frequency(frame(spark, [d for k, d in enumerate(days) if k not in drop]), "ts")
        assert (found["rule"], found["freq"], found["gaps"], found["regular"]) == (None, freq, gaps, False)
    months = [d for k, d in enumerate(pd.date_range("2024-01-01", periods=30, freq="MS")) if k != 7]
    found = TS.frequency(frame(spark, months), "ts")
    assert (found["rule"], found["freq"], found["gaps"]) == (None, "MS", 1)
    hours = [d for k, d in enumerate(pd.date_range("2024-01-01", periods=50, freq="6h")) if k != 9]
    assert TS.frequency(frame(spark, hours), "ts")["freq"] == "6h"
    assert TS.frequency(frame(spark, days[:2]), "ts") is None


def test_names():
    for freq in ("D", "15min", "2MS", "250ms", "W"):
        assert TS.named(*TS.parse(freq)) == freq
    for wrong in ("", "x", "0D", "2B", "D2", "S50"):
        with pytest.raises(ValueError):
            TS.parse(wrong)
    assert [TS.of_micros(x * 1_000_000) for x in (604800, 1209600, 86400, 7200, 90, 60)] == ["W", "14D", "D", "2h", "90s", "min"]
