"""Regular series: frequency, calendar, filling, lags, seasons, splits.

A series has at most max_periods points once it is regular, and what has to look along
it (windows without a partition) runs on that; rows are aggregated by period before, and
how many periods there are is known before any calendar is made.
"""

from __future__ import annotations

import calendar as cal
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.config import DEFAULT, Config
from sparkloom.operators.common import RANGES

# Season lengths that are tried by frequency, and how frequencies are shown.
SEASONS = {"D": [7], "h": [24], "MS": [12], "QS": [4], "W": [52], "B": [5], "min": [60]}
LABELS = {"MS": "monthly", "QS": "quarterly", "YS": "yearly", "D": "daily", "h": "hourly", "B": "business-daily", "min": "minutely", "s": "secondly", "W": "weekly"}
_TRUNC = {"MS": "month", "QS": "quarter", "YS": "year"}
_MONTHS = {"MS": 1, "QS": 3, "YS": 12}
#: Units of fixed length in microseconds, the longest first.
_MICROS = {"W": 7 * 86_400_000_000, "D": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1}


def parse(freq: str) -> tuple[int, str]:
    """Multiple and unit of a frequency such as D, 15min or 2MS."""
    found = re.fullmatch(rf"(\d*)({'|'.join([*_MONTHS, *_MICROS, 'B'])})", freq)
    if not found or found[1] == "0" or (found[2] == "B" and found[1]):
        raise ValueError(f"unknown frequency {freq}")
    return int(found[1] or 1), found[2]


def named(n: int, unit: str) -> str:
    return f"{n if n > 1 else ''}{unit}"


def of_micros(micros: int) -> str:
    """A fixed length in the longest unit that divides it; weeks only if it is one week."""
    unit = next(u for u, size in _MICROS.items() if micros % size == 0 and (u != "W" or micros == size))
    return named(micros // _MICROS[unit], unit)


def snap(ts: Column, freq: str) -> Column:
    """Months, quarters and years to their start; other stamps stay."""
    unit = parse(freq)[1]
    return F.date_trunc(_TRUNC[unit], ts).cast("timestamp_ntz") if unit in _TRUNC else ts.cast("timestamp_ntz")


def interval(freq: str) -> Column:
    """Length of a period; that of business days is a day."""
    n, unit = parse(freq)
    if unit in _TRUNC:
        return F.expr(f"interval {n * _MONTHS[unit]} months")
    return F.expr(f"interval {n * _MICROS['D' if unit == 'B' else unit]} microseconds")


def neighbours(df: DataFrame, ts: str) -> DataFrame:
    """(before, at): neighbouring distinct stamps in microseconds.

    Stamps are cut into ranges; windows run within a range, and over one row for each range.
    """
    stamps = df.where(F.col(ts).isNotNull()).select(F.unix_micros(F.col(ts).cast("timestamp_ntz").cast("timestamp")).alias("at")).distinct()
    cuts = sorted(set(stamps.select(F.col("at").cast("double").alias("at")).approxQuantile("at", [k / RANGES for k in range(1, RANGES)], 1 / RANGES)))
    bounds = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<long>")
    own = stamps.withColumn("range", F.size(F.filter(bounds, lambda b: b < F.col("at"))))
    within = own.select(F.lag("at").over(Window.partitionBy("range").orderBy("at")).alias("before"), "at")
    ends = own.groupBy("range").agg(F.min("at").alias("first"), F.max("at").alias("last"))  # a row for each range
    between = ends.select(F.lag("last").over(Window.orderBy("range")).alias("before"), F.col("first").alias("at"))
    return within.unionByName(between).where("before is not null")


def gaps(df: DataFrame, ts: str) -> DataFrame:
    """(days, n): distances between neighbouring distinct stamps."""
    return neighbours(df, ts).groupBy(((F.col("at") - F.col("before")) / F.lit(86400e6)).alias("days")).agg(F.count("*").alias("n"))


def count_periods(lo, hi, freq: str) -> int:
    """How many periods a calendar from lo to hi has, without making it."""
    n, unit = parse(freq)
    if unit in _TRUNC:
        months = (hi.year - lo.year) * 12 + hi.month - lo.month
        return months // (n * _MONTHS[unit]) + 1
    if unit == "B":
        days = (hi - lo).days + 1
        return days // 7 * 5 + sum((lo.weekday() + k) % 7 < 5 for k in range(days % 7))
    span = hi - lo
    return ((span.days * 86400 + span.seconds) * 1_000_000 + span.microseconds) // (n * _MICROS[unit]) + 1


def _span(df: DataFrame, freq: str, ts: str = "ts") -> tuple[int, int]:
    """Periods from the first stamp to the last, and distinct stamps."""
    found = df.agg(F.min(ts).cast("timestamp_ntz").alias("lo"), F.max(ts).cast("timestamp_ntz").alias("hi"), F.count_distinct(ts).alias("n")).first()
    return (count_periods(found["lo"], found["hi"], freq), found["n"]) if found["n"] else (0, 0)


def _facts(df: DataFrame, ts: str) -> dict:
    """What the rules ask of the stamps, from one aggregate over them and one over neighbours."""
    at = F.timestamp_micros("at")
    day, last, weekday = F.dayofmonth(at), F.last_day(at), F.weekday(at)
    first = at.cast("date") - (day - 1)
    opens = F.date_add(first, F.when(F.weekday(first) > 4, 7 - F.weekday(first)).otherwise(0))
    closes = F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0)))
    every = lambda c: F.min(c.cast("int")) == 1
    stamps = df.where(F.col(ts).isNotNull()).select(F.unix_micros(F.col(ts).cast("timestamp_ntz").cast("timestamp")).alias("at")).agg(
        F.count_distinct("at").alias("n"), every(day == 1).alias("cs"), every(at.cast("date") == opens).alias("bs"), every(at.cast("date") == last).alias("ce"), every(at.cast("date") == closes).alias("be"), every(weekday < 5).alias("workdays"),
        *[f(c).alias(f"{name}_{side}") for name, c in (("month", F.month(at)), ("weekday", weekday), ("week", F.floor((day - 1) / 7))) for side, f in (("lo", F.min), ("hi", F.max))],
    ).first().asDict()
    if stamps["n"] < 3:
        return stamps
    before = F.timestamp_micros("before")
    years, gap = F.year(at) - F.year(before), F.col("at") - F.col("before")
    hours = gap / _MICROS["h"]
    steps = neighbours(df, ts).agg(
        *[f(c).alias(f"{name}_{side}") for name, c in (("gap", gap), ("years", years), ("months", years * 12 + F.month(at) - F.month(before))) for side, f in (("lo", F.min), ("hi", F.max))],
        every(hours.isin(1.0, 17.0, 65.0)).alias("hours"), F.max((hours > 1).cast("int")).alias("nights"), every((gap == _MICROS["D"]) | ((gap == 3 * _MICROS["D"]) & (F.weekday(before) == 4))).alias("weeks"),
    ).first().asDict()
    return stamps | steps


def rule(facts: dict) -> str | None:
    """The calendar that all stamps follow, such as 2D, 15min, W-WED, B, BME, QE-NOV or WOM-2MON; None if there is none.

    A year's, quarter's or month's first or last day or business day at even steps comes
    before a fixed step, that before business days, and these before an n-th weekday.
    """
    same = lambda name: facts[f"{name}_lo"] == facts[f"{name}_hi"]
    step, day = facts["gap_lo"], _MICROS["D"]
    if step % day == 0:
        position = next((p for p in ("ce", "be", "cs", "bs") if facts[p]), None)
        code = lambda unit: {"ce": f"{unit}E", "be": f"B{unit}E", "cs": f"{unit}S", "bs": f"B{unit}S"}[position]
        if position and same("years") and same("month") and facts["years_lo"]:
            return f"{named(facts['years_lo'], code('Y'))}-{cal.month_abbr[facts['month_lo']].upper()}"
        if position and same("months") and facts["months_lo"]:
            months = facts["months_lo"]
            if months % 3 == 0:
                anchor = {0: 12, 1: 10, 2: 11}[facts["month_lo"] % 3]
                return f"{named(months // 3, code('Q'))}-{cal.month_abbr[anchor].upper()}"
            return named(months, code("M"))
        if same("gap"):
            weeks = step // (7 * day)
            return f"{named(weeks, 'W')}-{cal.day_abbr[facts['weekday_lo']].upper()}" if step % (7 * day) == 0 else named(step // day, "D")
        if facts["weeks"] and facts["workdays"]:
            return "B"
        if same("weekday") and same("week") and facts["week_lo"] < 4:
            return f"WOM-{facts['week_lo'] + 1}{cal.day_abbr[facts['weekday_lo']].upper()}"
        return None
    if facts["hours"] and facts["nights"]:
        return "bh"
    return of_micros(step) if same("gap") else None


def grid_of(found: str) -> str:
    """The frequency whose calendar the stamps of a rule lie on, once they are snapped: ends and business days of months count as the months, an anchored week as a week."""
    n, code = re.match(r"(\d*)([A-Za-z]+)", found).groups()
    if code in ("WOM", "bh"):
        return {"WOM": "MS", "bh": "h"}[code]
    unit = {"YE": "YS", "BYE": "YS", "BYS": "YS", "QE": "QS", "BQE": "QS", "BQS": "QS", "ME": "MS", "BME": "MS", "BMS": "MS"}.get(code, code)
    return named(int(n or 1), unit)


def frequency(df: DataFrame, ts: str) -> dict | None:
    """{freq, rule, label, gaps, regular}, or None below 3 distinct stamps.

    The rule that all stamps follow gives the frequency; without one the median gap does.
    """
    facts = _facts(df, ts)
    if facts["n"] < 3:
        return None
    follows = rule(facts)
    if follows:
        freq = grid_of(follows)
    else:
        median = gaps(df, ts).agg(F.percentile("days", F.lit(0.5), F.col("n")).alias("median")).first()["median"]
        months = next((unit for unit, (lo, hi) in {"MS": (27, 32), "QS": (88, 93), "YS": (360, 370)}.items() if lo <= median <= hi), None)
        freq = months or of_micros(max(_MICROS["s"], round(median * 86400) * _MICROS["s"]))
    periods, present = _span(df.where(F.col(ts).isNotNull()).select(snap(F.col(ts), freq).alias("ts")), freq)
    missing = max(0, periods - present)
    return {"freq": freq, "rule": follows, "label": LABELS.get(freq, f"custom ({freq})"), "gaps": missing, "regular": missing == 0}


def calendar(df: DataFrame, freq: str, ts: str = "ts") -> DataFrame:
    """(ts) of every period from the first stamp to the last."""
    ends = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).where("lo is not null")
    days = ends.select(F.explode(F.sequence("lo", "hi", interval(freq))).alias("ts"))
    return days.where(F.weekday("ts") < 5) if freq == "B" else days


def dedupe_timestamps(df: DataFrame, ts: str, y: str) -> DataFrame:
    """(ts, y): the mean of the values of each stamp."""
    return df.where(F.col(ts).isNotNull()).groupBy(F.col(ts).cast("timestamp_ntz").alias("ts")).agg(F.avg(F.col(y).cast("double")).alias("y"))


def reindex(series: DataFrame, freq: str) -> DataFrame:
    """(ts, y) on the whole calendar, null where nothing was seen."""
    return calendar(series, freq).join(series, "ts", "left")


def forward_fill(series: DataFrame) -> DataFrame:
    """(ts, y, filled): nulls take the last value before them; leading nulls go."""
    before = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.select("ts", F.last("y", ignorenulls=True).over(before).alias("y"), F.col("y").isNull().alias("filled")).where("y is not null")


def prepare(df: DataFrame, ts: str, y: str, freq: str | None = None, cfg: Config = DEFAULT) -> tuple[DataFrame, dict]:
    """A regular, filled series (ts, y, filled), and what was done to get it: rows without stamp, stamps averaged, periods filled."""
    if ts == y:
        raise ValueError("the datetime column and the target are the same")
    info = frequency(df, ts) if freq is None else {"freq": freq}
    if info is None:
        raise ValueError("no frequency: fewer than 3 distinct stamps")
    snapped = df.select(snap(F.col(ts), info["freq"]).alias("ts"), F.col(y).cast("double").alias("y"))
    counts = snapped.agg(F.count_if(F.col("ts").isNull()).alias("dropped"), F.count("ts").alias("rows"), F.count_distinct("ts").alias("stamps")).first()
    once = dedupe_timestamps(snapped, "ts", "y")
    periods, _ = _span(once, info["freq"])
    if periods > cfg.max_periods:
        raise ValueError(f"{periods} periods; aggregate to a coarser frequency first")
    grid = reindex(once, info["freq"])
    series = forward_fill(grid)
    n = series.count()
    if n < cfg.min_rows_forecast:
        raise ValueError(f"{n} periods; at least {cfg.min_rows_forecast} are needed")
    return series, {**info, "rows_removed": counts["dropped"], "aggregated": counts["rows"] - counts["stamps"], "filled": series.where("filled").count(), "periods": n}


def positions(series: DataFrame) -> DataFrame:
    """Adds pos, from 0, in time order."""
    return series.withColumn("pos", (F.row_number().over(Window.orderBy("ts")) - 1).cast("long"))


def lag_names(season: int | None) -> tuple[list[int], list[int]]:
    """Lags and rolling widths for a season length."""
    m = season or 7
    return sorted({1, 2, 3, m} | ({2 * m} if season else set())), sorted({3, m})


def lag_features(series: DataFrame, lags: list[int], widths: list[int]) -> DataFrame:
    """Adds lag_<k> and mean_<w>: values k periods before, and the mean of the w before, current value excluded; null until there are enough."""
    w = Window.orderBy("ts")
    out = series.select("ts", "y", *[F.lag("y", k).over(w).alias(f"lag_{k}") for k in lags])
    for k in widths:
        back = w.rowsBetween(-k, -1)
        out = out.withColumn(f"mean_{k}", F.when(F.count("y").over(back) == k, F.avg("y").over(back)))
    return out


def acf(series: DataFrame, lag: int) -> DataFrame:
    """One row (lag, acf): autocorrelation of the series without its linear trend."""
    p = positions(series)
    x = F.col("pos").cast("double")
    line = p.agg(F.regr_slope("y", x).alias("b"), F.regr_intercept("y", x).alias("a"))
    r = p.crossJoin(F.broadcast(line)).select("ts", (F.col("y") - F.col("a") - F.col("b") * x).alias("r"))
    lagged = r.select("r", F.lag("r", lag).over(Window.orderBy("ts")).alias("q"))
    return lagged.agg((F.sum(F.col("r") * F.col("q")) / F.sum(F.col("r") * F.col("r"))).alias("acf")).select(F.lit(lag).alias("lag"), "acf")


def detect_season(series: DataFrame, freq: str, n: int) -> tuple[int | None, float | None]:
    """The season length whose autocorrelation is largest, from 0.3 up."""
    best, value = None, 0.3
    for m in SEASONS.get(freq[:1] if freq.startswith("W") else freq, []):
        if n >= 2 * m + 4:
            a = acf(series, m).first()["acf"]
            if a is not None and a >= value:
                best, value = m, a
    return best, value if best else None


def split_bounds(n: int, cfg: Config = DEFAULT) -> tuple[int, int]:
    """Where training and validation end."""
    a, b = int(n * cfg.forecast_train_frac), int(n * (cfg.forecast_train_frac + cfg.forecast_val_frac))
    if not 0 < a < b < n:
        raise ValueError("the series is too short to split")
    return a, b


def chrono_split(series: DataFrame, n: int, cfg: Config = DEFAULT) -> DataFrame:
    """Adds pos and part: train, validation or test, in time order."""
    a, b = split_bounds(n, cfg)
    return positions(series).withColumn("part", F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "validation").otherwise("test"))


def thin(series: DataFrame, n: int, points: int = 1500) -> DataFrame:
    """Every k-th point, so that about `points` are left to draw."""
    return positions(series).where(F.col("pos") % max(1, n // points) == 0)
