"""Shapes that many operators share."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

RANGES = 256


def per_column(df: DataFrame, columns: list[str], measures: dict[str, object]) -> DataFrame:
    """One row per column with each measure(F.col(c)): a single wide aggregate, so the table is read once.

    measures: name -> function of a Column that gives an aggregate Column. The result has
    `column` and the measures.
    """
    wide = df.agg(*[f(F.col(f"`{c}`")).alias(f"m{k}_{m}") for k, c in enumerate(columns) for m, f in measures.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"m{k}_{m}").alias(m) for m in measures]) for k, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) over the non-null values of each column, as strings: one unpivot and one aggregation."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def top_n(df: DataFrame, n: int, by: list[Column], within: list[str]) -> DataFrame:
    """The first n rows of each group, with `rank`. Spark drops what cannot be among them before the exchange."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col("rank") <= n)


def finite(c: Column) -> Column:
    """The number as a double; NaN and infinities are missing, as no statistic can be drawn from them."""
    x = c.cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)  # NaN is above infinity in Spark's order


def present(df: DataFrame, name: str) -> Column:
    """Whether a column has a value: floating-point ones need a finite number."""
    c = F.col(f"`{name}`")
    return finite(c).isNotNull() if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c.isNotNull()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


#: Values that an exact quantile is read from, once sketches have narrowed the search down to so many.
QUANTILE_ROWS = 1 << 18


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float], most: int = QUANTILE_ROWS) -> dict[str, list[float | None]]:
    """Quantiles of each named expression, linear between neighbours, whatever the number of distinct values; None where it has no finite value.

    A mergeable sketch gives values below and above each quantile; counts show where the
    quantile lies between them, and the search goes on there until few values or one are
    left. Each round is one aggregate over the table for all columns, whose buffers are
    bounded; from `most` values on a round leaves about a thousandth of them.
    """
    value = {c: finite(x) for c, x in columns.items()}
    sizes = df.agg(*[F.count(x).alias(f"n{k}") for k, x in enumerate(value.values())], *[F.min(x).alias(f"lo{k}") for k, x in enumerate(value.values())], *[F.max(x).alias(f"hi{k}") for k, x in enumerate(value.values())]).first()
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    open_ = {}  # (column, place in probs): low and high value, ranks below low, values from low to high, wanted position
    for k, c in enumerate(columns):
        for i, p in enumerate(probs if sizes[f"n{k}"] else []):
            open_[c, i] = (sizes[f"lo{k}"], sizes[f"hi{k}"], 0, sizes[f"n{k}"], p * (sizes[f"n{k}"] - 1))
    while open_:
        wide = {s: b for s, b in open_.items() if b[3] > most and b[0] < b[1]}
        inside = lambda c, lo, hi: F.when((value[c] >= lo) & (value[c] <= hi), value[c])
        if not wide:
            exact = []
            for k, ((c, _), (lo, hi, below, m, at)) in enumerate(open_.items()):
                near = [min(1.0, max(0.0, (x - below) / max(m - 1, 1))) for x in (int(at), min(int(at) + 1, below + m - 1))]
                exact.append(F.percentile(inside(c, lo, hi), F.array(*[F.lit(x) for x in near])).alias(f"q{k}"))
            found = df.agg(*exact).first()
            for k, ((c, i), (lo, hi, below, m, at)) in enumerate(open_.items()):
                a, b = found[f"q{k}"] if lo < hi else (lo, lo)
                out[c][i] = a + (b - a) * (at - int(at))
            break
        sketch = []
        for k, ((c, _), (lo, hi, below, m, at)) in enumerate(wide.items()):
            share = (at - below) / max(m - 1, 1)
            sketch.append(F.percentile_approx(inside(c, lo, hi), [max(0.0, share - 4e-4), min(1.0, share + 4e-4)], 10000).alias(f"q{k}"))
        found = df.agg(*sketch).first()
        bounds = {s: found[f"q{k}"] for k, s in enumerate(wide)}
        counts = []
        for k, ((c, i), (a, b)) in enumerate(bounds.items()):
            counts += [F.count_if(value[c] < a).alias(f"b{k}"), F.count_if((value[c] >= a) & (value[c] <= b)).alias(f"m{k}")]
        found = df.agg(*counts).first()
        for k, (s, (a, b)) in enumerate(bounds.items()):
            lo, hi, below, m, at = open_[s]
            first, n = found[f"b{k}"], found[f"m{k}"]
            if at >= first and int(at) + 1 < first + n and n < m:
                open_[s] = (a, b, first, n, at)
            elif at < first:
                open_[s] = (lo, a, below, first - below + df.where(value[s[0]] == a).count(), at)
            elif n < m and at >= first + n - 1:
                above = first + n - df.where(value[s[0]] == b).count()
                open_[s] = (b, hi, above, below + m - above, at)
            else:  # most values are one: take the quantile from how often each stands
                rows = mean_ranks(df.select(value[s[0]].alias("v")), "v")
                found_at = lambda x: rows.where((F.col("rank") - (F.col("n") + 1) / 2 <= x) & (F.col("rank") + (F.col("n") - 1) / 2 > x)).first()["value"]  # noqa: E731, B023
                low, high = found_at(int(at)), found_at(min(int(at) + 1, below + m - 1))
                out[s[0]][s[1]] = low + (high - low) * (at - int(at))
                del open_[s]
    return out


def cumulative(df: DataFrame, key: str, sums: list[str], partition: str | None = None) -> DataFrame:
    """For rows with distinct numeric `key` (in each partition): adds before_<s>, the sum of s over smaller keys.

    Keys are cut into RANGES ranges at approximate quantiles; sums of whole ranges are added
    up over at most RANGES rows, and a window runs only within a range. No task holds the
    whole order.
    """
    cuts = sorted(set(df.approxQuantile(key, [k / RANGES for k in range(1, RANGES)], 1 / RANGES)))
    bounds = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=key, outputCol="_range", handleInvalid="keep") if cuts else None
    own = bounds.transform(df) if bounds else df.withColumn("_range", F.lit(0.0))
    groups = ["_range"] if partition is None else [partition, "_range"]
    whole = own.groupBy(*groups).agg(*[F.sum(s).alias(f"_w_{s}") for s in sums])
    over = Window.partitionBy(*groups[:-1]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*groups, *[F.coalesce(F.sum(f"_w_{s}").over(over), F.lit(0)).alias(f"_b_{s}") for s in sums])
    inner = Window.partitionBy(*groups).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("*", *[F.coalesce(F.sum(s).over(inner), F.lit(0)).alias(f"_i_{s}") for s in sums]).join(whole, groups)
    return own.select(*df.columns, *[(F.col(f"_b_{s}") + F.col(f"_i_{s}")).alias(f"before_{s}") for s in sums])


def mean_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, n, rank): the mean rank, from 1, of each distinct finite value of a numeric column."""
    value = finite(F.col(column))
    counts = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    ranked = cumulative(counts, "value", ["n"])
    return ranked.select("value", "n", (F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))
