"""Descriptive statistics of numeric, categorical, boolean, text and datetime columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.config import DEFAULT, STOP_WORDS, Config
from sparkloom.functions import columns as C
from sparkloom.operators.common import exact_quantiles, finite, numeric_columns, per_column, top_n, value_counts


def numeric_summary(df: DataFrame, columns: list[str] | None = None, cfg: Config = DEFAULT, exact: bool = True) -> DataFrame:
    """One row per numeric column: counts, moments, quartiles and skew class. NaN and infinities count as missing.

    Quartiles are exact and found by a search over bounded aggregates; exact=False takes
    them from one mergeable sketch.
    """
    names = columns or numeric_columns(df)
    quartiles = lambda c: F.percentile_approx(finite(c), [0.25, 0.5, 0.75], 10000)
    out = per_column(
        df, names,
        {
            "rows": lambda c: F.count(F.lit(1)), "count": lambda c: F.count(finite(c)), "mean": lambda c: F.avg(finite(c)), "std": lambda c: F.when(F.count(finite(c)) > 1, F.stddev_samp(finite(c))).when(F.count(finite(c)) == 1, 0.0),
            "min": lambda c: F.min(finite(c)), "max": lambda c: F.max(finite(c)),
            "skewness": lambda c: C.bias_corrected_skew(finite(c), F.count(finite(c))), "kurtosis": lambda c: C.bias_corrected_kurtosis(finite(c), F.count(finite(c))),
        } | ({} if exact else {"q": quartiles}),
    )
    if exact:
        found = exact_quantiles(df, {c: F.col(f"`{c}`") for c in names}, [0.25, 0.5, 0.75])
        at = F.create_map(*[x for c in names for x in (F.lit(c), F.array(*[F.lit(q).cast("double") for q in found[c]]))])  # three numbers a column
        out = out.withColumn("q", at[F.col("column")])
    missing = F.col("rows") - F.col("count")
    return out.select(
        "column", "count", missing.alias("missing"), F.round(missing / F.greatest(F.col("rows"), F.lit(1)).cast("double") * 100, 3).alias("missing_pct"), "mean", F.col("q")[1].alias("median"), "std", "min",
        F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), "max", (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "skewness", "kurtosis", C.skew_class(F.col("skewness"), cfg).alias("skew_class"),
    )


def outliers(df: DataFrame, columns: list[str] | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(column, lower_bound, upper_bound, outliers, outlier_pct, whisker_low, whisker_high): Tukey fences, what lies outside, and the extremes inside.

    A first aggregate finds the fences of all columns (one small row), a second counts.
    """
    names = columns or numeric_columns(df)
    found = {r["column"]: r for r in numeric_summary(df, names, cfg).collect()}
    fences = {c: (found[c]["q1"] - cfg.outlier_iqr_k * found[c]["iqr"], found[c]["q3"] + cfg.outlier_iqr_k * found[c]["iqr"]) for c in names if found[c]["count"]}
    cells = []
    for c, (low, high) in fences.items():
        v = finite(F.col(f"`{c}`"))
        inside = (v >= F.lit(low)) & (v <= F.lit(high))
        cells.append((c, low, high, F.count_if(~inside), F.count(v), F.min(F.when(inside, v)), F.max(F.when(inside, v))))
    schema = "column string, lower_bound double, upper_bound double, outliers long, outlier_pct double, whisker_low double, whisker_high double"
    if not cells:
        return df.sparkSession.createDataFrame([], schema)
    wide = df.agg(*[x.alias(f"m{k}_{i}") for k, row in enumerate(cells) for i, x in enumerate(row[3:])])
    at = lambda k, i: F.col(f"m{k}_{i}")
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(low).alias("lower_bound"), F.lit(high).alias("upper_bound"), at(k, 0).alias("outliers"), F.round(at(k, 0) / at(k, 1).cast("double") * 100, 3).alias("outlier_pct"),
            at(k, 2).alias("whisker_low"), at(k, 3).alias("whisker_high"),
        )
        for k, (c, low, high, *_) in enumerate(cells)
    ]
    return wide.select(F.inline(F.array(*rows)))


def _cells(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(column, v): the non-null values of named expressions, one below the other."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), x.alias("v")) for c, x in values.items()]))).where("v is not null")


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, bin, low, high, n) of each numeric column: equal-width bins, as many as the square root of the count, 5 to 30; the last one closed; empty bins included.

    Two reads of the table, whatever the number of columns. A column without values has no rows.
    """
    spark, schema = df.sparkSession, "column string, bin int, low double, high double"
    heads = {r["column"]: r for r in per_column(df, columns, {"n": lambda c: F.count(finite(c)), "lo": lambda c: F.min(finite(c)), "hi": lambda c: F.max(finite(c))}).collect()} if columns else {}
    places, bins = {}, []
    for c, head in heads.items():
        if not head["n"]:
            continue
        lo, hi = (head["lo"] - 0.5, head["hi"] + 0.5) if head["lo"] == head["hi"] else (head["lo"], head["hi"])
        many = int(min(30, max(5, head["n"] ** 0.5)))
        width = (hi - lo) / many
        v = finite(F.col(f"`{c}`"))
        places[c] = F.when(v.isNotNull(), F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(many - 1)).cast("int"))
        bins += [(c, k, lo + k * width, lo + (k + 1) * width) for k in range(many)]
    if not places:
        return spark.createDataFrame([], schema + ", n long")
    counts = _cells(df, places).groupBy("column", F.col("v").alias("bin")).agg(F.count("*").alias("n"))
    return spark.createDataFrame(bins, schema).join(counts, ["column", "bin"], "left").select("column", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(bin, low, high, n) of one column; see histograms."""
    return histograms(df, [column]).drop("column")


def densities(df: DataFrame, columns: list[str], points: int = 80) -> DataFrame:
    """(column, k, x, y) of each numeric column: Gaussian density on a grid from the minimum to the maximum, bandwidth by Scott's rule, over all values.

    Equal values are one row with a count before they meet the grid. A column has no rows
    unless there is spread, 30 values and more than 10 distinct ones. Three reads of the
    table, whatever the number of columns.
    """
    spark, schema = df.sparkSession, "column string, lo double, step double, h double, area double"
    grids = []
    if columns:
        counts = _cells(df, {c: finite(F.col(f"`{c}`")) for c in columns}).groupBy("column", "v").agg(F.count("*").alias("w"))
        several = {r["column"] for r in counts.groupBy("column").agg(F.count("*").alias("u")).where("u > 10").collect()}
        measures = {"n": lambda c: F.count(finite(c)), "sd": lambda c: F.stddev_samp(finite(c)), "lo": lambda c: F.min(finite(c)), "hi": lambda c: F.max(finite(c))}
        for r in per_column(df, columns, measures).collect():
            if r["n"] >= 30 and r["sd"] and r["column"] in several:
                h = r["sd"] * r["n"] ** (-1 / 5)
                grids.append((r["column"], r["lo"], (r["hi"] - r["lo"]) / (points - 1), h, r["n"] * h * (2 * 3.141592653589793) ** 0.5))
    if not grids:
        return spark.createDataFrame([], "column string, k int, x double, y double")
    own = F.broadcast(spark.createDataFrame(grids, schema))  # a row for each column
    x = F.col("lo") + F.col("k") * F.col("step")
    z = (x - F.col("v")) / F.col("h")
    grid = counts.join(own, "column").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    sums = grid.groupBy("column", "k").agg(F.sum(F.col("w") * F.exp(-z * z / 2)).alias("s"))
    return sums.join(own, "column").select("column", "k", x.alias("x"), (F.col("s") / F.col("area")).alias("y"))


def kde(df: DataFrame, column: str, points: int = 80) -> DataFrame:
    """(k, x, y) of one column; see densities."""
    return densities(df, [column], points).drop("column")


def categorical_stats(df: DataFrame, columns: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """One row per column: distinct values, mode, rare values and concentration."""
    counts = value_counts(df, columns)
    rows = df.agg(F.count("*").alias("rows"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique"))
    best = top_n(counts, 5, [F.desc("n"), F.asc("value")], ["column"])
    heads = best.groupBy("column").agg(F.sum("n").alias("top5"), F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("most_frequent"), F.max("n").alias("frequency"))
    rare = counts.join(totals, "column").groupBy("column").agg(F.count_if(F.col("n") / F.col("count").cast("double") < cfg.rare_category_share).alias("rare_categories"))
    n = F.col("count").cast("double")
    return (
        totals.join(heads, "column").join(rare, "column").crossJoin(F.broadcast(rows))  # one row
        .select(
            "column", "count", (F.col("rows") - F.col("count")).alias("missing"), "unique", F.round(F.col("unique") / n, 4).alias("cardinality_ratio"), "most_frequent", "frequency",
            F.round(F.col("frequency") / n * 100, 3).alias("frequency_pct"), C.cardinality_class(F.col("unique"), cfg).alias("cardinality_class"), "rare_categories", F.round(F.col("top5") / n * 100, 3).alias("top5_pct"),
        )
    )


def top_values(df: DataFrame, columns: list[str], top: int = 20) -> DataFrame:
    """(column, rank, value, n, pct): the most frequent values."""
    counts = value_counts(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return top_n(counts, top, [F.desc("n"), F.asc("value")], ["column"]).join(F.broadcast(totals), "column").select("column", "rank", "value", "n", F.round(F.col("n") / F.col("total").cast("double") * 100, 3).alias("pct"))


def plot_sample(df: DataFrame, key: str, rows: int = 50_000) -> DataFrame:
    """At most `rows` rows for a plot, the same ones however the table is cut: those with the smallest hash of `key`."""
    return df.orderBy(F.md5(F.concat(F.col(f"`{key}`").cast("string"), F.lit("-42")).cast("binary")), F.col(f"`{key}`")).limit(rows)


def rare_categories(df: DataFrame, column: str, cfg: Config = DEFAULT, share: float | None = None) -> DataFrame:
    """(value, n) of values below the rare share."""
    counts = value_counts(df, [column]).drop("column")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") / F.col("total").cast("double") < (cfg.rare_category_share if share is None else share)).select("value", "n")


def boolean_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_true, n_false, missing, true_pct, false_pct)."""
    out = per_column(df, columns, {"n_true": lambda c: F.count_if(c), "n_false": lambda c: F.count_if(~c), "missing": lambda c: F.count_if(c.isNull())})
    total = F.greatest(F.col("n_true") + F.col("n_false"), F.lit(1)).cast("double")
    return out.select("*", F.round(F.col("n_true") / total * 100, 3).alias("true_pct"), F.round(F.col("n_false") / total * 100, 3).alias("false_pct"))


def text_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, avg_length, median_length, missing, unique) over all rows."""
    lengths = per_column(df, columns, {"avg_length": lambda c: F.avg(F.length(c).cast("double")), "median_length": lambda c: F.percentile(F.length(c).cast("double"), F.lit(0.5)), "missing": lambda c: F.count_if(c.isNull())})
    hashes = F.array(*[F.struct(F.lit(c).alias("column"), F.md5(F.col(f"`{c}`").cast("binary")).alias("h")) for c in columns])
    unique = df.select(F.inline(hashes)).where("h is not null").distinct().groupBy("column").agg(F.count("*").alias("unique"))
    return lengths.join(unique, "column", "left").select("column", "avg_length", "median_length", "missing", F.coalesce("unique", F.lit(0)).alias("unique"))


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(C.TOKEN), F.lit(0))


def token_counts(df: DataFrame, column: str, top: int | None = 15) -> DataFrame:
    """(token, n): lower-cased tokens of three letters or more without stop words, over all rows; the most frequent ones."""
    counts = df.select(F.explode(_tokens(F.col(f"`{column}`"))).alias("token")).where(~F.col("token").isin(*STOP_WORDS)).groupBy("token").agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), F.asc("token")).limit(top)


def top_tokens(df: DataFrame, columns: list[str], top: int = 15) -> DataFrame:
    """(column, rank, token, n): the most frequent tokens of each text column, all columns in one read."""
    tokens = _cells(df, {c: _tokens(F.col(f"`{c}`")) for c in columns}).select("column", F.explode("v").alias("token"))
    counts = tokens.where(~F.col("token").isin(*STOP_WORDS)).groupBy("column", "token").agg(F.count("*").alias("n"))
    return top_n(counts, top, [F.desc("n"), F.asc("token")], ["column"]).select("column", "rank", "token", "n")


def datetime_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, min, max, duration_days, has_time)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    out = per_column(
        df, columns,
        {
            "missing": lambda c: F.count_if(c.isNull()), "min": lambda c: F.min(c.cast("timestamp_ntz")), "max": lambda c: F.max(c.cast("timestamp_ntz")),
            "duration_days": lambda c: (F.max(micros(c)) - F.min(micros(c))) / F.lit(86400e6), "has_time": lambda c: F.coalesce(F.max(F.date_format(c, "HHmmssSSSSSS") != "000000000000"), F.lit(False)),
        },
    )
    return out


_PARTS = {"year": F.year, "month": F.month, "weekday": F.weekday, "hour": F.hour}


def date_part_counts(df: DataFrame, column: str, part: str) -> DataFrame:
    """(part, n) by year, month, weekday (0 is Monday) or hour."""
    c = F.col(f"`{column}`")
    return df.where(c.isNotNull()).groupBy(_PARTS[part](c).cast("long").alias(part)).agg(F.count("*").alias("n"))


def all_date_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, part, value, n) by year, month, weekday and hour of each column, all in one read."""
    cells = [F.struct(F.lit(c).alias("column"), F.lit(p).alias("part"), f(F.col(f"`{c}`")).cast("long").alias("value")) for c in columns for p, f in _PARTS.items()]
    return df.select(F.inline(F.array(*cells))).where("value is not null").groupBy("column", "part", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """(column, unique): exact, or by a mergeable sketch."""
    if exact:
        found = value_counts(df, columns).groupBy("column").agg(F.count("*").alias("unique"))
        names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
        return names.join(found, "column", "left").select("column", F.coalesce("unique", F.lit(0)).alias("unique"))
    return per_column(df, columns, {"unique": lambda c: F.approx_count_distinct(c)})


def cap_categories(df: DataFrame, column: str, top: int = 50, other: str = "__other__") -> DataFrame:
    """The column with all but its `top` most frequent values replaced."""
    c = F.col(f"`{column}`")
    counts = df.where(c.isNotNull()).groupBy(c.alias("_v")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), F.asc("_v")).limit(top).select("_v")
    joined = df.join(F.broadcast(counts), c.eqNullSafe(F.col("_v")), "left")  # `top` rows
    return joined.withColumn(column, F.when(F.col("_v").isNotNull(), F.col("_v")).when(c.isNotNull(), F.lit(other))).drop("_v")


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and their share, rows that repeat others."""
    from sparkloom.operators.quality import duplicate_count

    cells = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{k}") for k, c in enumerate(df.columns)])
    missing = sum((F.col(f"m{k}") for k in range(len(df.columns))), F.lit(0))
    width = len(df.columns)
    head = cells.select("rows", F.lit(width).cast("long").alias("columns"), missing.alias("missing_cells"), F.round(missing / F.greatest(F.col("rows") * width, F.lit(1)).cast("double") * 100, 3).alias("missing_cell_pct"))
    return head.crossJoin(F.broadcast(duplicate_count(df).select(F.col("duplicates").alias("duplicate_rows"))))
