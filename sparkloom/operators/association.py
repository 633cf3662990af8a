"""Correlations and other associations, target analysis and leakage."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.config import DEFAULT, Config
from sparkloom.functions import columns as C
from sparkloom.operators.common import cumulative, finite, mean_ranks, numeric_columns
from sparkloom.operators.stats import cap_categories


def pearson(df: DataFrame, columns: list[str] | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(a, b, pearson) for each pair of numeric columns; rows without a finite number in either are left out of the pair.

    All pairs come from one aggregate over one read of the table. Without named columns
    these are the first corr_max_cols numeric ones; limited() tells whether that left any out.
    """
    names = columns or numeric_columns(df)[: cfg.corr_max_cols]
    pairs = list(combinations(names, 2))
    v = lambda c: finite(F.col(f"`{c}`"))
    wide = df.agg(*[F.corr(v(a), v(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("pearson")) for k, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows)).withColumn("pearson", F.when(~F.isnan("pearson"), F.col("pearson")))


def limited(columns: list[str], most: int) -> tuple[list[str], dict]:
    """The first `most` columns, and what is to be said of the rest."""
    return columns[:most], {"truncated": len(columns) > most, "used": min(len(columns), most), "columns": len(columns)}


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, spearman) for each pair of columns.

    Columns without nulls are ranked all at once: one unpivot to (row, column, value), ranks of
    distinct values within each column, one join back, and all correlations from one
    aggregate. A pair with nulls is ranked over the rows where both are present.
    """
    gaps = df.agg(*[F.count_if(finite(F.col(f"`{c}`")).isNull()).alias(f"g{k}") for k, c in enumerate(columns)]).first()
    whole = [c for k, c in enumerate(columns) if not gaps[f"g{k}"]]
    out = None
    if len(whole) > 1:
        rows = df.select(F.monotonically_increasing_id().alias("row"), F.array(*[finite(F.col(f"`{c}`")) for c in whole]).alias("values"))
        cells = rows.select("row", F.posexplode("values").alias("k", "value"))
        counts = cells.groupBy("k", "value").agg(F.count("*").alias("n"))
        ranks = cumulative(counts, "value", ["n"], "k").select("k", "value", (F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))
        wide = cells.join(ranks, ["k", "value"]).groupBy("row").agg(*[F.max(F.when(F.col("k") == k, F.col("rank"))).alias(f"r{k}") for k in range(len(whole))])
        pairs = list(combinations(range(len(whole)), 2))
        row = wide.agg(*[F.corr(f"r{i}", f"r{j}").alias(f"c{k}") for k, (i, j) in enumerate(pairs)])
        out = row.select(F.inline(F.array(*[F.struct(F.lit(whole[i]).alias("a"), F.lit(whole[j]).alias("b"), F.col(f"c{k}").alias("spearman")) for k, (i, j) in enumerate(pairs)])))
        out = out.withColumn("spearman", F.when(~F.isnan("spearman"), F.col("spearman")))
    for a, b in combinations(columns, 2):
        if a not in whole or b not in whole:
            one = spearman(df, a, b)
            out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "a string, b string, spearman double")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row with the rank correlation of two columns over rows where both are present, ties by mean rank."""
    x, y = finite(F.col(f"`{a}`")), finite(F.col(f"`{b}`"))
    both = df.where(x.isNotNull() & y.isNotNull()).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("w"))
    rows = df.where(x.isNotNull() & y.isNotNull()).select(x.alias("x"), y.alias("y"))
    rx = mean_ranks(rows, "x").select(F.col("value").alias("x"), F.col("rank").alias("rx"))
    ry = mean_ranks(rows, "y").select(F.col("value").alias("y"), F.col("rank").alias("ry"))
    p = both.join(rx, "x").join(ry, "y").withColumn("w", F.col("w").cast("double"))
    s = p.agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("rx")).alias("sx"), F.sum(F.col("w") * F.col("ry")).alias("sy"), F.sum(F.col("w") * F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(F.col("w") * F.col("ry") * F.col("ry")).alias("syy"), F.sum(F.col("w") * F.col("rx") * F.col("ry")).alias("sxy"),
    )
    n = F.col("n")
    spread = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    return s.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(spread > 0, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)).alias("spearman"))


def high_pairs(df: DataFrame, columns: list[str] | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Pairs with a Pearson correlation of corr_high or more either way, with their rank correlation, strongest first."""
    found = pearson(df, columns, cfg).where(F.abs("pearson") >= cfg.corr_high).collect()  # a row for each pair of columns at most
    if not found:
        return df.sparkSession.createDataFrame([], "a string, b string, pearson double, spearman double, strength string")
    names = list(dict.fromkeys(c for r in found for c in (r["a"], r["b"])))
    high = df.sparkSession.createDataFrame([tuple(r) for r in found], "a string, b string, pearson double")
    return high.join(spearman_matrix(df, names), ["a", "b"], "left").select("a", "b", "pearson", "spearman", C.strength_band(F.col("pearson"), cfg).alias("strength")).orderBy(F.desc(F.abs("pearson")), "a", "b")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of pairs that occur, as strings."""
    x, y = F.col(f"`{a}`").cast("string"), F.col(f"`{b}`").cast("string")
    return df.where(x.isNotNull() & y.isNotNull()).groupBy(x.alias("a"), y.alias("b")).agg(F.count("*").alias("n"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: bias-corrected Cramér's V of two columns; null below two levels on a side.

    Chi-squared needs only cells that occur: n * (sum o^2 / (row * column) - 1).
    """
    cells = crosstab(df, a, b)
    rows = cells.groupBy("a").agg(F.sum("n").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").cast("double").alias("n"))
    o = F.col("n").cast("double")
    s = cells.join(rows, "a").join(cols, "b").agg(F.sum(o * o / (F.col("ra").cast("double") * F.col("cb"))).alias("s"), F.count_distinct("a").cast("double").alias("r"), F.count_distinct("b").cast("double").alias("k"))
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    phi2 = F.greatest(F.lit(0.0), F.col("s") - 1 - (k - 1) * (r - 1) / (n - 1))
    d = F.least(k - F.pow(k - 1, F.lit(2)) / (n - 1), r - F.pow(r - 1, F.lit(2)) / (n - 1)) - 1
    return s.crossJoin(F.broadcast(total)).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when((r >= 2) & (k >= 2) & (n >= 2) & (d > 0), F.sqrt(phi2 / d)).alias("cramers_v"))


def categorical_pairs(df: DataFrame, columns: list[str], least: float = 0.5) -> DataFrame:
    """Pairs of columns whose Cramér's V reaches `least`."""
    out = None
    for a, b in combinations(columns, 2):
        v = cramers_v(df, a, b)
        out = v if out is None else out.unionByName(v)
    if out is None:
        return df.sparkSession.createDataFrame([], "a string, b string, cramers_v double")
    return out.where(F.col("cramers_v") >= least)


def correlation_ratio(df: DataFrame, category: str | Column, value: str | Column, name: str = "eta") -> DataFrame:
    """One row: the root of the share of the value's variance between categories; null below 3 rows or 2 categories, or without variance."""
    c = F.col(f"`{category}`") if isinstance(category, str) else category
    x = finite(F.col(f"`{value}`") if isinstance(value, str) else value)
    groups = df.where(c.isNotNull() & x.isNotNull()).groupBy(c.alias("c")).agg(F.count("*").cast("double").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    t = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("n") * F.col("v")).alias("ssw"))
    between = F.greatest(F.col("mm") - F.col("n") * F.col("mu") * F.col("mu"), F.lit(0.0))
    total = between + F.col("ssw")
    return t.select(F.when((F.col("n") >= 3) & (F.col("k") >= 2) & (total > 0), F.sqrt(between / total)).alias(name))


def class_distribution(df: DataFrame, target: str, top: int = 30) -> DataFrame:
    """(value, n, pct, n_classes, minority_pct, imbalance_ratio): the largest classes, and figures over all."""
    counts = df.where(F.col(f"`{target}`").isNotNull()).groupBy(F.col(f"`{target}`").cast("string").alias("value")).agg(F.count("*").alias("n"))
    t = counts.agg(F.sum("n").cast("double").alias("total"), F.count("*").alias("n_classes"), F.min("n").alias("low"), F.max("n").alias("high"))
    all_ = counts.crossJoin(F.broadcast(t))
    return all_.select(
        "value", "n", F.round(F.col("n") / F.col("total") * 100, 3).alias("pct"), "n_classes", F.round(F.col("low") / F.col("total") * 100, 3).alias("minority_pct"), F.round(F.col("high") / F.col("low").cast("double"), 3).alias("imbalance_ratio")
    ).orderBy(F.desc("n"), "value").limit(top)


def recommend_problem(n_unique: int, semantic_type: str, is_integer: bool) -> str | None:
    """classification, regression, or None where the column can't be a target."""
    if semantic_type in ("boolean", "categorical"):
        return "classification"
    if semantic_type != "numerical":
        return None
    return "classification" if n_unique == 2 or is_integer and n_unique <= 10 else "regression"


def target_associations(df: DataFrame, target: str, numeric: list[str], categorical: list[str], problem: str, cfg: Config = DEFAULT) -> DataFrame:
    """(feature, measure, strength, band), strongest first: Pearson or correlation ratio for numeric features, correlation ratio or Cramér's V for categorical ones.

    Categorical features keep their 50 most frequent values, with null as a value of its own.
    """
    df = df.where(F.col(f"`{target}`").isNotNull())
    parts = []
    if problem == "regression" and numeric:
        y = finite(F.col(f"`{target}`"))
        wide = df.agg(*[F.corr(finite(F.col(f"`{f}`")), y).alias(f"r{k}") for k, f in enumerate(numeric)])
        rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit("pearson").alias("measure"), F.abs(f"r{k}").alias("strength")) for k, f in enumerate(numeric)])
        parts.append(wide.select(F.inline(rows)))
    else:
        for f in numeric:
            parts.append(correlation_ratio(df, F.col(f"`{target}`").cast("string"), F.col(f"`{f}`")).select(F.lit(f).alias("feature"), F.lit("correlation_ratio").alias("measure"), F.col("eta").alias("strength")))
    for f in categorical:
        capped = cap_categories(df.select(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("nan")).alias(f), F.col(f"`{target}`")), f)
        if problem == "regression":
            parts.append(correlation_ratio(capped, f, target).select(F.lit(f).alias("feature"), F.lit("correlation_ratio").alias("measure"), F.col("eta").alias("strength")))
        else:
            parts.append(cramers_v(capped, f, target).select(F.lit(f).alias("feature"), F.lit("cramers_v").alias("measure"), F.col("cramers_v").alias("strength")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where(F.col("strength").isNotNull() & ~F.isnan("strength"))
    return out.withColumn("band", C.strength_band(F.col("strength"), cfg)).orderBy(F.desc("strength"), "feature")


def identical_share(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(feature, same): share of rows with both present where feature and target read the same; one aggregate."""
    t = F.col(f"`{target}`").cast("string")
    wide = df.agg(*[F.avg((F.col(f"`{f}`").cast("string") == t).cast("double")).alias(f"s{k}") for k, f in enumerate(features)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"s{k}").alias("same")) for k, f in enumerate(features)])))


def leakage_suspects(df: DataFrame, target: str, numeric: list[str], categorical: list[str], problem: str, cfg: Config = DEFAULT) -> DataFrame:
    """(feature, strength, reason): features that repeat the target, or associate with it at leakage_assoc or more."""
    same = identical_share(df, target, numeric + categorical).where("same > 0.99").select("feature", F.lit(1.0).alias("strength"), F.lit("identical").alias("reason"))
    near = target_associations(df, target, numeric, categorical, problem, cfg).where(F.col("strength") >= cfg.leakage_assoc).select("feature", "strength", F.col("measure").alias("reason"))
    return same.unionByName(near.join(same, "feature", "left_anti"))
