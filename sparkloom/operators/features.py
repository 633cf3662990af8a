"""Features for models: splits, imputation, scaling, encodings. What is learned comes from training rows only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.config import DEFAULT, Config
from sparkloom.functions import columns as C
from sparkloom.operators.common import QUANTILE_ROWS, exact_quantiles, finite, per_column, value_counts


def spread(key: str, seed: int = 42) -> Column:
    """A pseudo-random order that is the same on every run and layout: the md5 of key and seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary"))


def stratified_split(df: DataFrame, key: str, label: str | None, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds part: test for round(test * n) rows of each class (or of all), train for the others."""
    if not 0.05 < test < 0.5:
        raise ValueError("the test share must lie between 0.05 and 0.5")
    group = F.col(label) if label else F.lit(0)
    ranked = _ranked(df, key, group, seed)
    return ranked.withColumn("part", F.when(F.col("_k") < F.round(F.col("_n") * test), "test").otherwise("train")).drop("_k", "_n")


def kfold(df: DataFrame, key: str, label: str | None, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold, 0 .. folds - 1, dealt evenly within each class (or over all)."""
    ranked = _ranked(df, key, F.col(label) if label else F.lit(0), seed)
    return ranked.withColumn("fold", (F.col("_k") % folds).cast("int")).drop("_k", "_n")


def _ranked(df: DataFrame, key: str, group: Column, seed: int) -> DataFrame:
    """Adds _k, the place in its group by hash, and _n, the group's size. Groups are cut by the hash's first byte, so no window holds a whole group."""
    own = df.withColumn("_g", group).withColumn("_h", spread(key, seed)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = own.groupBy("_g", "_b").agg(F.count("*").alias("_s"))
    over = Window.partitionBy("_g").orderBy("_b")
    starts = sizes.select("_g", "_b", (F.sum("_s").over(over) - F.col("_s")).alias("_start"), F.sum("_s").over(Window.partitionBy("_g")).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h", key)) - 1
    joined = own.withColumn("_place", place).join(starts.withColumnsRenamed({"_g": "_g2", "_b": "_b2"}), F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_b") == F.col("_b2")))
    return joined.withColumn("_k", F.col("_start") + F.col("_place")).drop("_g", "_h", "_b", "_g2", "_b2", "_start", "_place")


def expand_datetime(c: str, has_time: bool) -> dict[str, Column]:
    """Calendar parts and their sine and cosine."""
    v = F.col(f"`{c}`")
    parts = {"year": F.year(v), "month": F.month(v), "day": F.dayofmonth(v), "weekday": F.weekday(v)} | ({"hour": F.hour(v)} if has_time else {})
    out = {f"{c}__{k}": p.cast("double") for k, p in parts.items()}
    for k, period in (("month", 12), ("weekday", 7), ("hour", 24)):
        if k in parts:
            out[f"{c}__{k}_sin"], out[f"{c}__{k}_cos"] = C.cyclical(parts[k], period)
    return out


@dataclass
class Field:
    """An input column: numeric, bool, datetime or category."""

    name: str
    kind: str
    has_time: bool = False


def make_spec(df: DataFrame, columns: list[str]) -> list[Field]:
    """Kinds by Spark type; datetimes are asked, in one aggregate, whether any has a time of day."""
    types = dict(df.dtypes)
    dates = [c for c in columns if types[c].startswith(("timestamp", "date"))]
    timed = {r["column"]: r["t"] for r in per_column(df, dates, {"t": lambda c: F.max(F.date_format(c, "HHmmss") != "000000")}).collect()} if dates else {}
    kind = lambda c: "datetime" if c in dates else "bool" if types[c] == "boolean" else "category" if types[c] == "string" else "numeric"
    return [Field(c, kind(c), bool(timed.get(c))) for c in columns]


def expand_features(df: DataFrame, spec: list[Field], keep: list[str]) -> DataFrame:
    """Model columns in one projection: numbers and booleans as doubles, datetimes as calendar parts, categories as strings; absent columns are null."""
    out: dict[str, Column] = {}
    for f in spec:
        present = f.name in df.columns
        c = F.col(f"`{f.name}`") if present else F.lit(None)
        if f.kind == "datetime":
            parts = expand_datetime(f.name, f.has_time)
            out |= parts if present else {k: F.lit(None).cast("double") for k in parts}
        else:
            out[f.name] = c.cast("string") if f.kind == "category" else finite(c)
    return df.select(*[F.col(f"`{k}`") for k in keep], *[v.alias(k) for k, v in out.items()])


def medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians of the training rows."""
    return {c: q[0] for c, q in exact_quantiles(train, {c: F.col(f"`{c}`") for c in columns}, [0.5]).items()}


def impute(df: DataFrame, values: dict[str, float], indicators: list[str]) -> DataFrame:
    """Nulls filled; <column>_missing is 1 where they were."""
    flags = {f"{c}_missing": F.col(f"`{c}`").isNull().cast("double") for c in indicators}
    return df.withColumns(flags | {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(v if v is not None else 0.0)) for c, v in values.items()})


def log_columns(train: DataFrame, columns: list[str], cfg: Config = DEFAULT) -> list[str]:
    """Non-negative columns whose skewness passes skew_strong on the training rows."""
    rows = per_column(train, columns, {"lo": lambda c: F.min(c), "s": lambda c: C.bias_corrected_skew(c.cast("double"), F.count(c))}).collect()
    return [r["column"] for r in rows if r["lo"] is not None and r["lo"] >= 0 and r["s"] is not None and r["s"] > cfg.skew_strong]


def standard_scale(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation of the training rows; columns without spread are only centred."""
    rows = per_column(train, columns, {"m": lambda c: F.avg(c.cast("double")), "s": lambda c: F.stddev_pop(c.cast("double"))}).collect()
    return df.withColumns({r["column"]: (F.col(f"`{r['column']}`") - F.lit(r["m"])) / F.lit(r["s"] or 1.0) for r in rows})


def frequencies(train: DataFrame, column: str) -> DataFrame:
    """(value, share) of the training rows."""
    counts = value_counts(train, [column]).drop("column")
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("value", (F.col("n") / F.col("t").cast("double")).alias("share"))


def frequency_encode(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """Adds <column>_freq: the share of the value among training rows, 0 for unseen and null.

    A plain join: Spark broadcasts the shares where they are small and sorts both sides
    where there are very many categories.
    """
    shares = frequencies(train, column).withColumnsRenamed({"value": "_value", "share": f"{column}_freq"})
    return df.join(shares, F.col(f"`{column}`").cast("string") == F.col("_value"), "left").drop("_value").fillna(0.0, [f"{column}_freq"])


def one_hot_levels(train: DataFrame, column: str, cfg: Config = DEFAULT) -> tuple[list[str], list[str]]:
    """Frequent levels, and those below 1 % that share one column; null counts as 'missing'. For columns of at most ohe_max_categories levels."""
    counts = train.groupBy(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("missing")).alias("v")).agg(F.count("*").alias("n")).orderBy("v").limit(cfg.ohe_max_categories + 2).collect()
    total = sum(r["n"] for r in counts)
    return [r["v"] for r in counts if r["n"] >= 0.01 * total], [r["v"] for r in counts if r["n"] < 0.01 * total]


def one_hot(df: DataFrame, column: str, levels: list[str], rare: list[str]) -> DataFrame:
    """A 0/1 column per level (for two levels in all, only the second) and one for rare and unknown ones if any were rare."""
    v = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("missing"))
    kept = levels[1:] if len(levels) == 2 and not rare else levels
    out = {f"{column}_{level}": (v == level).cast("double") for level in kept}
    if rare:
        out[f"{column}_infrequent"] = (~v.isin(*levels)).cast("double") if levels else F.lit(1.0)
    return df.withColumns(out)


#: Classes that a target may have.
MAX_CLASSES = 1000


def label_classes(df: DataFrame, target: str) -> list[str]:
    """Class names in order; a target of one class or of more than MAX_CLASSES is refused before its classes are gathered."""
    counts = df.where(F.col(f"`{target}`").isNotNull()).groupBy(F.col(f"`{target}`").cast("string").alias("v")).agg(F.count("*").alias("n"))
    names = [r["v"] for r in counts.orderBy("v").limit(MAX_CLASSES + 1).collect()]
    if len(names) < 2:
        raise ValueError("the target has one class only")
    if len(names) > MAX_CLASSES:
        raise ValueError(f"the target has more than {MAX_CLASSES} classes")
    return names


def label_encode(df: DataFrame, target: str, classes: list[str], into: str = "label") -> DataFrame:
    """Adds the place of the class among the ordered names, as a double."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(f"`{target}`").cast("string"))
    return df.withColumn(into, F.when(at > 0, (at - 1).cast("double")))


def typical_row(train: DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, object]:
    """Median of each numeric column and most frequent value of each categorical one."""
    out: dict[str, object] = dict(medians(train, numeric)) if numeric else {}
    if categorical:
        counts = value_counts(train, categorical).groupBy("column").agg(F.min(F.struct(-F.col("n"), "value")).alias("top"))
        out |= {r["column"]: r["top"]["value"] for r in counts.collect()}
    return out


def select_features(meta: list, target: str, keep: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> tuple[list, list[dict]]:
    """Columns to model, and why each of the others is left out. The first reason that holds is given."""
    chosen, left_out = [], []
    for m in meta:
        if m.name == target:
            continue
        reasons = (
            (m.name in drop, "left out on request"), (m.semantic_type == "empty", "no values"), (m.constant, "one value throughout"),
            (m.semantic_type == "identifier" and m.name not in keep, f"{m.identifier_level} identifier"), (m.semantic_type == "text", "free text"),
        )
        why = next((r for holds, r in reasons if holds), None)
        if why is None:
            chosen.append(m)
        else:
            left_out.append({"column": m.name, "action": "excluded", "reason": why})
    return chosen, left_out


@dataclass
class Preprocessor:
    """Statistics of training rows, and the columns they make of any rows: fit once per fold."""

    linear: bool
    cfg: Config = field(default_factory=Config)

    def fit(self, train: DataFrame, numeric: list[str], categorical: list[str]) -> Preprocessor:
        self.logs = log_columns(train, numeric, self.cfg) if self.linear and numeric else []
        counts = {r["column"]: r["n"] for r in value_counts(train, categorical).groupBy("column").agg(F.count("*").alias("n")).collect()} if categorical else {}
        self.low = [c for c in categorical if counts.get(c, 0) <= self.cfg.ohe_max_categories]
        self.high = [c for c in categorical if c not in self.low]
        self.numeric = numeric
        logged = self._log(train)
        rows = per_column(logged, numeric, {"gap": lambda c: F.count_if(c.isNull())}).collect() if numeric else []
        self.medians, self.gaps = medians(logged, numeric) if numeric else {}, [r["column"] for r in rows if r["gap"]]
        self.levels = {c: one_hot_levels(train, c, self.cfg) for c in self.low}
        self.shares = {c: frequencies(train, c) for c in self.high}
        self.scaled: dict[str, tuple[float, float]] = {}
        self.inputs = [*numeric, *(f"{c}_missing" for c in self.gaps)]
        if self.linear:
            self._scale(train, [*self.inputs, *(f"{c}_freq" for c in self.high)])
        return self._named(train)

    def _scale(self, train: DataFrame, names: list[str]) -> None:
        rows = per_column(self._expand(train), names, {"m": lambda c: F.avg(c), "s": lambda c: F.stddev_pop(c)}).collect() if names else []
        self.scaled |= {r["column"]: (r["m"], r["s"] or 1.0) for r in rows}

    def _named(self, train: DataFrame) -> Preprocessor:
        first = self._expand(train.limit(0)).columns
        self.inputs = [c for c in first if c not in train.columns or c in self.numeric]
        if not self.inputs:
            raise ValueError("no usable features")
        return self

    def _log(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(F.col(f"`{c}`") > -1, F.log1p(f"`{c}`")) for c in self.logs})

    def _expand(self, df: DataFrame) -> DataFrame:
        out = impute(self._log(df), self.medians, self.gaps)
        for c, (levels, rare) in self.levels.items():
            out = one_hot(out, c, levels, rare)
        for c, shares in self.shares.items():
            named = shares.withColumnsRenamed({"value": "_value", "share": f"{c}_freq"})
            out = out.join(named, F.col(f"`{c}`").cast("string") == F.col("_value"), "left").drop("_value").fillna(0.0, [f"{c}_freq"])
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return self._expand(df).withColumns({c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(s) for c, (m, s) in self.scaled.items()})


def fit_folds(dealt: DataFrame, folds: int, linear: bool, numeric: list[str], categorical: list[str], cfg: Config | None = None) -> list[Preprocessor]:
    """What Preprocessor.fit learns from the rows outside each fold, and from all: every statistic of all parts comes from the same jobs.

    dealt: rows with `fold`, 0 .. folds - 1. A part's statistic is an aggregate in which the rows of its fold are null.
    """
    made = [Preprocessor(linear, cfg or Config()) for _ in range(folds + 1)]
    inside = lambda k, c: c if k == folds else F.when(F.col("fold") != k, c)
    every = [(k, c) for k in range(folds + 1) for c in numeric]
    masked = lambda columns: dealt.select(*[inside(k, x).alias(f"{k}:{c}") for (k, c), x in columns.items()])
    name = lambda key: f"{key[0]}:{key[1]}"
    plain = {(k, c): F.col(f"`{c}`") for k, c in every}
    logs = log_columns(masked(plain), [*map(name, every)], made[0].cfg) if linear and numeric else []
    for k, prep in enumerate(made):
        prep.numeric, prep.logs = numeric, [c for c in numeric if f"{k}:{c}" in logs]
    logged = {(k, c): F.when(x > -1, F.log1p(x)) if c in made[k].logs else x for (k, c), x in plain.items()}
    gaps = dealt.agg(*[F.count_if(inside(k, x.isNull())).alias(name((k, c))) for (k, c), x in logged.items()]).first() if numeric else {}
    middle = exact_quantiles(masked(logged), {name(key): F.col(f"`{name(key)}`") for key in every}, [0.5], max(1 << 12, QUANTILE_ROWS // len(every))) if numeric else {}
    distinct, levels = _fold_levels(dealt, folds, categorical, made[0].cfg) if categorical else ({}, {})
    for k, prep in enumerate(made):
        prep.low = [c for c in categorical if distinct.get((k, c), 0) <= prep.cfg.ohe_max_categories]
        prep.high = [c for c in categorical if c not in prep.low]
        prep.medians, prep.gaps = {c: middle[f"{k}:{c}"][0] for c in numeric}, [c for c in numeric if gaps[f"{k}:{c}"]]
        prep.levels = {c: levels.get((k, c), ([], [])) for c in prep.low}
        part = dealt if k == folds else dealt.where(F.col("fold") != k)
        prep.shares = {c: frequencies(part, c) for c in prep.high}
        prep.scaled, prep.inputs = {}, [*numeric, *(f"{c}_missing" for c in prep.gaps)]
    if linear and numeric:
        filled = {(k, c): F.coalesce(x, F.lit(made[k].medians[c] if made[k].medians[c] is not None else 0.0)) for (k, c), x in logged.items()}
        filled |= {(k, f"{c}_missing"): F.col(f"`{c}`").isNull().cast("double") for k, prep in enumerate(made) for c in prep.gaps}
        for r in per_column(masked(filled), [*map(name, filled)], {"m": lambda c: F.avg(c), "s": lambda c: F.stddev_pop(c)}).collect():
            k, _, c = r["column"].partition(":")
            made[int(k)].scaled[c] = (r["m"], r["s"] or 1.0)
    for k, prep in enumerate(made):
        part = (dealt if k == folds else dealt.where(F.col("fold") != k)).drop("fold")
        if linear and prep.high:
            prep._scale(part, [f"{c}_freq" for c in prep.high])
        prep._named(part)
    return made


def _fold_levels(dealt: DataFrame, folds: int, columns: list[str], cfg: Config) -> tuple[dict, dict]:
    """By (part, column): the number of distinct values, and for columns of few the levels as one_hot_levels gives them."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    counts = dealt.select("fold", F.inline(cells)).groupBy("column", "value").agg(*[F.count_if(F.col("fold") != k).alias(f"n{k}") for k in range(folds)], F.count("*").alias(f"n{folds}"))
    rows = counts.where("value is not null").groupBy("column").agg(*[F.count_if(F.col(f"n{k}") > 0).alias(f"n{k}") for k in range(folds + 1)]).collect()
    distinct = {(k, r["column"]): r[f"n{k}"] for r in rows for k in range(folds + 1)}
    low = [f"{k}:{c}" for k in range(folds + 1) for c in columns if distinct.get((k, c), 0) <= cfg.ohe_max_categories]
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.col(f"n{k}").alias("n")) for k in range(folds + 1)])
    own = counts.select("column", F.coalesce("value", F.lit("missing")).alias("v"), F.inline(parts)).where((F.col("n") > 0) & F.concat_ws(":", F.col("part").cast("string"), "column").isin(low))
    found: dict = {}
    for r in own.groupBy("part", "column", "v").agg(F.sum("n").alias("n")).orderBy("v").collect():  # at most ohe_max_categories and one for each part and column
        found.setdefault((r["part"], r["column"]), []).append((r["v"], r["n"]))
    share = lambda rows: 0.01 * sum(n for _, n in rows)
    return distinct, {key: ([v for v, n in rows if n >= share(rows)], [v for v, n in rows if n < share(rows)]) for key, rows in found.items()}
