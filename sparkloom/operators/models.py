"""Baseline models over a table: leak-free preprocessing, cross-validated comparison, prediction, explanation.

Fitting is distributed (pyspark.ml, boosting and forests of this library); the driver holds the leaderboard and the learned
statistics only. Every statistic is fitted on the training rows of its own fold.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.config import DEFAULT, Config
from sparkloom.operators import features as FE
from sparkloom.operators import forest as FO
from sparkloom.operators import metrics as M
from sparkloom.operators import trees as TR
from sparkloom.operators.boosting import Boosted, Boosting
from sparkloom.operators.boosting import fit as boost
from sparkloom.operators.common import exact_quantiles, finite, per_column
from sparkloom.sources.scratch import new_folder

CLS_METRICS, REG_METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"), ("r2", "mae", "rmse")
LOWER_IS_BETTER = {"mae", "rmse"}


@dataclass
class Settings:
    """What to train: problem is classification or regression; sizes override the defaults of each model family; folds are 5, or 3 above 50 000 training rows, unless given."""

    target: str
    problem: str
    key: str
    test_share: float = 0.2
    folds: int | None = None
    primary: str | None = None
    models: tuple[str, ...] = ("logreg", "linear", "rf", "gbt")
    keep: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    regularisation: float = 1.0
    rf_trees: int = 200
    rf_depth: int = 14
    rf_leaf: int = 2
    gbt_trees: int = 250
    gbt_depth: int = 5
    gbt_rate: float = 0.08

    def check(self) -> None:
        """Raises ValueError for sizes that no model can have."""
        if self.problem not in ("classification", "regression"):
            raise ValueError("the problem is classification or regression")
        if self.folds is not None and not 2 <= self.folds <= 20:
            raise ValueError("folds are 2 to 20")
        if unknown := set(self.models) - {"logreg", "linear", "rf", "gbt"}:
            raise ValueError(f"unknown models: {', '.join(sorted(unknown))}")
        if min(self.rf_trees, self.gbt_trees, self.rf_leaf) < 1 or max(self.rf_trees, self.gbt_trees) > 5000:
            raise ValueError("trees are 1 to 5000, and a leaf has a row at least")
        if not 1 <= min(self.rf_depth, self.gbt_depth) <= max(self.rf_depth, self.gbt_depth) <= 30 or self.gbt_depth > 12:
            raise ValueError("forests are 1 to 30 levels deep, boosted trees 1 to 12")
        if not 0 < self.gbt_rate <= 1 or not self.regularisation > 0:
            raise ValueError("the learning rate is above 0 and at most 1, regularisation above 0")


@dataclass
class Fitted:
    """A model with the preprocessing it was fitted behind."""

    key: str
    prep: FE.Preprocessor | None
    model: object
    classes: list[str] | None

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds p (class place or value) and, for classes, proba: an array by class."""
        if self.prep is None:
            p, proba = self.constant()
            return rows.withColumn("p", p) if proba is None else rows.withColumns({"p": p, "proba": proba})
        if isinstance(self.model, Boosted):
            return self.model.transform(self.prep.transform(rows), self.prep.inputs)
        made = VectorAssembler(inputCols=self.prep.inputs, outputCol="features", handleInvalid="keep").transform(self.prep.transform(rows))
        out = self.model.transform(made)
        if self.classes is None:
            return out.withColumn("p", F.col("prediction")).drop("prediction", "features")
        return out.withColumn("p", F.col("prediction")).withColumn("proba", vector_to_array("probability")).drop("prediction", "features", "rawPrediction", "probability")

    def constant(self) -> tuple[Column, Column | None]:
        """What a baseline says of every row."""
        if self.classes is None:
            return F.lit(float(self.model)), None
        shares = [float(v) for v in self.model]
        return F.lit(float(shares.index(max(shares)))), F.array(*map(F.lit, shares))


def families(s: Settings, n_classes: int, weighted: bool, n_train: int) -> dict[str, tuple[object, bool]]:
    """Estimators by key, with whether each is linear."""
    weight = {"weightCol": "weight"} if weighted else {}
    common = {"featuresCol": "features", "labelCol": "label"}
    forest = FO.Forest(n_classes, s.rf_trees, s.rf_depth, s.rf_leaf, seed=DEFAULT.random_state)
    boosting = Boosting(n_classes, s.gbt_trees, s.gbt_depth, s.gbt_rate, seed=DEFAULT.random_state)
    if s.problem == "classification":
        every = {
            "logreg": (LogisticRegression(**common, maxIter=200, regParam=1 / (s.regularisation * max(1, n_train)), standardization=False, **weight), True),
            "rf": (forest, False),
            "gbt": (boosting, False),
        }
    else:
        every = {"linear": (LinearRegression(**common, regParam=0.0), True), "rf": (forest, False), "gbt": (boosting, False)}
    return {k: v for k, v in every.items() if k in s.models}


#: Rows of a part that an iteration of a linear model leaves to one task.
TASK_ROWS = 25_000


def _fit_dummies(dealt: DataFrame, folds: int, classes: list[str] | None) -> list[Fitted]:
    """Shares of classes, or the mean, of the rows outside each fold and of all."""
    rows = dealt.groupBy("fold", *(["label"] if classes else [])).agg(F.count("*").alias("n"), F.sum("label").alias("total")).collect()  # a row for each fold and class
    found = []
    for k in range(folds + 1):
        own = [r for r in rows if r["fold"] != k]
        n = sum(r["n"] for r in own)
        found.append(Fitted("dummy", None, [sum(r["n"] for r in own if r["label"] == c) / n for c in range(len(classes))] if classes else sum(r["total"] for r in own) / n, classes))
    return found


def _fit_linear(key: str, est, parts: list[DataFrame], preps: list[FE.Preprocessor], classes: list[str] | None, n_train: int) -> list[Fitted]:
    """One model for each part, side by side: small parts leave most of their time to starting jobs."""

    def one(rows: DataFrame, prep: FE.Preprocessor) -> Fitted:
        data = VectorAssembler(inputCols=prep.inputs, outputCol="features", handleInvalid="keep").transform(prep.transform(rows))
        data = data.select("features", "label", *[c for c in ("weight",) if c in data.columns]).coalesce(max(1, -(-n_train // TASK_ROWS)))
        return Fitted(key, prep, est.copy().fit(data), classes)

    with ThreadPool(len(parts)) as pool:
        return pool.starmap(inheritable_thread_target(parts[0].sparkSession)(one), zip(parts, preps))


def _fit_trees(key: str, settings: Boosting | FO.Forest, parts: list[DataFrame], preps: list[FE.Preprocessor], classes: list[str] | None, row_key: str) -> list[Fitted]:
    """One ensemble for each part, grown together. Each part is prepared by its own statistics."""
    stacked = None
    for k, (prep, rows) in enumerate(zip(preps, parts)):
        made = prep.transform(rows)
        weight = F.col("weight").cast("double") if "weight" in made.columns else F.lit(1.0)
        own = made.select(F.lit(k).alias("member"), F.array(*[F.col(f"`{c}`").cast("double") for c in prep.inputs]).alias("x"), F.col("label").cast("double").alias("label"), weight.alias("weight"), F.xxhash64(F.col(f"`{row_key}`").cast("string")).alias("seed"))
        stacked = own if stacked is None else stacked.unionByName(own)
    grow, kind = (boost, Boosted) if isinstance(settings, Boosting) else (FO.fit, FO.Forested)
    return [Fitted(key, prep, kind(trees, settings.classes), classes) for prep, trees in zip(preps, grow(stacked, len(parts), settings))]


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that no later plan repeats how it came about; where there is none, kept in memory."""
    try:
        path = new_folder(df.sparkSession, "training")
    except ValueError:
        return df.persist()
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).persist()


def score_each(grown: dict[str, list[Fitted]], parts: list[DataFrame]) -> dict[str, list[dict[str, float | None]]]:
    """All metrics of each family's models on the rows held out from each, from the same jobs. Rows of a part are prepared once for all tree models."""
    out, families_of, sent = None, list(grown), []
    classes = grown[families_of[0]][0].classes
    for k, rows in enumerate(parts):
        together: dict[str, list[tuple[int, Fitted]]] = {}
        for at, key in enumerate(families_of):
            own = grown[key][k]
            together.setdefault("trees" if isinstance(own.model, Boosted) else key, []).append((at * len(parts) + k, own))
        baselines = together.pop("dummy", []) if len(together) > 1 else []
        for own in together.values():
            if isinstance(own[0][1].model, Boosted):
                prep = own[0][1].prep
                made = prep.transform(rows)
                made = made.withColumns({f"_out{g}": f.model.outputs(prep.inputs, made.sparkSession, sent) for g, f in own})
                found = [(g, *f.model.named(F.col(f"_out{g}"))) for g, f in own]
            else:
                made = own[0][1].predict(rows)
                found = [(own[0][0], F.col("p"), F.col("proba") if classes else None)]
            while baselines:
                g, f = baselines.pop()
                found.append((g, *f.constant()))
            structs = [F.struct(F.lit(g).alias("group"), F.col("label").alias("y"), p.cast("double").alias("p"), *([proba.alias("proba")] if classes else [])) for g, p, proba in found]
            made = made.select(F.inline(F.array(*structs)))
            out = made if out is None else out.unionByName(made)
    out = _kept(out)
    try:
        scores = M.by_group(out, len(classes) if classes else None)
    finally:
        out.unpersist()
        for shared in sent:  # the driver keeps them otherwise
            shared.destroy()
    return {key: [scores[at * len(parts) + k] for k in range(len(parts))] for at, key in enumerate(families_of)}


def score(fitted: Fitted, rows: DataFrame) -> dict[str, float | None]:
    """All metrics of a model on rows with a label."""
    out = fitted.predict(rows).select(F.col("label").alias("y"), "p", *(["proba"] if fitted.classes else [])).persist()
    try:
        if fitted.classes is None:
            return M.regression(out).first().asDict()
        n = len(fitted.classes)
        found = M.classification(out, 1.0 if n == 2 else None).first().asDict()
        aucs = [M.roc_auc(out.select((F.col("y") == k).cast("int").alias("y"), F.col("proba")[k].alias("score"))).first()["roc_auc"] for k in ([1] if n == 2 else range(n))]
        found["roc_auc"] = None if None in aucs else fmean(aucs)
        found["pr_auc"] = M.average_precision(out.select(F.col("y").cast("int").alias("y"), F.col("proba")[1].alias("score"))).first()["average_precision"] if n == 2 else None
        return found
    finally:
        out.unpersist()


@dataclass
class Result:
    """Outcome of a training run."""

    problem: str
    target: str
    classes: list[str] | None
    primary: str
    board: list[dict]
    leader: str
    beats_baseline: bool
    fitted: dict[str, Fitted]
    spec: list[FE.Field]
    numeric: list[str]
    categorical: list[str]
    typical: dict[str, object]
    split: dict[str, int]
    imbalanced: bool
    decisions: list[dict] = field(default_factory=list)
    test: DataFrame | None = None

    @property
    def model(self) -> Fitted:
        return self.fitted[self.leader]

    def leaderboard(self, spark: SparkSession) -> DataFrame:
        rows = [(r["key"], r["key"] == "dummy", r["status"], r.get("primary_cv"), r.get("primary_cv_std"), (r.get("test") or {}).get(self.primary), r.get("delta_vs_baseline"), r["key"] == self.leader) for r in self.board]
        return spark.createDataFrame(rows, "model string, baseline boolean, status string, cv double, cv_std double, test double, delta_vs_baseline double, leader boolean")


def train(df: DataFrame, columns: list[str], s: Settings, cfg: Config = DEFAULT) -> Result:
    """Splits, cross-validates each family on the training rows, refits and scores once on the held-out rows.

    The leader has the best mean primary metric among models that are no baselines; a
    model that fails is recorded and the others go on.
    """
    s.check()
    if s.target not in df.columns:
        raise ValueError(f"no column {s.target}")
    columns = [c for c in columns if c not in (s.target, s.key, *s.drop)]
    if not columns:
        raise ValueError("no usable features")
    known = df.where(F.col(f"`{s.target}`").isNotNull())
    spec = FE.make_spec(known, columns)
    made = FE.expand_features(known, spec, [s.key, s.target])
    classes = FE.label_classes(made, s.target) if s.problem == "classification" else None
    labelled = FE.label_encode(made, s.target, classes) if classes else made.withColumn("label", F.col(f"`{s.target}`").cast("double"))
    labelled = labelled.drop(s.target)
    split = _kept(FE.stratified_split(labelled, s.key, "label" if classes else None, s.test_share, cfg.random_state))
    train_rows, test_rows = split.where("part = 'train'").drop("part"), split.where("part = 'test'").drop("part")
    sizes = {r["part"]: r["n"] for r in split.groupBy("part").agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) < cfg.min_rows_model:
        raise ValueError(f"at least {cfg.min_rows_model} labelled rows are needed")
    types = dict(labelled.dtypes)
    inputs = [c for c in labelled.columns if c not in (s.key, "label")]
    numeric, categorical = [c for c in inputs if types[c] == "double"], [c for c in inputs if types[c] == "string"]

    counts = {r["label"]: r["n"] for r in train_rows.groupBy("label").agg(F.count("*").alias("n")).collect()} if classes else {}
    if classes and min(counts.get(float(k), 0) for k in range(len(classes))) < 2:
        raise ValueError("a class has fewer than 2 rows")
    imbalanced = bool(classes) and min(counts.values()) / sum(counts.values()) < cfg.imbalance_minority_share
    if imbalanced:  # weights that give every class the same total
        weights = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(sum(counts.values()) / (len(counts) * n)))])
        train_rows = train_rows.withColumn("weight", weights[F.col("label")])
    allowed = [m for m in CLS_METRICS if m != "pr_auc" or len(classes) == 2] if classes else list(REG_METRICS)
    primary = s.primary or ("rmse" if not classes else "pr_auc" if len(classes) == 2 and imbalanced else "f1")
    if primary not in allowed:
        raise ValueError(f"{primary} is not one of {allowed}")
    asked = s.folds or (5 if sizes["train"] <= 50_000 else 3)
    folds = max(2, min(asked, *counts.values()) if classes else asked)
    dealt = _kept(FE.kfold(train_rows, s.key, "label" if classes else None, folds, cfg.random_state))

    parts = [*[dealt.where(F.col("fold") != k).drop("fold") for k in range(folds)], dealt.drop("fold")]  # each fold's training rows, and all
    known_preps: dict[bool, list[FE.Preprocessor]] = {}

    def prepared(linear: bool) -> list[FE.Preprocessor]:
        """What each part's rows say, fitted once for linear models and once for trees."""
        if linear not in known_preps:
            known_preps[linear] = FE.fit_folds(dealt, folds, linear, numeric, categorical)
        return known_preps[linear]

    board, grown = [], {}
    candidates = {"dummy": (None, False), **families(s, len(classes or []), imbalanced, sizes["train"])}
    for key, (est, linear) in candidates.items():
        row: dict = {"key": key, "status": "ok"}
        try:
            began = time.time()
            if est is None:
                grown[key] = _fit_dummies(dealt, folds, classes)
            elif isinstance(est, (Boosting, FO.Forest)):  # the folds and the final fit in the same jobs
                grown[key] = _fit_trees(key, est, parts, prepared(linear), classes, s.key)
            else:
                grown[key] = _fit_linear(key, est, parts, prepared(linear), classes, sizes["train"])
            row["train_time_s"] = time.time() - began  # of all folds and the final fit
        except Exception as e:  # one model's failure is a row of the result
            row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:300]}
        board.append(row)
    held_out = [*[dealt.where(F.col("fold") == k).drop("fold") for k in range(folds)], test_rows]
    try:
        found = score_each(grown, held_out)
    except Exception:  # then one by one, to see which model fails
        found = {}
    fitted = {}
    for row in [r for r in board if r["key"] in grown]:
        key = row["key"]
        try:
            *runs, row["test"] = found.get(key) or score_each({key: grown[key]}, held_out)[key]
            row["cv"] = {m: {"mean": fmean(r[m] for r in runs), "std": pstdev(r[m] for r in runs)} for m in allowed if all(r[m] is not None for r in runs)}
            fitted[key] = grown[key][-1]
            row["primary_cv"], row["primary_cv_std"] = row["cv"][primary]["mean"], row["cv"][primary]["std"]
        except Exception as e:
            row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:300]}
    dealt.unpersist()
    ok = {r["key"]: r for r in board if r["status"] == "ok"}
    able = [r for k, r in ok.items() if k != "dummy"]
    if not able:
        raise ValueError("every model failed: " + "; ".join(r["error"] for r in board if r["status"] == "failed"))
    sign = -1 if primary in LOWER_IS_BETTER else 1
    leader = max(able, key=lambda r: sign * r["primary_cv"])
    for r in ok.values():
        if "dummy" in ok:
            r["delta_vs_baseline"] = sign * (r["primary_cv"] - ok["dummy"]["primary_cv"])
    return Result(
        s.problem, s.target, classes, primary, board, leader["key"], leader.get("delta_vs_baseline", 0.0) > 0, fitted, spec, numeric, categorical,
        FE.typical_row(train_rows, numeric, categorical), {"train_rows": sizes["train"], "test_rows": sizes["test"], "folds": folds}, imbalanced, [], test_rows,
    )


def predict(result: Result, rows: DataFrame, key: str | None = None) -> DataFrame:
    """Rows with `prediction` and, for classes, `confidence` and `probabilities` by class name; absent columns count as null."""
    if key is not None and key not in result.fitted:
        raise ValueError(f"unknown model {key}")
    fitted = result.fitted[key or result.leader]
    keep = [c for c in rows.columns]
    made = rows.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in keep]))
    out = fitted.predict(FE.expand_features(made, result.spec, ["_row"]))
    if result.classes is None:
        return out.select("_row.*", F.col("p").alias("prediction"))
    names = F.array(*[F.lit(c) for c in result.classes])
    return out.select("_row.*", F.element_at(names, F.col("p").cast("int") + 1).alias("prediction"), F.array_max("proba").alias("confidence"), F.map_from_arrays(names, "proba").alias("probabilities"))


def permutation_importance(result: Result, repeats: int = 5, rows: int = 500, seed: int = 42) -> DataFrame:
    """(feature, importance, std): how much the primary metric falls when a column of at most `rows` test rows is dealt anew.

    The rows are a stated sample for explanation. Each repeat deals its rows by an order of
    its own; every row takes, for each column, that column's value from the row dealt to it.
    All columns and repeats are predicted and scored as groups of one table.
    """
    spark = result.test.sparkSession
    base = result.test.orderBy(F.xxhash64(*result.test.columns, F.lit(seed))).limit(rows).persist()
    names, columns = [*result.numeric, *result.categorical], base.columns
    sign = -1 if result.primary in LOWER_IS_BETTER else 1
    place = F.row_number()
    left = base.withColumn("_k", place.over(Window.orderBy(F.xxhash64(*columns, F.lit(seed)))))  # `rows` rows
    dealt = base.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_repeat"))
    dealt = dealt.withColumn("_k", place.over(Window.partitionBy("_repeat").orderBy(F.xxhash64("_r", F.lit(seed + 1) + F.col("_repeat")))))
    mixed = left.join(dealt, "_k").withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    taken = lambda c: F.when(F.col("_f") == names.index(c), F.col("_r").getField(c)).otherwise(F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`")
    every = base.withColumn("_group", F.lit(0)).unionByName(mixed.select(*map(taken, columns), (F.col("_f") * repeats + F.col("_repeat") + 1).alias("_group")))
    out = result.model.predict(every).select(F.col("_group").alias("group"), F.col("label").alias("y"), F.col("p").cast("double").alias("p"), *(["proba"] if result.classes else [])).persist()
    try:
        found = M.by_group(out, len(result.classes) if result.classes else None)
    finally:
        out.unpersist()
        base.unpersist()
    start = found[0][result.primary]
    falls = {c: [sign * (start - found[k * repeats + r + 1][result.primary]) for r in range(repeats)] for k, c in enumerate(names)}
    return spark.createDataFrame([(c, fmean(f), pstdev(f)) for c, f in falls.items()], "feature string, importance double, std double").orderBy(F.desc("importance"), "feature")


def linear_effects(result: Result, spark: SparkSession, key: str, top: int = 20) -> DataFrame:
    """(feature, coefficient) on scaled inputs, largest first; the mean size over classes where there are several."""
    fitted = result.fitted[key]
    model = fitted.model
    if hasattr(model, "coefficientMatrix") and model.coefficientMatrix.numRows > 1:
        values = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    else:
        values = model.coefficients.toArray()
    rows = sorted(zip(fitted.prep.inputs, map(float, values)), key=lambda r: -abs(r[1]))[:top]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def sources(result: Result, fitted: Fitted) -> list[str]:
    """The table's column that each input of a model was made of: itself, or what a level, an indicator, a frequency or a calendar part belongs to."""
    made = sorted([*result.numeric, *result.categorical], key=len, reverse=True)
    column = {c: next((f.name for f in result.spec if c == f.name or c.startswith(f"{f.name}__")), c) for c in made}
    return [column[next(c for c in made if name == c or name.startswith(f"{c}_"))] for name in fitted.prep.inputs]


def trees_of(fitted: Fitted, spark: SparkSession) -> TR.Trees:
    """A fitted tree model's nodes as arrays."""
    if isinstance(fitted.model, Boosted):
        return fitted.model.trees
    if not hasattr(fitted.model, "trees"):
        raise ValueError(f"{fitted.key} is no tree model")
    return TR.from_spark(fitted.model, spark)


def shap_values(result: Result, key: str, rows: int = 100, block: int = 8) -> DataFrame:
    """(row, feature, shap, value): Shapley values of the last class (or the number) for at most `rows` test rows (a stated sample), by source column, with the column's value where it is a number.

    Of forests they explain the share of the class, of boosted trees the margin. The rows
    go to all tasks, and each task takes `block` trees.
    """
    fitted, spark = result.fitted[key], result.test.sparkSession
    trees, names = trees_of(fitted, spark), fitted.prep.inputs
    of = sources(result, fitted)
    features = list(dict.fromkeys(of))
    place = np.array([features.index(c) for c in of])
    first = [names.index(c) if c in names else None for c in features]
    sample = result.test.orderBy(F.xxhash64(*result.test.columns)).limit(rows)
    made = fitted.prep.transform(sample).select(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in names]).alias("x"))
    x = np.array([r["x"] for r in made.collect()], float).reshape(-1, len(names))  # `rows` rows
    shared = spark.sparkContext.broadcast((trees, x))

    def explain(batches):
        import pyarrow as pa

        for batch in batches:
            every, own = shared.value
            for k in batch.column("id").to_pylist():
                found = replace(every, roots=every.roots[k * block : (k + 1) * block], paths=None).shapley(own, every.value.shape[1] - 1)
                sums = np.zeros((len(own), len(features)))
                np.add.at(sums.T, place, found.T)
                row, feature = np.divmod(np.arange(sums.size), len(features))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(feature), pa.array(sums.ravel())], names=["row", "place", "shap"])

    blocks = -(-len(trees.roots) // block)
    parts = spark.range(0, blocks, 1, blocks).mapInArrow(explain, "row long, place long, shap double").groupBy("row", "place").agg(F.sum("shap").alias("shap"))
    values = [(r, p, c, None if at is None or np.isnan(x[r, at]) else float(x[r, at])) for r in range(len(x)) for p, (c, at) in enumerate(zip(features, first))]
    named = spark.createDataFrame(values, "row long, place long, feature string, value double")
    return named.join(parts, ["row", "place"], "left").select("row", "feature", F.coalesce("shap", F.lit(0.0)).alias("shap"), "value")


def tree_shap(result: Result, key: str, rows: int = 100, top: int = 20) -> DataFrame:
    """(feature, mean_abs): mean size of the Shapley values of each source column."""
    return shap_values(result, key, rows).groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature").limit(top)


def beeswarm(result: Result, key: str, rows: int = 100) -> DataFrame:
    """(row, feature, shap, level): Shapley values for a beeswarm plot; level is the share of the sample's values of the column that are not larger, null where it is no number."""
    by_value = Window.partitionBy("feature").orderBy("value")  # `rows` values a feature
    return shap_values(result, key, rows).withColumn("level", F.when(F.col("value").isNotNull(), F.cume_dist().over(by_value))).drop("value")


def occlusion_variants(rows: DataFrame, names: list[str], typical: dict[str, object]) -> DataFrame:
    """Each row as it is (variant -1), and once for each named column (its place) with that column at its typical value."""
    every = rows.withColumn("variant", F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1))))
    return every.withColumns({c: F.when(F.col("variant") == k, F.lit(typical.get(c))).otherwise(F.col(f"`{c}`")) for k, c in enumerate(names)})


def occlusion(result: Result, row: DataFrame, top: int = 8) -> DataFrame:
    """(feature, change): how the prediction for one row changes when a feature becomes its typical value."""
    made = FE.expand_features(row.limit(1), result.spec, [])
    names = [*result.numeric, *result.categorical]
    out = result.model.predict(occlusion_variants(made, names, result.typical).withColumnRenamed("variant", "_v"))
    value = F.col("p") if result.classes is None else F.col("proba")[len(result.classes) - 1]
    scored = out.select("_v", value.alias("value"))
    base = scored.where("_v = -1").select(F.col("value").alias("base"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_v").cast("int") + 1)
    return scored.where("_v >= 0").crossJoin(F.broadcast(base)).select(label.alias("feature"), (F.col("base") - F.col("value")).alias("change")).orderBy(F.desc(F.abs("change")), "feature").limit(top)


def input_schema(df: DataFrame, spec: list[FE.Field], top: int = 30) -> DataFrame:
    """(column, kind, min, median, max, options) of the inputs, for a form."""
    from sparkloom.operators.stats import top_values

    numeric, categorical = [f.name for f in spec if f.kind in ("numeric", "bool")], [f.name for f in spec if f.kind == "category"]
    parts = []
    if numeric:
        n = per_column(df, numeric, {"min": lambda c: F.min(finite(c)), "max": lambda c: F.max(finite(c))})
        middle = exact_quantiles(df, {c: F.col(f"`{c}`") for c in numeric}, [0.5])
        at = F.create_map(*[x for c in numeric for x in (F.lit(c), F.lit(middle[c][0]).cast("double"))])  # a number a column
        n = n.withColumn("median", at[F.col("column")])
        parts.append(n.select("column", F.lit("numeric").alias("kind"), "min", "median", "max", F.lit(None).cast("array<string>").alias("options")))
    if categorical:
        options = top_values(df, categorical, top).groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda v: v["value"]).alias("options"))
        none = F.lit(None).cast("double")
        parts.append(options.select("column", F.lit("category").alias("kind"), none.alias("min"), none.alias("median"), none.alias("max"), "options"))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
