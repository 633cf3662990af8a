"""Queries over features, metrics, models and predictions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from sparkloom.operators import features as FE
from sparkloom.operators import metrics as M
from sparkloom.operators import models as MO
from sparkloom.operators.normality import shapiro
from sparkloom.plans.profile_queries import TYPES_SQL
from sparkloom.plans.registry import query, rounded

_SPLIT = "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders"


@query("split_stratified", f"SELECT o_orderkey, o_orderstatus, CASE WHEN k < round(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM ({_SPLIT})")
def _(t):
    return FE.stratified_split(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@query("kfold", f"SELECT o_orderkey, o_orderstatus, CAST(k % 5 AS INT) AS fold FROM ({_SPLIT})")
def _(t):
    return FE.kfold(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@query(
    "expand_features",
    "SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS DOUBLE) AS o_orderdate__year, CAST(month(o_orderdate) AS DOUBLE) AS o_orderdate__month, CAST(day(o_orderdate) AS DOUBLE) AS o_orderdate__day, CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS o_orderdate__weekday, "
    + ", ".join(f"round({f}(2 * pi() * {v} / {p}), 6) + 0.0 AS o_orderdate__{n}_{f}" for n, v, p in (("month", "month(o_orderdate)", 12), ("weekday", "(isodow(o_orderdate) - 1)", 7)) for f in ("sin", "cos")) + ", o_orderpriority FROM orders",
)
def _(t):
    df = t("orders")
    return rounded(FE.expand_features(df, FE.make_spec(df, ["o_totalprice", "o_orderdate", "o_orderpriority"]), ["o_orderkey"]))


@query("impute_median", "SELECT l_orderkey, l_linenumber, coalesce(q, (SELECT median(q) FROM (SELECT CASE WHEN l_partkey % 3 > 0 THEN l_quantity END AS q FROM lineitem))) AS q, CAST(q IS NULL AS INT)::DOUBLE AS q_missing FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 > 0 THEN l_quantity END AS q FROM lineitem)")
def _(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 3 > 0, F.col("l_quantity")).alias("q"))
    return FE.impute(df, FE.medians(df, ["q"]), ["q"])


@query("log1p_select", " UNION ALL ".join(f"SELECT '{c}' AS column_name FROM {t} HAVING min({c}) >= 0 AND skewness({c}) > 1" for c, t in (("value", "events"), ("event_id", "events"))))
def _(t):
    df = t("events")
    found = FE.log_columns(df, ["value", "event_id"])
    return df.sparkSession.createDataFrame([(c,) for c in found], "column_name string")


@query("standard_scale", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) + 0.0 AS p_retailprice FROM part")
def _(t):
    df = t("part").select("p_partkey", "p_retailprice")
    return rounded(FE.standard_scale(df, df, ["p_retailprice"]))


@query("one_hot", "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderpriority = '{p}' AS INT)::DOUBLE AS \"o_orderpriority_{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders")
def _(t):
    df = t("orders").select("o_orderkey", "o_orderpriority")
    levels, rare = FE.one_hot_levels(df, "o_orderpriority")
    return FE.one_hot(df, "o_orderpriority", levels, rare).drop("o_orderpriority")


@query("freq_encode", "SELECT p_partkey, p_brand, round(count(*) OVER (PARTITION BY p_brand) / CAST(count(*) OVER () AS DOUBLE), 6) AS p_brand_freq FROM part")
def _(t):
    df = t("part").select("p_partkey", "p_brand")
    return rounded(FE.frequency_encode(df, df, "p_brand"))


@query("label_encode", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label FROM orders")
def _(t):
    df = t("orders").select("o_orderkey", "o_orderstatus")
    return FE.label_encode(df, "o_orderstatus", FE.label_classes(df, "o_orderstatus")).select("o_orderkey", "label")


@query("typical_row", "SELECT round(median(p_retailprice), 6) AS price, (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1) AS brand FROM part")
def _(t):
    df = t("part")
    row = FE.typical_row(df, ["p_retailprice"], ["p_brand"])
    return rounded(df.sparkSession.createDataFrame([(row["p_retailprice"], row["p_brand"])], "price double, brand string"))


@query("input_schema", "SELECT 'p_retailprice' AS \"column\", 'numeric' AS kind, round(min(p_retailprice), 6) AS min, round(median(p_retailprice), 6) AS median, round(max(p_retailprice), 6) AS max, CAST(NULL AS VARCHAR[]) AS options FROM part UNION ALL SELECT 'p_brand', 'category', NULL, NULL, NULL, (SELECT list(v ORDER BY k) FROM (SELECT p_brand AS v, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY p_brand) WHERE k <= 30)")
def _(t):
    df = t("part")
    return rounded(MO.input_schema(df, FE.make_spec(df, ["p_retailprice", "p_brand"])))


@query(
    "select_features",
    f"""WITH {TYPES_SQL} SELECT name AS "column", CASE WHEN n_unique <= 1 OR semantic_type IN ('identifier', 'text') THEN 'excluded' ELSE 'used' END AS action,
CASE WHEN n_unique <= 1 THEN 'one value throughout' WHEN semantic_type = 'identifier' THEN identifier_level || ' identifier' WHEN semantic_type = 'text' THEN 'free text' END AS reason FROM typed WHERE name <> 'flag'""",
)
def _(t):
    from sparkloom.operators.typing import infer_types
    from sparkloom.plans.profile_queries import clean

    df = clean(t).drop("row_id")
    chosen, left = FE.select_features(infer_types(df), "flag")
    rows = [(m.name, "used", None) for m in chosen] + [(d["column"], d["action"], d["reason"]) for d in left]
    return df.sparkSession.createDataFrame(rows, "column string, action string, reason string")


# ---------------------------------------------------------------- metrics on fixed scores

_SCORED = "SELECT quality AS y, (d.n_chars % 1000) / 1000.0 AS score, CAST((d.n_chars % 1000) / 1000.0 >= 0.5 AS INT) AS p FROM labels JOIN documents d USING (doc_id)"


def scored(t):
    s = (F.col("n_chars") % 1000) / F.lit(1000.0)
    return t("labels").join(t("documents"), "doc_id").select(F.col("quality").alias("y"), s.alias("score"), (s >= 0.5).cast("int").alias("p"))


@query("confusion_matrix", f"SELECT y, p, count(*) AS n FROM ({_SCORED}) GROUP BY ALL")
def _(t):
    return M.confusion(scored(t))


_REPORT = f"""WITH s AS ({_SCORED}), c AS (SELECT l AS label, count(*) FILTER (y = l) AS support, count(*) FILTER (p = l) AS predicted, count(*) FILTER (y = l AND p = l) AS hits FROM s, (VALUES (0), (1)) v(l) GROUP BY l),
r AS (SELECT label, coalesce(hits / CAST(nullif(predicted, 0) AS DOUBLE), 0) AS precision, coalesce(hits / CAST(nullif(support, 0) AS DOUBLE), 0) AS recall, support FROM c)"""


@query("class_report", _REPORT + " SELECT CAST(label AS INT) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, support FROM r")
def _(t):
    return rounded(M.class_report(scored(t)))


@query("cls_metrics", _REPORT + " SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, (SELECT round(avg(CAST(y = p AS INT)), 6) FROM s) AS accuracy FROM r WHERE label = 1")
def _(t):
    return rounded(M.classification(scored(t), 1))


@query("roc_auc", f"WITH s AS ({_SCORED}), r AS (SELECT y, CAST(rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS DOUBLE) AS r FROM s) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM r")
def _(t):
    return rounded(M.roc_auc(scored(t)))


_CURVE = f"WITH g AS (SELECT CAST(score AS DOUBLE) AS score, sum(y) AS pos, count(*) AS n FROM ({_SCORED}) GROUP BY 1), c AS (SELECT score, pos, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(n) OVER w AS DOUBLE) AS seen, CAST(sum(pos) OVER () AS DOUBLE) AS p, CAST(sum(n) OVER () AS DOUBLE) AS t FROM g WINDOW w AS (ORDER BY score DESC))"


@query("avg_precision", _CURVE + " SELECT round(sum(pos * tp / seen) / any_value(p), 6) AS average_precision FROM c")
def _(t):
    return rounded(M.average_precision(scored(t)))


@query("roc_curve", _CURVE + " SELECT score, round((seen - tp) / (t - p), 6) AS fpr, round(tp / p, 6) AS tpr FROM c")
def _(t):
    return rounded(M.roc_curve(scored(t)))


@query("pr_curve", _CURVE + " SELECT score, round(tp / seen, 6) AS precision, round(tp / p, 6) AS recall FROM c")
def _(t):
    return rounded(M.pr_curve(scored(t)))


_PAIRS = "SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem"


def pairs(t):
    return t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"))


@query("reg_metrics", f"SELECT round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(1 - avg(pow(y - p, 2)) / var_pop(y), 6) AS r2, round(avg(abs(y - p) / abs(y)) * 100, 6) AS mape FROM ({_PAIRS})")
def _(t):
    r = M.regression(pairs(t))
    return r.select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("mape", 6).alias("mape"))


@query("residual_hist", f"WITH e AS (SELECT y - p AS e FROM ({_PAIRS})), s AS (SELECT min(e) AS lo, max(e) AS hi, (max(e) - min(e)) / 25 AS w FROM e), c AS (SELECT CAST(least(floor((e - lo) / w), 24) AS INT) AS bin, count(*) AS n FROM e, s GROUP BY 1) SELECT CAST(k AS INT) AS bin, coalesce(n, 0) AS n FROM range(25) r(k) LEFT JOIN c ON bin = k")
def _(t):
    return M.residual_histogram(pairs(t))


@query("dummy_baseline", "SELECT o_orderstatus AS value, round(count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE), 6) AS prior FROM orders GROUP BY 1")
def _(t):
    return rounded(FE.frequencies(t("orders"), "o_orderstatus").withColumnRenamed("share", "prior"))


@query("model_linear", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def _(t):
    from pyspark.ml.feature import VectorAssembler

    estimator, _linear = MO.families(MO.Settings("l_extendedprice", "regression", "l_orderkey", models=("linear",)), 0, False, 0)["linear"]
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(t("lineitem").select("l_quantity", F.col("l_extendedprice").alias("label")))
    m = estimator.fit(rows)
    return rows.sparkSession.createDataFrame([(round(float(m.coefficients[0]), 3), round(float(m.intercept), 3))], "slope double, intercept double")


# ---------------------------------------------------------------- models, at small sizes


def customers(t):
    totals = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("orders"))
    return t("customer").join(totals, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_acctbal", "c_mktsegment", "spent", "orders", F.when(F.col("orders") > 10, "many").otherwise("few").alias("habit"))


_SMALL = {"folds": 5, "rf_trees": 50, "rf_depth": 14, "gbt_trees": 20, "gbt_depth": 5}


@lru_cache(maxsize=8)
def _trained(spark, path: str, problem: str, models: tuple[str, ...]) -> MO.Result:
    read = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    target = "habit" if problem == "classification" else "spent"
    columns = ["c_acctbal", "c_mktsegment", "spent"] if problem == "classification" else ["c_acctbal", "c_mktsegment", "orders"]
    return MO.train(customers(read), columns, MO.Settings(target, problem, "c_custkey", models=models, **_SMALL))


def _result(t, problem="classification", models=("logreg", "rf", "gbt")):
    frame = t("customer")
    return _trained(frame.sparkSession, frame.inputFiles()[0].rpartition("/customer.parquet")[0], problem, models), frame.sparkSession


@query("leaderboard")
def _(t):
    r, spark = _result(t)
    return r.leaderboard(spark)


for _key in ("logreg", "rf", "gbt"):

    @query(f"model_{_key}")
    def _(t, key=_key):
        r, _spark = _result(t, models=(key,))  # no model waits for the others
        return MO.predict(r, customers(t), key).select("c_custkey", "prediction", F.round("confidence", 4).alias("confidence"))


@query("perm_importance")
def _(t):
    return MO.permutation_importance(_result(t, "regression", ("linear",))[0])


@query("linear_effects")
def _(t):
    r, spark = _result(t, models=("logreg",))
    return MO.linear_effects(r, spark, "logreg")


@query("tree_shap")
def _(t):
    return MO.tree_shap(_result(t, models=("rf",))[0], "rf")


@query("occlusion")
def _(t):
    return MO.occlusion(_result(t, "regression", ("linear",))[0], customers(t).orderBy("c_custkey").limit(1))


@query("occlusion_variants", "SELECT c_custkey, k AS variant, CASE WHEN k = 0 THEN 0.0 ELSE c_acctbal END::DOUBLE AS c_acctbal, CASE WHEN k = 1 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer, range(-1, 2) r(k)")
def _(t):
    made = MO.occlusion_variants(t("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), ["c_acctbal", "c_mktsegment"], {"c_acctbal": 0.0, "c_mktsegment": "NONE"})
    return made.withColumn("variant", F.col("variant").cast("long"))


@query("predict_records")
def _(t):
    r, _spark = _result(t, models=("logreg",))
    return MO.predict(r, customers(t).select("c_custkey", "c_acctbal", "c_mktsegment", "spent")).select("c_custkey", "prediction", F.round("confidence", 4).alias("confidence"))


@query("batch_predict")
def _(t):
    """A column the model knows is absent and counts as null."""
    r, _spark = _result(t, "regression", ("linear",))
    return MO.predict(r, customers(t).drop("orders")).select("c_custkey", F.round("prediction", 2).alias("prediction"))


@query("shapiro")
def _(t):
    return shapiro(t("events"), "value")
