"""Trained models on disk: models, what their preprocessing learned, the held-out rows, and series with what forecasts them."""

from __future__ import annotations

import importlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import features as FE
from sparkloom.operators import forecast as FC
from sparkloom.operators import models as MO
from sparkloom.operators.boosting import Boosted

_PLAIN = ("problem", "target", "classes", "primary", "board", "leader", "beats_baseline", "numeric", "categorical", "typical", "split", "imbalanced", "decisions")


def preprocessing(prep: FE.Preprocessor) -> dict:
    """What was learned from the training rows, as a document: medians, indicators, logarithms, levels, frequencies' columns and scales."""
    return {
        "linear": prep.linear, "numeric": prep.numeric, "logs": prep.logs, "low": prep.low, "high": prep.high, "medians": prep.medians, "gaps": prep.gaps,
        "levels": {c: list(v) for c, v in prep.levels.items()}, "scaled": {c: list(v) for c, v in prep.scaled.items()}, "inputs": prep.inputs,
    }


def save(result: MO.Result, folder: str) -> None:
    """Writes a result under folder, a path that Spark can write, local or shared."""
    spark = result.test.sparkSession
    doc: dict = {k: getattr(result, k) for k in _PLAIN} | {"spec": [asdict(f) for f in result.spec], "fitted": {}}
    for key, fitted in result.fitted.items():
        if fitted.prep is None:
            doc["fitted"][key] = {"constant": fitted.model}
            continue
        kind = type(fitted.model)
        doc["fitted"][key] = {"class": [kind.__module__, kind.__name__], "preprocessing": preprocessing(fitted.prep)}
        if isinstance(fitted.model, Boosted):
            fitted.model.save(spark, f"{folder}/{key}/model")
        else:
            fitted.model.write().overwrite().save(f"{folder}/{key}/model")
        for c, shares in fitted.prep.shares.items():
            shares.write.mode("overwrite").parquet(f"{folder}/{key}/shares/{fitted.prep.high.index(c)}")
    result.test.write.mode("overwrite").parquet(f"{folder}/test")
    spark.createDataFrame([(json.dumps(doc, default=str),)], "doc string").coalesce(1).write.mode("overwrite").text(f"{folder}/result")  # last: a result that can be read is whole


def load(spark: SparkSession, folder: str) -> MO.Result:
    """The result that save() wrote."""
    doc = json.loads(spark.read.text(f"{folder}/result", wholetext=True).first()["value"])
    fitted = {}
    for key, m in doc["fitted"].items():
        if "constant" in m:
            fitted[key] = MO.Fitted(key, None, m["constant"], doc["classes"])
            continue
        p = m["preprocessing"]
        prep = FE.Preprocessor(p["linear"])
        for name in ("numeric", "logs", "low", "high", "medians", "gaps", "inputs"):
            setattr(prep, name, p[name])
        prep.levels, prep.scaled = {c: tuple(v) for c, v in p["levels"].items()}, {c: tuple(v) for c, v in p["scaled"].items()}
        prep.shares = {c: spark.read.parquet(f"{folder}/{key}/shares/{k}") for k, c in enumerate(prep.high)}
        kind = getattr(importlib.import_module(m["class"][0]), m["class"][1])
        fitted[key] = MO.Fitted(key, prep, kind.load(f"{folder}/{key}/model"), doc["classes"])
    return MO.Result(fitted=fitted, spec=[FE.Field(**f) for f in doc["spec"]], test=spark.read.parquet(f"{folder}/test"), **{k: doc[k] for k in _PLAIN})


def save_forecast(result: dict, folder: str) -> None:
    """Writes what later forecasts need: the regular series, what is known of it, and the lag model where it leads."""
    series, model = result["series"], result["lag_model"]
    spark = series.sparkSession
    series.write.mode("overwrite").parquet(f"{folder}/series")
    doc = {k: result[k] for k in ("leader", "season", "info", "trees", "models", "split")}
    if model is not None:
        Boosted(model.trees, 0).save(spark, f"{folder}/lag")
        doc["lag_model"] = {"season": result["season"], "n_trees": model.n_trees, "depth": model.depth, "rate": model.rate, "tail": model.tail, "weights": model.weights}
    spark.createDataFrame([(json.dumps(doc, default=str),)], "doc string").coalesce(1).write.mode("overwrite").text(f"{folder}/result")  # last: a result that can be read is whole


def load_forecast(spark: SparkSession, folder: str) -> dict:
    """What save_forecast() wrote, as far as later forecasts need it."""
    doc = json.loads(spark.read.text(f"{folder}/result", wholetext=True).first()["value"])
    model, found = None, doc.pop("lag_model", None)
    if found:
        model = FC.LagModel(found["season"], found["n_trees"], found["depth"], found["rate"])
        model.trees, model.tail, model.weights = Boosted.load(f"{folder}/lag").trees, found["tail"], found["weights"]
    return {**doc, "series": spark.read.parquet(f"{folder}/series"), "lag_model": model}


def diagnostics(result: MO.Result, key: str | None = None, points: int = 120) -> dict[str, list[dict]]:
    """What the held-out rows say of a model: metrics, and confusion, report and curves of at most `points` points, or the histogram of residuals."""
    from sparkloom.operators import metrics as M

    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  small tables
    out = result.fitted[key or result.leader].predict(result.test).select(F.col("label").alias("y"), "p", *(["proba"] if result.classes else []))
    if result.classes is None:
        return {"metrics": rows(M.regression(out)), "residuals": rows(M.residual_histogram(out))}
    found = {"metrics": rows(M.classification(out, 1.0 if len(result.classes) == 2 else None)), "confusion": rows(M.confusion(out)), "report": rows(M.class_report(out))}
    if len(result.classes) == 2:
        scored = out.select(F.col("y").cast("int").alias("y"), F.col("proba")[1].alias("score"))
        found |= {"roc": _thinned(M.roc_curve(scored), points), "pr": _thinned(M.pr_curve(scored), points)}
    return found


def _thinned(curve: DataFrame, points: int) -> list[dict]:
    """Points of a curve at even steps of the ranks of their scores, with both ends."""
    n = curve.count()
    cuts = curve.approxQuantile("score", [k / (points - 1) for k in range(points)], 1e-4) if n > points else []
    rows = curve.where(F.col("score").isin(sorted(set(cuts)))) if n > points else curve
    return [r.asDict() for r in rows.orderBy(F.desc("score")).collect()]
