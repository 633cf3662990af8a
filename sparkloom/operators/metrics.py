"""Scores of predictions, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.common import cumulative, mean_ranks


def confusion(pairs: DataFrame) -> DataFrame:
    """(y, p, n) of label pairs that occur."""
    return pairs.groupBy("y", "p").agg(F.count("*").alias("n"))


def class_report(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of each class; 0 where a denominator is."""
    cells = confusion(pairs)
    both = cells.select(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits")).unionByName(
        cells.select(F.col("p").alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("hits"))
    )
    s = both.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted").cast("double")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support").cast("double")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return s.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def classification(pairs: DataFrame, positive: object | None = None) -> DataFrame:
    """One row of accuracy, precision, recall and f1: of the positive class, or averaged over classes."""
    report = class_report(pairs)
    report = report.where(F.col("label") == positive) if positive is not None else report
    return report.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")).crossJoin(F.broadcast(pairs.agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))))


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row: the area under the ROC curve of (y 0/1, score), ties by mean rank; null with one class."""
    ranks = mean_ranks(scored, "score").select(F.col("value").alias("score"), "rank")
    by_score = scored.groupBy(F.col("score").cast("double").alias("score")).agg(F.sum("y").alias("pos"), F.count("*").alias("n")).join(ranks, "score")
    s = by_score.agg(F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("n"), F.sum(F.col("pos") * F.col("rank")).alias("r"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return s.select(F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / (p * q)).alias("roc_auc"))


def _descending(scored: DataFrame) -> DataFrame:
    """(score, pos, n, tp, seen): per distinct score, and sums over scores at least as high; total is the number of positives."""
    groups = scored.groupBy((-F.col("score").cast("double")).alias("down")).agg(F.sum("y").cast("long").alias("pos"), F.count("*").alias("n"))
    c = cumulative(groups, "down", ["pos", "n"])
    return c.select((-F.col("down")).alias("score"), "pos", "n", (F.col("before_pos") + F.col("pos")).alias("tp"), (F.col("before_n") + F.col("n")).alias("seen"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: the sum of precision times the step in recall, over distinct scores; null without positives."""
    d = _descending(scored)
    return d.agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen").cast("double")), F.sum("pos")).alias("average_precision"))


def roc_curve(scored: DataFrame) -> DataFrame:
    """(score, fpr, tpr) at each distinct score; null where there are no negatives, or no positives."""
    d = _descending(scored)
    t = d.agg(F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("t"))
    return d.crossJoin(F.broadcast(t)).select("score", F.try_divide(F.col("seen") - F.col("tp"), F.col("t") - F.col("p")).alias("fpr"), F.try_divide("tp", "p").alias("tpr"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """(score, precision, recall) at each distinct score."""
    d = _descending(scored)
    t = d.agg(F.sum("pos").cast("double").alias("p"))
    return d.crossJoin(F.broadcast(t)).select("score", (F.col("tp") / F.col("seen").cast("double")).alias("precision"), F.try_divide("tp", "p").alias("recall"))


def regression(pairs: DataFrame) -> DataFrame:
    """One row of mae, mse, rmse, r2 and mape over (y, p); r2 is null below 2 rows, mape where a value is near 0."""
    y, e = F.col("y"), F.col("y") - F.col("p")
    mse = F.avg(e * e)
    return pairs.agg(
        F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.when((F.count("*") > 1) & (F.var_pop(y) > 0), 1 - mse / F.var_pop(y)).alias("r2"),
        F.when(F.min(F.abs(y)) >= 1e-8, F.avg(F.abs(e) / F.when(y != 0, F.abs(y))) * 100).alias("mape"),
    )


def _of_counts(cells: list[tuple[float, float, int]], positive: float | None) -> dict[str, float]:
    """accuracy, precision, recall and f1 from (y, p, n): of the positive class, or averaged over classes."""
    labels = sorted({y for y, _, _ in cells} | {p for _, p, _ in cells})
    share = lambda a, b: a / b if b else 0.0
    rows = []
    for c in labels if positive is None else [positive]:
        hits = sum(n for y, p, n in cells if y == p == c)
        precision, recall = share(hits, sum(n for _, p, n in cells if p == c)), share(hits, sum(n for y, _, n in cells if y == c))
        rows.append((precision, recall, share(2 * precision * recall, precision + recall)))
    means = [sum(r[k] for r in rows) / len(rows) for k in range(3)]
    return {"precision": means[0], "recall": means[1], "f1": means[2], "accuracy": share(sum(n for y, p, n in cells if y == p), sum(n for *_, n in cells))}


def by_group(pairs: DataFrame, classes: int | None) -> dict[int, dict[str, float | None]]:
    """All metrics of each group of (group, y, p, proba), or without proba where classes is None: those of every group come from the same jobs.

    Areas under curves rest on one ranking of the distinct scores within each group and
    class. roc_auc is the mean over classes, null if one of them is missing; pr_auc is
    there for two classes.
    """
    if classes is None:
        y, e = F.col("y"), F.col("y") - F.col("p")
        mse = F.avg(e * e)
        rows = pairs.groupBy("group").agg(
            F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.when((F.count("*") > 1) & (F.var_pop(y) > 0), 1 - mse / F.var_pop(y)).alias("r2"),
            F.when(F.min(F.abs(y)) >= 1e-8, F.avg(F.abs(e) / F.when(y != 0, F.abs(y))) * 100).alias("mape"),
        ).collect()
        return {r["group"]: {k: v for k, v in r.asDict().items() if k != "group"} for r in rows}
    counted: dict[int, list] = {}
    for r in pairs.groupBy("group", "y", "p").count().collect():  # groups times pairs of classes
        counted.setdefault(r["group"], []).append((r["y"], r["p"], r["count"]))
    wanted = [1] if classes == 2 else list(range(classes))
    one = F.explode(F.array(*[F.struct((F.col("group") * classes + k).cast("long").alias("at"), F.col("proba")[k].alias("score"), (F.col("y") == k).cast("long").alias("hit")) for k in wanted]))
    scores = pairs.select(one.alias("s")).groupBy("s.at", "s.score").agg(F.sum("s.hit").alias("pos"), F.count("*").alias("n")).persist()
    ranked = cumulative(scores, "score", ["pos", "n"], "at")
    whole = scores.groupBy("at").agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))  # a row for each group and class
    tp, seen = F.col("all_pos") - F.col("before_pos"), F.col("all_n") - F.col("before_n")
    sums = ranked.join(F.broadcast(whole), "at").groupBy("at").agg(
        F.sum(F.col("pos") * (F.col("before_n") + (F.col("n") + 1) / F.lit(2.0))).alias("ranks"), F.sum(F.col("pos") * tp / seen.cast("double")).alias("steps"), F.first("all_pos").alias("p"), F.first("all_n").alias("n")
    )
    areas = {}
    try:
        rows = sums.collect()
    finally:
        scores.unpersist()
    for r in rows:
        p, q = r["p"], r["n"] - r["p"]
        areas[r["at"]] = ((r["ranks"] - p * (p + 1) / 2) / (p * q) if p and q else None, r["steps"] / p if p else None)
    out: dict[int, dict[str, float | None]] = {}
    for group, cells in counted.items():
        found = [areas.get(group * classes + k, (None, None)) for k in wanted]
        aucs = [a for a, _ in found]
        out[group] = _of_counts(cells, 1.0 if classes == 2 else None) | {"roc_auc": None if None in aucs else sum(aucs) / len(aucs), "pr_auc": found[0][1] if classes == 2 else None}
    return out


def residual_histogram(pairs: DataFrame, bins: int = 25) -> DataFrame:
    """(bin, n) of equal-width bins of y - p, empty ones included."""
    e = F.col("y") - F.col("p")
    head = pairs.agg(F.min(e).alias("lo"), F.max(e).alias("hi")).first()
    if head["lo"] is None:
        return pairs.sparkSession.createDataFrame([], "bin int, n long")
    lo, hi = (head["lo"] - 0.5, head["hi"] + 0.5) if head["lo"] == head["hi"] else (head["lo"], head["hi"])
    at = F.least(F.floor((e - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    counts = pairs.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return pairs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
