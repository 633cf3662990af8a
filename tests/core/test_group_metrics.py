"""Metrics of many groups at once equal those of each group alone."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import metrics as M


@pytest.mark.parametrize("classes", [2, 3])
def test_classes(spark, classes):
    rng = random.Random(classes)
    rows = []
    for g in range(4):
        for _ in range(60):
            raw = [rng.randrange(1, 6) for _ in range(classes)]  # many ties
            proba = [x / sum(raw) for x in raw]
            y = rng.randrange(classes) if g != 3 else 0  # a group of one class
            rows.append((g, float(y), float(proba.index(max(proba))), proba))
    df = spark.createDataFrame(rows, "group int, y double, p double, proba array<double>")
    got = M.by_group(df, classes)
    for g in range(4):
        own = df.where(F.col("group") == g)
        want = M.classification(own, 1.0 if classes == 2 else None).first()
        one = lambda k: own.select((F.col("y") == k).cast("int").alias("y"), F.col("proba")[k].alias("score"))  # noqa: E731, B023
        aucs = [M.roc_auc(one(k)).first()[0] for k in ([1] if classes == 2 else range(classes))]
        assert got[g]["roc_auc"] == (None if None in aucs else pytest.approx(sum(aucs) / len(aucs)))
        if want["precision"] is None:  # the positive class is nowhere
            assert got[g]["precision"] == 0.0
        else:
            assert all(got[g][m] == pytest.approx(want[m]) for m in ("precision", "recall", "f1"))
        assert got[g]["accuracy"] == pytest.approx(want["accuracy"])
        ap = M.average_precision(one(1)).first()[0] if classes == 2 else None
        assert got[g]["pr_auc"] == (None if ap is None else pytest.approx(ap))


def test_numbers(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(g, rng.gauss(0, 1) if g else 2.0, rng.gauss(0, 1)) for g in range(3) for _ in range(20)], "group int, y double, p double")
    got = M.by_group(df, None)
    for g in range(3):
        want = M.regression(df.where(F.col("group") == g)).first().asDict()
        assert got[g] == {k: None if v is None else pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("wrong", [{"problem": "x"}, {"folds": 1}, {"folds": 21}, {"models": ("rf", "svm")}, {"rf_trees": 0}, {"gbt_trees": 5001}, {"rf_leaf": 0}, {"rf_depth": 31}, {"gbt_depth": 0}, {"gbt_depth": 13}, {"gbt_rate": 0.0}, {"gbt_rate": float("nan")}, {"regularisation": 0.0}])
def test_sizes_are_checked(wrong):
    from sparkloom.operators.models import Settings

    Settings("y", "regression", "id").check()
    with pytest.raises(ValueError):
        Settings(**{"target": "y", "problem": "regression", "key": "id"} | wrong).check()


def test_classes_are_counted_before_they_are_gathered(spark, monkeypatch):
    from sparkloom.operators import features

    df = spark.range(30).selectExpr("cast(id % 6 as string) as y", "'a' as one")
    assert features.label_classes(df, "y") == list("012345")
    monkeypatch.setattr(features, "MAX_CLASSES", 5)
    for column, match in (("y", "more than 5"), ("one", "one class")):
        with pytest.raises(ValueError, match=match):
            features.label_classes(df, column)
