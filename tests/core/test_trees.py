"""Boosting and Shapley values against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import boosting, models, trees
from sparkloom.operators.boosting import Boosted, Boosting


def random_tree(rng, features, depth):
    """Nodes of a random tree; features may come again on a path."""
    nodes = []

    def grow(d, cover):
        at = len(nodes)
        nodes.append({"feature": int(rng.integers(features)), "threshold": float(rng.integers(-2, 3)), "left": -1, "right": -1, "missing_left": bool(rng.random() < 0.5), "value": [float(rng.normal()), float(rng.normal())], "cover": cover})
        if d and rng.random() < 0.9 and cover > 1:
            part = float(rng.integers(1, int(cover)))
            nodes[at]["left"], nodes[at]["right"] = grow(d - 1, part), grow(d - 1, cover - part)
        return at

    grow(depth, 1000.0)
    return nodes


def expectation(nodes, x, known, at=0):
    n = nodes[at]
    if n["left"] < 0:
        return np.array(n["value"])
    if n["feature"] in known:
        v = x[n["feature"]]
        left = n["missing_left"] if math.isnan(v) else v <= n["threshold"]
        return expectation(nodes, x, known, n["left"] if left else n["right"])
    share = nodes[n["left"]]["cover"] / n["cover"]
    return share * expectation(nodes, x, known, n["left"]) + (1 - share) * expectation(nodes, x, known, n["right"])


@pytest.mark.parametrize("seed", range(6))
def test_shapley_values_equal_sums_over_subsets(seed):
    rng = np.random.default_rng(seed)
    features = 5
    made = [random_tree(rng, features, depth) for depth in (0, 1, 4, 7)]
    model = trees.from_nodes(made, np.array([0.5, -1.0]))
    x = rng.integers(-3, 4, (6, features)).astype(float)
    x[rng.random(x.shape) < 0.2] = np.nan
    for output in (0, 1):
        got = model.shapley(x, output)
        for row, values in zip(x, got):
            game = lambda known: sum(expectation(t, row, known)[output] for t in made)  # noqa: B023, E731
            for f in range(features):
                rest = [g for g in range(features) if g != f]
                truth = sum(math.factorial(k) * math.factorial(features - 1 - k) / math.factorial(features) * (game({*s, f}) - game(set(s))) for k in range(features) for s in itertools.combinations(rest, k))
                assert abs(values[f] - truth) < 1e-9
    assert np.allclose(got.sum(axis=1), model.predict(x)[:, 1] - model.expected()[1])
    assert np.allclose(model.predict(x), [[0.5, -1.0] + sum(expectation(t, row, set(range(features))) for t in made) for row in x])


def test_a_child_without_rows_is_no_division_by_zero():
    nodes = [{"feature": 0, "threshold": 0.0, "left": 1, "right": 2, "missing_left": True, "value": [0.0], "cover": 5.0}, {"feature": 0, "threshold": 0, "left": -1, "right": -1, "missing_left": False, "value": [1.0], "cover": 5.0}, {"feature": 0, "threshold": 0, "left": -1, "right": -1, "missing_left": False, "value": [3.0], "cover": 0.0}]
    model = trees.from_nodes([nodes], np.zeros(1))
    assert np.allclose(model.shapley(np.array([[1.0], [-1.0]]), 0), [[2.0], [0.0]])


def rows_of(spark, x, y, weight=None, member=None):
    n = len(y)
    data = [(int(member[k]) if member is not None else 0, [None if math.isnan(v) else float(v) for v in x[k]], float(y[k]), float(weight[k]) if weight is not None else 1.0, k) for k in range(n)]
    return spark.createDataFrame(data, "member int, x array<double>, label double, weight double, seed long").repartition(3)


def exhaustive(x, g, h, l2):
    """The gain of the best split over all features, thresholds and sides of missing values."""
    best = 0.0
    for f in range(x.shape[1]):
        for t in np.unique(x[~np.isnan(x[:, f]), f])[:-1]:
            for side in (False, True):
                left = np.where(np.isnan(x[:, f]), side, x[:, f] <= t)
                if h[left].sum() >= 1 and h[~left].sum() >= 1:
                    best = max(best, g[left].sum() ** 2 / (h[left].sum() + l2) + g[~left].sum() ** 2 / (h[~left].sum() + l2) - g.sum() ** 2 / (h.sum() + l2))
    return best


@pytest.mark.parametrize(("classes", "direct"), [(0, 1 << 22), (2, 0)])
def test_first_split_is_the_best_of_all(spark, monkeypatch, classes, direct):
    monkeypatch.setattr(boosting, "DIRECT", direct)
    rng = np.random.default_rng(classes)
    x = rng.integers(0, 12, (200, 4)).astype(float)
    x[rng.random(x.shape) < 0.15] = np.nan
    y = np.nan_to_num(x[:, 1], nan=9) + rng.normal(size=200)
    y = (y > 6).astype(float) if classes else y
    weight = rng.integers(1, 4, 200).astype(float)
    s = Boosting(classes, rounds=1, depth=1, rows=1.0, columns=1.0, rate=1.0)
    tree = boosting.fit(rows_of(spark, x, y, weight), 1, s)[0]
    mean = (weight * y).sum() / weight.sum()
    margin = np.full((200, 1), np.log(mean / (1 - mean)) if classes else mean)
    g, h = (v[:, 0] for v in boosting.gradients(margin, y, weight, classes))
    left = np.where(np.isnan(x[:, tree.feature[0]]), tree.missing_left[0], x[:, tree.feature[0]] <= tree.threshold[0])
    gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
    assert abs(gain - exhaustive(x, g, h, 1.0)) < 1e-6 * gain
    assert np.allclose(tree.predict(x)[:, 0], margin[:, 0] - np.where(left, g[left].sum() / (h[left].sum() + 1), g[~left].sum() / (h[~left].sum() + 1)))
    assert np.isclose(tree.cover[0], h.sum()) and np.isclose(tree.cover[1:].sum(), h.sum())


def test_members_grow_as_they_would_alone(spark):
    rng = np.random.default_rng(5)
    x, member = rng.normal(size=(300, 3)), rng.integers(0, 2, 300)
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    s = Boosting(2, rounds=10, depth=3, columns=1.0)  # 10: margins are written once on the way
    both = boosting.fit(rows_of(spark, x, y, member=member), 2, s)
    for m in (0, 1):
        at = np.flatnonzero(member == m)
        data = [(0, [float(v) for v in x[k]], float(y[k]), 1.0, int(k)) for k in at]
        alone = boosting.fit(spark.createDataFrame(data, "member int, x array<double>, label double, weight double, seed long"), 1, s)[0]
        assert np.allclose(alone.predict(x), both[m].predict(x))
        assert ((both[m].predict(x[at])[:, 0] > 0) == y[at]).mean() > 0.95


def test_classes_numbers_and_odd_features(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=400), np.full(400, 3.0), np.full(400, np.nan), rng.integers(0, 2, 400)])
    label = np.digitize(x[:, 0], [-0.5, 0.5])
    model = Boosted(boosting.fit(rows_of(spark, x, label), 1, Boosting(3, rounds=8, depth=2, rate=0.5, columns=1.0))[0], 3)
    assert (model.trees.predict(x).argmax(axis=1) == label).mean() > 0.97
    assert np.allclose(model.trees.shapley(x[:20], 2).sum(axis=1), model.trees.predict(x[:20])[:, 2] - model.trees.expected()[2])
    table = spark.createDataFrame([[float(v) for v in r] for r in x[:50]], "a double, b double, c double, d double")
    inputs = ["a", "b", "c", "d"]
    model.save(spark, f"{tmp_path}/m")
    rows, again = (m.transform(table, inputs).select("proba", "p").collect() for m in (model, Boosted.load(f"{tmp_path}/m")))
    assert rows == again and all(abs(sum(r["proba"]) - 1) < 1e-9 and r["p"] == int(np.argmax(r["proba"])) for r in rows)
    number = Boosted(boosting.fit(rows_of(spark, x, x[:, 0] ** 2), 1, Boosting(0, rounds=12, rate=0.4, columns=1.0))[0], 0)
    out = np.array([r["p"] for r in number.transform(table, inputs).collect()])
    assert np.mean((out - x[:50, 0] ** 2) ** 2) < 0.1 * np.var(x[:, 0] ** 2)
    constant = boosting.fit(rows_of(spark, x, np.full(400, 2.5)), 1, Boosting(0, rounds=2))[0]
    assert np.allclose(constant.predict(x), 2.5)


def test_boosting_is_at_least_as_good_as_first_order_trees(spark):
    """Held-out accuracy beside Spark's own boosted trees of the same sizes."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(9)
    x = rng.normal(size=(1600, 4))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] > 0).astype(float)
    ours = boosting.fit(rows_of(spark, x[:800], y[:800]), 1, Boosting(2, rounds=12, depth=4, rate=0.3, columns=1.0))[0]
    data = spark.createDataFrame([([float(v) for v in r], float(t), int(k < 800)) for k, (r, t) in enumerate(zip(x, y))], "x array<double>, label double, train int").select(*[F.col("x")[k].alias(f"x{k}") for k in range(4)], "label", "train")
    data = VectorAssembler(inputCols=[f"x{k}" for k in range(4)], outputCol="features").transform(data)
    theirs = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=1).fit(data.where("train = 1")).transform(data.where("train = 0"))
    assert ((ours.predict(x[800:])[:, 0] > 0) == y[800:]).mean() >= theirs.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] - 0.01


def test_training_with_boosted_trees(spark, tmp_path):
    from sparkloom import artifacts

    rng = np.random.default_rng(2)
    a, b = rng.normal(size=400), rng.integers(0, 5, 400)
    rows = [(k, None if k % 11 == 0 else float(a[k]), "uvwxy"[b[k]], "yes" if a[k] + (b[k] > 2) > 0.5 else "no", float(a[k] * 2 + b[k])) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b string, y string, n double")
    for target, problem in (("y", "classification"), ("n", "regression")):
        r = models.train(df, ["a", "b"], models.Settings(target, problem, "id", models=("gbt",), folds=2, gbt_trees=6, gbt_depth=3, gbt_rate=0.4))
        assert r.leader == "gbt" and r.beats_baseline and r.board[1]["status"] == "ok", r.board
        values = models.shap_values(r, "gbt", rows=30, block=2).toPandas()
        assert len(values) == 60 and set(values.feature) == {"a", "b"}
        artifacts.save(r, f"{tmp_path}/{target}")
        again = artifacts.load(spark, f"{tmp_path}/{target}")
        assert sorted(map(str, models.predict(again, df).collect())) == sorted(map(str, models.predict(r, df).collect()))


def test_default_forest_is_explained_in_seconds(spark):
    """As many leaves as 200 trees of depth 14 over a few thousand rows have."""
    import time

    rng = np.random.default_rng(3)
    made = [random_tree(rng, 10, 10) for _ in range(20)]  # about a tenth of a default forest
    model = trees.from_nodes(made, np.zeros(2))
    began = time.perf_counter()
    x = rng.normal(size=(100, 10)) * 2
    values = model.shapley(x, 0)
    assert np.allclose(values.sum(axis=1), model.predict(x)[:, 0] - model.expected()[0]) and time.perf_counter() - began < 30
