"""Forests, cells and statistics of folds against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cells, features, forest, models
from sparkloom.operators.boosting import Boosted
from sparkloom.operators.forest import Forest, Forested


def rows_of(spark, x, y, member=None):
    data = [(int(member[k]) if member is not None else 0, [None if np.isnan(v) else float(v) for v in r], float(y[k]), 1.0, k) for k, r in enumerate(x)]
    return spark.createDataFrame(data, "member int, x array<double>, label double, weight double, seed long").repartition(3)


def test_draws_of_cells_are_sums_of_draws_of_rows():
    u = (np.arange(200_000) + 0.5) / 200_000
    for n in (1, 7, 900):
        own = cells.copies(u, np.full(len(u), n))
        assert abs(own.mean() - n) < 1e-3 * n and abs(own.var() - n) < 1e-2 * n
        kept = cells.taken(u, np.full(len(u), n), 0.9)
        assert kept.min() >= 0 and kept.max() <= n and abs(kept.mean() - 0.9 * n) < 1e-3 * n and abs(kept.var() - 0.09 * n) < 1e-2 * n
    one = np.ones(len(u), np.int64)
    assert (cells.taken(u, one, 0.9) == (u < 0.9)).all() and (cells.taken(u, one, 1.0) == 1).all()
    mixed = np.array([3, 1, 3, 500])
    assert [int(cells.copies(np.array([0.4]), np.array([k]))[0]) for k in mixed] == cells.copies(np.full(4, 0.4), mixed).tolist()


def test_copies_of_rows_make_no_more_cells(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, (60, 3)).astype(float), rng.integers(0, 2, 60)
    x[0, 0] = np.nan
    for times in (1, 5):
        data = rows_of(spark, np.tile(x, (times, 1)), np.tile(y, times)).withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan")))))
        found = cells.counted(data, cells.edges(data, 1, 32)).collect()
        assert len(found) == len({(*map(str, r), t) for r, t in zip(x, y)}) and sum(r["n"] for r in found) == 60 * times


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_first_cut_is_the_best_of_all_and_leaves_hold_enough_rows(classes):
    rng = np.random.default_rng(classes)
    binned, n = rng.integers(0, 8, (150, 3)), rng.integers(1, 4, 150)
    label = (binned[:, 1] > 3) + 0.2 * rng.normal(size=150) if classes == 0 else np.minimum(binned[:, 1] // 3, classes - 1)
    where = np.zeros(150, np.int64) if classes == 0 else label
    amount = n * label if classes == 0 else n.astype(float)
    s = Forest(classes, depth=6, leaf=3)
    wide = Forest(classes, depth=1, leaf=3)
    object.__setattr__(s, "tried", lambda f: f)
    object.__setattr__(wide, "tried", lambda f: f)
    size = lambda at: sum(amount[at & (where == k)].sum() ** 2 for k in range(max(1, classes))) / n[at].sum()
    best = max(((size(binned[:, f] <= c) + size(binned[:, f] > c), f, c) for f in range(3) for c in range(7)), key=lambda v: v[0])
    feature, cut, left, right, sums, cover = forest.grow(binned, 8, where, amount, n.astype(float), n, 3, 1, np.random.default_rng(0), wide)
    assert np.isclose(size(binned[:, feature[0]] <= cut[0]) + size(binned[:, feature[0]] > cut[0]), best[0])
    feature, cut, left, right, sums, cover = forest.grow(binned, 8, where, amount, n.astype(float), n, 3, 6, np.random.default_rng(0), s)
    at = np.zeros(150, np.int64)
    while (inner := feature[at] >= 0).any():
        at = np.where(inner, np.where(binned[np.arange(150), feature[at]] <= cut[at], left[at], right[at]), at)
    for leaf in np.unique(at):
        assert n[at == leaf].sum() >= 3 and np.isclose(cover[leaf], n[at == leaf].sum())
        assert np.allclose(sums[leaf], [amount[(at == leaf) & (where == k)].sum() for k in range(max(1, classes))])
    assert set(np.flatnonzero(feature < 0)) == set(at)


def test_nodes_split_by_sums_are_those_that_tasks_grow(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 1))
    x[rng.random(400) < 0.1] = np.nan
    y = np.nan_to_num(x[:, 0], nan=2.0) ** 2 + 0.1 * rng.normal(size=400)
    member = rng.integers(0, 2, 400)
    s = Forest(0, trees=3, depth=5)
    whole = forest.fit(rows_of(spark, x, y, member), 2, s)
    monkeypatch.setattr(forest, "LOCAL", 40)
    monkeypatch.setattr(forest, "SUMS", 300)  # several rounds of sums, and of nodes in a task
    parts = forest.fit(rows_of(spark, x, y, member), 2, s)
    for a, b in zip(whole, parts):
        assert np.allclose(a.predict(x), b.predict(x)) and len(a.feature) == len(b.feature) and np.allclose(a.expected(), b.expected())
        assert np.allclose(b.shapley(x[:10], 0).sum(axis=1), b.predict(x[:10])[:, 0] - b.expected()[0])
        assert np.mean((a.predict(x)[:, 0] - y) ** 2) < 0.2 * np.var(y)


def test_forest_is_as_good_as_sparks(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(9)
    x = rng.normal(size=(1600, 4))
    y = np.digitize(x[:, 0] * x[:, 1] + 0.5 * x[:, 2], [-0.4, 0.4])
    model = Forested(forest.fit(rows_of(spark, x[:800], y[:800]), 1, Forest(3, trees=20, depth=8))[0], 3)
    ours = model.trees.predict(x[800:])
    assert np.allclose(ours.sum(axis=1), 1.0)
    data = spark.createDataFrame([([float(v) for v in r], float(t), int(k < 800)) for k, (r, t) in enumerate(zip(x, y))], "x array<double>, label double, train int").select(*[F.col("x")[k].alias(f"x{k}") for k in range(4)], "label", "train")
    made = VectorAssembler(inputCols=[f"x{k}" for k in range(4)], outputCol="features").transform(data)
    theirs = RandomForestClassifier(numTrees=20, maxDepth=8, minInstancesPerNode=2, seed=1).fit(made.where("train = 1")).transform(made.where("train = 0"))
    assert (ours.argmax(axis=1) == y[800:]).mean() >= theirs.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] - 0.02
    model.save(spark, f"{tmp_path}/m")
    table, inputs = data.select("x0", "x1", "x2", "x3").limit(50), ["x0", "x1", "x2", "x3"]
    rows, again = (m.transform(table, inputs).select("proba", "p").collect() for m in (model, Forested.load(f"{tmp_path}/m")))
    assert rows == again and all(r["p"] == int(np.argmax(r["proba"])) for r in rows)


def folds_table(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k % 3), None if k % 7 == 0 and k % 3 == 1 else float(np.exp(2 * rng.normal())), float(k % 11) if k % 5 else None, None if k % 9 == 0 else "abc"[k % 3] if k > 4 else f"rare{k}", f"v{k % 60}") for k in range(300)]
    return spark.createDataFrame(rows, "fold int, a double, b double, c string, d string").repartition(3).persist()


@pytest.mark.parametrize("linear", [False, True])
def test_statistics_of_folds_are_those_of_their_rows(spark, linear):
    dealt = folds_table(spark)
    made = features.fit_folds(dealt, 3, linear, ["a", "b"], ["c", "d"])
    assert len(made) == 4
    for k, own in enumerate(made):
        alone = features.Preprocessor(linear).fit(dealt.where(F.col("fold") != k).drop("fold"), ["a", "b"], ["c", "d"])
        assert (own.logs, own.low, own.high, own.gaps, own.levels, own.inputs) == (alone.logs, alone.low, alone.high, alone.gaps, {c: tuple(v) for c, v in alone.levels.items()}, alone.inputs)
        assert own.medians == pytest.approx(alone.medians) and own.scaled.keys() == alone.scaled.keys()
        assert all(own.scaled[c] == pytest.approx(alone.scaled[c]) for c in own.scaled)
        assert all(own.shares[c].orderBy("value").collect() == alone.shares[c].orderBy("value").collect() for c in own.high)


def test_folds_take_no_more_jobs(spark):
    dealt, took = folds_table(spark), []
    dealt.count()
    for folds in (2, 3):
        group = f"folds-{folds}"
        spark.sparkContext.setJobGroup(group, group)
        features.fit_folds(dealt.withColumn("fold", F.col("fold") % folds), folds, True, ["a", "b"], ["c"])
        took.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert took[0] == took[1]


def test_a_query_of_one_model_trains_that_model_only(spark, monkeypatch):
    from sparkloom.plans import catalog, model_queries

    asked = []

    def stop(df, columns, settings):
        asked.append(settings.models)
        raise InterruptedError

    monkeypatch.setattr(models, "train", stop)
    model_queries._trained.cache_clear()
    for name in ("model_rf", "model_gbt", "tree_shap", "leaderboard"):
        with pytest.raises(InterruptedError):
            catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [("rf",), ("gbt",), ("rf",), ("logreg", "rf", "gbt")]


def test_all_families_are_scored_as_each_alone(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=300), rng.integers(0, 4, 300)
    rows = [(k, float(a[k]), "uvwx"[b[k]], "yes" if a[k] + (b[k] > 1) + 0.3 * rng.normal() > 0.5 else "no") for k in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b string, y string")
    r = models.train(df, ["a", "b"], models.Settings("y", "classification", "id", models=("logreg", "rf", "gbt"), folds=2, rf_trees=10, rf_depth=5, gbt_trees=5, gbt_depth=2, gbt_rate=0.4))
    assert [x["status"] for x in r.board] == ["ok"] * 4, r.board
    assert isinstance(r.fitted["rf"].model, Forested) and type(r.fitted["gbt"].model) is Boosted
    for row in r.board:
        assert row["test"] == pytest.approx(models.score(r.fitted[row["key"]], r.test))
        assert row["key"] == "dummy" or row["primary_cv"] > 0.7
