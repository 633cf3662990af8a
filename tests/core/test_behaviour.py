"""Rules with known answers, on small frames made here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.config import Config
from sparkloom.engine import Engine
from sparkloom.operators import association as A
from sparkloom.operators import features as FE
from sparkloom.operators import forecast as FC
from sparkloom.operators import metrics as M
from sparkloom.operators import models as MO
from sparkloom.operators import quality as Q
from sparkloom.operators import stats as S
from sparkloom.operators import timeseries as TS
from sparkloom.operators import typing as T
from sparkloom.operators.normality import shapiro, shapiro_wilk
from sparkloom.sources import tables, workbooks


def frame(spark, columns: dict, types: str = "string"):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{n} {types}" for n in names))


def churn(n=240, seed=0):
    rng = np.random.default_rng(seed)
    age, income = rng.integers(18, 70, n), rng.lognormal(10, 1, n)
    score = rng.normal(size=n) + (age - 44) / 15
    return {
        "customer_id": [f"C{k:05d}" for k in range(n)], "age": [None if k < 10 else f"{a}.0" for k, a in enumerate(age)], "income": [f"{v:.2f}" for v in income], "plan": [["basic", "pro", "team"][k % 3] for k in range(n)],
        "signup": [f"2022-{1 + k // 28 % 12:02d}-{1 + k % 28:02d}" for k in range(n)], "const": ["x"] * n, "churn": ["yes" if s > 0 else "no" for s in score],
    }


@pytest.fixture(scope="module")
def meta(spark):
    return {m.name: m for m in T.infer_types(frame(spark, churn()))}


def test_types(meta):
    kinds = {c: m.semantic_type for c, m in meta.items()}
    assert kinds == {"customer_id": "identifier", "age": "numerical", "income": "numerical", "plan": "categorical", "signup": "datetime", "const": "categorical", "churn": "boolean"}
    assert meta["customer_id"].identifier_level == "strong" and meta["const"].constant and meta["churn"].bool_labels == {"true": "yes", "false": "no"}


def test_id_names():
    assert all(map(T.name_looks_like_id, ("customer_id", "userId", "ID", "row identifier"))) and not any(map(T.name_looks_like_id, ("paid", "valid_flag", "idea")))


def test_formatted_numbers_and_dates(spark):
    n = 60
    df = frame(spark, {"price": [f"${k},200.50" for k in range(1, n + 1)], "zip": [f"0{k:04d}" for k in range(n)], "day": [f"{1 + k % 28:02d}/{1 + k % 12:02d}/2024" for k in range(n)], "seq": [str(k) for k in range(n)], "bits": [str(k % 2) for k in range(n)], "none": [None] * n})
    m = {x.name: x for x in T.infer_types(df)}
    assert m["price"].semantic_type == "numerical" and m["price"].formatted_numeric and m["zip"].storage_type == "string"
    assert m["day"].datetime_format == "%d/%m/%Y" and m["seq"].identifier_level == "possible" and m["bits"].semantic_type == "numerical" and m["none"].semantic_type == "empty"
    typed = T.coerce_types(df, list(m.values())).orderBy("seq").first()
    assert typed["price"] == 1200.5 and str(typed["day"])[:10] == "2024-01-01"


def test_placeholders_keep_negatives(spark):
    df = frame(spark, {"a": ["1", "-5", "N/A", " unknown ", "-", "?", "  ", "3"]})
    assert [r[0] for r in Q.normalize_placeholders(df).where("a is not null").orderBy("a").collect()] == ["-5", "1", "3"]
    assert {(r["value"], r["n"]) for r in Q.placeholder_report(df).collect()} == {("N/A", 1), ("unknown", 1), ("-", 1), ("?", 1), ("<blank>", 1)}


def test_missing_and_duplicates(spark):
    df = spark.createDataFrame([(k, None if k % 2 else 1.0, k % 2, None) for k in range(100)], "id long, a double, x int, e string")
    got = {r["column"]: (r["missing_pct"], r["level"]) for r in Q.missing_columns(df).collect()}
    assert got == {"id": (0.0, "none"), "a": (50.0, "high"), "x": (0.0, "none"), "e": (100.0, "very_high")}
    assert Q.duplicate_count(df).first()["duplicates"] == 0 and Q.duplicate_count(df, ["x"]).first()["duplicates"] == 98
    assert [r[0] for r in Q.duplicate_examples(df, "id", ["a", "x"]).collect()] == list(range(2, 12))
    assert {r["column"]: r["kind"] for r in Q.constants(df.select("e", F.lit("c").alias("c"), F.when(F.col("id") < 99, "n").otherwise("o").alias("n"))).collect()} == {"e": "all_missing", "c": "constant", "n": "near_constant"}
    assert Q.missing_columns(df.limit(0)).where("missing > 0").count() == 0


def test_outliers_and_skew(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 101), 1000]], "v double")
    o = S.outliers(df).first()
    assert (o["outliers"], o["outlier_pct"], o["whisker_high"]) == (1, 0.99, 100.0)
    assert S.numeric_summary(df).first()["skew_class"] == "strongly right-skewed"
    assert sum(r["n"] for r in S.histogram(df, "v").collect()) == 101
    assert S.histogram(df.limit(0), "v").count() == 0 and S.kde(df.limit(5), "v").count() == 0


def test_associations(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=300)
    df = spark.createDataFrame([(float(x), float(2 * x + rng.normal() * 0.1), float(rng.normal()), "uvw"[k % 3], "xyz"[k % 3], "pq"[int(rng.integers(2))]) for k, x in enumerate(a)], "a double, b double, c double, s string, t string, r string")
    assert [(p["a"], p["b"]) for p in A.high_pairs(df).collect()] == [("a", "b")]
    assert A.cramers_v(df, "s", "t").first()[2] > 0.95 and A.cramers_v(df, "s", "r").first()[2] < 0.2
    assert A.leakage_suspects(df.withColumn("copy", F.col("a")), "a", ["copy", "c"], [], "regression").first()["feature"] == "copy"
    assert abs(A.spearman(df, "a", "b").first()[2] - np.corrcoef(a.argsort().argsort(), np.array([r[0] for r in df.select("b").collect()]).argsort().argsort())[0, 1]) < 1e-9


def test_metrics(spark):
    two = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.8), (1, 1, 0.9)], "y int, p int, score double")
    m = M.classification(two, 1).first()
    assert (m["accuracy"], round(m["precision"], 6), m["recall"], round(m["f1"], 6)) == (0.75, 0.666667, 1.0, 0.8)
    assert M.roc_auc(two).first()[0] == 1.0 and M.average_precision(two).first()[0] == 1.0
    r = M.regression(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 6.0)], "y double, p double")).first()
    assert (r["mae"], r["mse"], round(r["r2"], 6)) == (0.5, 1.0, 0.2)
    assert M.regression(spark.createDataFrame([(0.0, 1.0), (2.0, 2.0)], "y double, p double")).first()["mape"] is None


def test_splits_are_exact_and_stable(spark):
    df = spark.createDataFrame([(k, int(k < 10)) for k in range(100)], "id long, y int")
    parts = [FE.stratified_split(df.repartition(n), "id", "y").where("part = 'test'") for n in (1, 7)]
    assert [(p.count(), p.where("y = 1").count()) for p in parts] == [(20, 2), (20, 2)]
    assert {r["id"] for r in parts[0].collect()} == {r["id"] for r in parts[1].collect()}
    assert {r["n"] for r in FE.kfold(df, "id", "y").groupBy("fold", "y").agg(F.count("*").alias("n")).collect()} == {18, 2}


def test_learned_from_training_rows_only(spark):
    train = spark.createDataFrame([(float(k) if k % 5 else None, f"c{k % 50}") for k in range(200)], "a double, c string")
    prep = FE.Preprocessor(linear=True).fit(train, ["a"], ["c"])
    assert prep.high == ["c"] and prep.gaps == ["a"]
    out = prep.transform(spark.createDataFrame([(None, "c1"), (1e9, "new")], "a double, c string")).collect()
    again = prep.transform(spark.createDataFrame([(None, "c1"), (-3.0, "c2")], "a double, c string")).collect()
    assert out[0]["a"] == again[0]["a"] and {r["c_freq"] for r in out} == {r["c_freq"] for r in out}


def test_models(spark):
    data = frame(spark, churn())
    typed = T.coerce_types(data, T.infer_types(data)).withColumn("_row_id", F.monotonically_increasing_id())
    small = {"folds": 2, "rf_trees": 5, "rf_depth": 4, "gbt_trees": 3, "gbt_depth": 3}
    r = MO.train(typed, ["age", "plan", "income"], MO.Settings("churn", "classification", "_row_id", models=("logreg", "rf"), **small))
    assert [b["key"] for b in r.board] == ["dummy", "logreg", "rf"] and r.leader != "dummy" and r.beats_baseline and r.primary == "f1"
    p = MO.predict(r, typed.limit(3)).collect()
    assert all(abs(sum(x["probabilities"].values()) - 1) < 1e-6 and x["prediction"] in ("true", "false") for x in p)
    assert MO.permutation_importance(r, repeats=1, rows=60).first()["feature"] == "age"
    trees, made = MO.trees_of(r.fitted["rf"], spark), r.fitted["rf"].prep.transform(r.test).limit(40)
    x = np.array([[float(row[c]) for c in r.fitted["rf"].prep.inputs] for row in made.collect()])
    assert np.allclose(trees.predict(x), [row["proba"] for row in r.fitted["rf"].predict(r.test).limit(40).collect()])
    assert np.allclose(trees.shapley(x, 1).sum(axis=1), trees.predict(x)[:, 1] - trees.expected()[1])
    shap = MO.tree_shap(r, "rf", rows=20).collect()
    assert {s["feature"] for s in shap} == {"age", "plan", "income"} and MO.beeswarm(r, "rf", rows=20).where("feature = 'age'").agg(F.max("level")).first()[0] == 1.0
    with pytest.raises(ValueError, match="no column"):
        MO.train(typed, ["age"], MO.Settings("nope", "classification", "_row_id"))


def test_series(spark):
    df = spark.range(300).select(F.expr("timestamp_ntz'2023-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("date"), (100 + 0.1 * F.col("id") + 10 * F.sin(F.col("id") * 2 * np.pi / 7)).alias("sales"))
    holes = df.where("day(date) <> 11 or month(date) <> 1").unionByName(df.limit(1)).repartition(3)
    series, info = TS.prepare(holes, "date", "sales")
    assert (info["freq"], info["filled"], info["aggregated"], info["periods"]) == ("D", 1, 1, 300)
    assert TS.detect_season(series, "D", 300)[0] == 7 and TS.split_bounds(100) == (70, 85)
    with pytest.raises(ValueError, match="too short"):
        TS.split_bounds(3)
    r = FC.train(df, "date", "sales", horizon=7, keys=("naive", "snaive", "ets"))
    assert r["leader"] == "ets" and r["season"] == 7 and r["future"].count() == 7
    monthly = spark.range(48).select(F.expr("last_day(add_months(date'2020-01-01', cast(id as int)))").cast("timestamp_ntz").alias("d"), F.col("id").cast("double").alias("v"))
    assert TS.prepare(monthly, "d", "v")[1]["freq"] == "MS"
    model = FC.LagModel(7, trees=3, depth=2).fit(series)
    assert model.forecast(FC.future_stamps(series, "D", 3)).count() == 3
    with pytest.raises(ValueError, match="same"):
        TS.prepare(df, "date", "date")


def test_frequency_counts_periods_without_a_calendar(spark):
    """Stamps 50 seconds apart and one twenty years on: no calendar of them is made."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    stamps = [start + dt.timedelta(seconds=50 * k) for k in range(50)] + [dt.datetime(2045, 1, 1)]
    df = spark.createDataFrame([(s, 1.0) for s in stamps], "ts timestamp_ntz, y double")
    info = TS.frequency(df, "ts")
    assert info["freq"] == "50s" and info["gaps"] == int((stamps[-1] - start).total_seconds() // 50) + 1 - 51
    with pytest.raises(ValueError, match="coarser"):
        TS.prepare(df, "ts", "y")
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)]
    for freq, every in (("MS", days), ("QS", days), ("YS", days), ("B", days), ("W", days), ("D", days)):
        made = spark.createDataFrame([(d,) for d in days], "ts timestamp_ntz").select(TS.snap(F.col("ts"), freq).alias("ts")).distinct()
        ends = made.agg(F.min("ts"), F.max("ts")).first()
        assert TS.calendar(made, freq).count() == TS.count_periods(ends[0], ends[1], freq), freq


def test_gaps_across_ranges(spark):
    rng = np.random.default_rng(2)
    at = np.unique(rng.integers(0, 10**6, 3000))
    df = spark.createDataFrame([(int(a),) for a in at], "s long").select(F.timestamp_seconds("s").alias("ts"))
    got = {round(r["days"] * 86400): r["n"] for r in TS.gaps(df, "ts").collect()}
    steps, times = np.unique(np.diff(at), return_counts=True)
    assert got == dict(zip(steps.tolist(), times.tolist()))


def test_exact_quantiles(spark, monkeypatch):
    """The search narrows down to the same numbers, with ties, gaps and nulls."""
    from sparkloom.operators import common

    monkeypatch.setattr(common, "QUANTILE_ROWS", 40)
    rng = np.random.default_rng(1)
    data = {"normal": rng.normal(size=3000), "few": rng.integers(0, 5, 3000) * 1.0, "gap": np.r_[np.zeros(1800), rng.exponential(size=1200) * 1e9], "hot": np.r_[np.full(2990, 7.0), rng.normal(size=10)]}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())] + [(None,) * 4], "normal double, few double, gap double, hot double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = common.exact_quantiles(df, {c: F.col(c) for c in data}, probs)
    for c, x in data.items():
        assert np.allclose(got[c], np.quantile(x, probs), rtol=1e-9)
    assert common.exact_quantiles(df.limit(0), {"few": F.col("few")}, [0.5]) == {"few": [None]}


def test_csv_with_and_without_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a ""b"""\n2,c\n')
    (tmp_path / "b.csv").write_text('x,y\n1,"a\nb"\n2,c\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'a "b"'), ("2", "c")]
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "b.csv")).collect()] == [("1", "a\nb"), ("2", "c")]


def test_warnings_name_a_column_once(spark):
    from sparkloom.operators import warnings as W

    found = W.build_warnings(spark, 500, [], {"placeholders": [{"column": "a", "value": v, "n": 3} for v in ("-", "?", "n/a")], "missing": [{"column": "t", "missing_pct": 30.0, "missing": 150, "level": "high"}]}, target="t")
    assert [(w["severity"], w["column"]) for w in found] == [("HIGH", "t"), ("INFO", "a")] and found[1]["evidence"].count(" x 3") == 3


def test_formatting_kinds(spark):
    df = spark.createDataFrame([("$1,200", "a@b.com", "so, it goes. on and on", "a-b")] * 5, "m string, e string, t string, c string")
    assert {r["column"]: r["kind"] for r in Q.formatting(df, df.columns, ("t",), ("m",)).collect()} == {"m": "formatted_numeric", "e": "email_like", "t": "punctuation_rich_text", "c": "categorical_with_punctuation"}


def test_shapiro(spark):
    rng = np.random.default_rng(3)
    assert shapiro_wilk(rng.normal(size=400))[1] > 0.01 and shapiro_wilk(rng.exponential(size=400))[1] < 1e-6
    df = spark.createDataFrame([(float(v),) for v in rng.exponential(size=300)], "e double")
    assert shapiro(df, "e").first()["verdict"] == "normality rejected" and shapiro(df.limit(3), "e").count() == 0


def test_shapiro_over_all_rows(spark, monkeypatch):
    """Equal to the plain formula with ties, hot values and values dealt out in pieces, however the table is cut."""
    monkeypatch.setattr("sparkloom.operators.normality.PIECE", 100)
    rng = np.random.default_rng(4)
    few = rng.binomial(2, 0.5, size=4000).astype(float)
    hot = np.where(rng.random(4000) < 1 / 3, 0.0, rng.normal(5, 1, size=4000))
    rare = np.array([0.0] * 3998 + [1.0, 2.0])
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(zip(few, hot, rare, rng.normal(size=4000)))], "id long, few double, hot double, rare double, plain double")
    for column, values in (("few", few), ("hot", hot), ("rare", rare)):
        r, (w, p) = shapiro(df, column).first(), shapiro_wilk(values)
        assert r["n"] == 4000 and abs(r["w"] - w) < 1e-9 and abs(r["p"] - p) < 1e-6, column
    assert shapiro(df.repartition(5), "plain").first()["verdict"] == "normality not rejected" and shapiro(df.where("rare < 2"), "rare").count() == 0
    for n in (8, 9, 11, 12, 30):
        own = df.limit(n).persist()
        values = [r["hot"] for r in own.select("hot").collect()]
        assert abs(shapiro(own, "hot").first()["w"] - shapiro_wilk(np.array(values))[0]) < 1e-9


def test_uploads(spark, tmp_path):
    assert tables.safe_filename("../../x/ev*il?.csv") == "ev_il_.csv" and tables.sniff("a;b;c\né;1,2;3".encode("latin-1")) == ("ISO-8859-1", ";")
    assert tables.clean_names([" a ", "", "a"]) == ["a", "unnamed_1", "a.1"]
    for name, data in (("x.exe", b"a"), ("x.csv", b""), ("x.xlsx", b"no")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(tables.UploadError):
            tables.parse_upload(spark, str(tmp_path / name))
    (tmp_path / "ok.csv").write_text('a|b c|\n1|"x ""y""\nz"|\n|2|3\n')
    df = tables.parse_upload(spark, str(tmp_path / "ok.csv"))
    assert df.columns == ["a", "b c", "unnamed_2"] and [tuple(r) for r in df.collect()] == [("1", 'x "y"\nz', None), (None, "2", "3")]
    with pytest.raises(tables.UploadError, match="rows"):
        tables.parse_upload(spark, str(tmp_path / "ok.csv"), Config(max_rows=1))
    workbooks.write(str(tmp_path / "w.xlsx"), ["p", "q"], [("1", None), ("é<", "2")])
    assert [tuple(r) for r in tables.parse_upload(spark, str(tmp_path / "w.xlsx")).collect()] == [("1", None), ("é<", "2")]


def test_engine(spark, tmp_path):
    data = churn()
    lines = [",".join(data), *(",".join("" if v is None else v for v in row) for row in zip(*data.values()))]
    (tmp_path / "churn.csv").write_text("\n".join(lines))
    engine = Engine(spark, tmp_path / "store")
    ds = engine.ingest(str(tmp_path / "churn.csv"))
    assert ds.profile()["overview"]["rows"] == 240 and ds.quality()["duplicates"]["exact"] == 0
    kinds = {w["category"] for w in ds.warnings("churn")}
    assert {"identifier", "constant", "datetime", "distribution"} <= kinds and "<h1>churn.csv</h1>" in ds.report()
    doc = engine.train(ds, "churn", "classification", models=("logreg",), folds=2)
    assert doc["status"] == "completed" and engine.registry.headline(doc)["leader"] == "logreg"
    out = engine.predict(doc["id"], [{"age": "60", "plan": "pro", "income": "abc"}]).first()
    assert out["prediction"] in ("true", "false")
    rows = spark.createDataFrame([("60", "abc", "pro"), ("61", None, "pro")], "age string, income string, other string")
    assert engine.check_inputs(doc["id"], rows)["unparseable"] == ["income"] and "plan" in engine.check_inputs(doc["id"], rows)["missing"]
    again = Engine(spark, tmp_path / "store")  # as after a restart
    assert again.predict(doc["id"], [{"age": "60", "plan": "pro", "income": "abc"}]).first()["confidence"] == pytest.approx(out["confidence"])
    assert {s["column"] for s in again.schema(doc["id"])} >= {"age", "plan", "income"} and again.metrics(doc["id"])["diagnostics"]["confusion"]
    assert again.explain(doc["id"], rows=40, repeats=1)["effects"] and again.preprocessing(doc["id"])["logreg"]["medians"]
    assert "<h1>churn-churn-tabular</h1>" in again.experiment_report(doc["id"]) and "<svg" in again.experiment_report(doc["id"])
    engine.busy.acquire()
    with pytest.raises(RuntimeError, match="running"):
        engine.train(ds, "churn", "classification")
    engine.busy.release()
    other = engine.train(ds, "churn", "classification", models=("logreg",), folds=2)
    engine.registry.set_status(doc["id"], "Production")
    engine.registry.set_status(other["id"], "Production")
    assert engine.registry.get(doc["id"])["model"]["registry_status"] == "Archived" and other["model"]["version"] == 2
    assert engine.train(ds, "churn", "classification", models=("logreg",), primary="rmse")["status"] == "failed"
    with pytest.raises(ValueError):
        engine.train(ds, "customer_id", "classification")
