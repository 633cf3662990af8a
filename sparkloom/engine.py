"""The facade: ingest, profile, explore, warn, train, predict, forecast, report."""

from __future__ import annotations

import os
import threading
from collections import OrderedDict
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import artifacts, report
from sparkloom.config import DEFAULT, Config
from sparkloom.operators import association, forecast, models, normality, quality, stats, timeseries, typing, warnings
from sparkloom.operators.features import select_features
from sparkloom.registry import Registry
from sparkloom.sources.tables import ROW_ID, Store, from_records, jsonable

_rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  small findings only


def _grouped(df: DataFrame, names: list[str], order: str = "column") -> dict[str, list[dict]]:
    """Small findings by column, each in order."""
    out: dict[str, list[dict]] = {c: [] for c in names}
    for r in sorted(_rows(df), key=lambda r: r[order]):
        out[r.pop("column")].append(r)
    return out


class Dataset:
    """An ingested table."""

    def __init__(self, engine: Engine, dataset_id: str):
        self.engine, self.id = engine, dataset_id
        self.document = engine.store.meta(dataset_id)
        self.meta = [typing.ColumnMeta(**m) for m in self.document["columns"]]

    @property
    def frame(self) -> DataFrame:
        return self.engine.store.typed(self.id)

    def _by_type(self, kind: str) -> list[str]:
        return [m.name for m in self.meta if m.semantic_type == kind]

    def profile(self) -> dict:
        overview = stats.overview(self.frame.drop(ROW_ID)).first().asDict()
        kinds: dict[str, int] = {}
        for m in self.meta:
            kinds[m.semantic_type] = kinds.get(m.semantic_type, 0) + 1
        return {"overview": {**overview, "filename": self.document["filename"], "type_counts": kinds}, "columns": self.document["columns"]}

    def quality(self) -> dict:
        df, raw = self.frame, self.engine.store.raw(self.id)
        plain = df.drop(ROW_ID)
        strong = [m.name for m in self.meta if m.identifier_level == "strong"]
        rest = [c for c in plain.columns if c not in strong]
        numbers = tuple(m.name for m in self.meta if m.formatted_numeric)
        text = [m.name for m in self.meta if (m.storage_type == "string" or m.formatted_numeric) and m.n_non_null]
        exact = quality.duplicate_count(plain).first()["duplicates"]
        return {
            "missing": _rows(quality.missing_columns(plain, self.engine.cfg)), "missing_totals": quality.missing_totals(df, ROW_ID, self.engine.cfg).first().asDict(), "missing_rows": _rows(quality.missing_rows(df, ROW_ID, cfg=self.engine.cfg)),
            "duplicates": {"exact": exact, "without_ids": (quality.duplicate_count(plain, rest).first()["duplicates"] if rest else None) if strong else exact, "strong_identifiers": strong, "examples": [r[0] for r in quality.duplicate_examples(df, ROW_ID).collect()]},
            "constants": _rows(quality.constants(plain, self.engine.cfg)), "placeholders": _rows(quality.placeholder_report(raw.drop(ROW_ID))), "formatting": _rows(quality.formatting(raw, text, tuple(self._by_type("text")), numbers)) if text else [],
        }

    def eda(self, target: str | None = None, problem: str | None = None) -> dict:
        """Statistics by type, correlations and, for a target, associations and leakage. The last 20 results stay cached.

        Columns of a type share their reads; only the frequency of each datetime column is a search of its own.
        """
        if target is not None and target not in self.frame.columns:
            raise ValueError(f"no column {target}")
        key, cache = (self.id, target, problem), self.engine.cache
        if key in cache:
            cache.move_to_end(key)
            return cache[key]
        df = self.frame
        numeric, categorical, flags, text, dates = (self._by_type(k) for k in ("numerical", "categorical", "boolean", "text", "datetime"))
        out: dict = {"numeric": [], "high_pairs": [], "categorical_pairs": [], "target": None}
        if numeric:
            out["numeric"] = _rows(stats.numeric_summary(df, numeric).join(stats.outliers(df, numeric), "column", "left"))
            out["histograms"] = _grouped(stats.histograms(df, numeric), numeric, "bin")
            out["kde"] = _grouped(stats.densities(df, numeric), numeric, "k")
            out["normality"] = _grouped(normality.normality(df, numeric), numeric)
            some, out["correlation_limit"] = association.limited(numeric, self.engine.cfg.corr_max_cols)
            if len(some) > 1:
                out["pearson"], out["spearman"] = _rows(association.pearson(df, some)), _rows(association.spearman_matrix(df, some))
                out["high_pairs"] = _rows(association.high_pairs(df, some))
        out["categorical"] = _rows(stats.categorical_stats(df, categorical)) if categorical else []
        out["top_values"] = _rows(stats.top_values(df, categorical)) if categorical else []
        out["boolean"] = _rows(stats.boolean_stats(df, flags)) if flags else []
        tokens = _grouped(stats.top_tokens(df, text), text, "rank") if text else {}
        out["text"] = [{**r, "tokens": [{"token": x["token"], "n": x["n"]} for x in tokens[r["column"]]]} for r in _rows(stats.text_stats(df, text))] if text else []
        parts = _grouped(stats.all_date_parts(df, dates), dates, "value") if dates else {}
        out["datetime"] = [
            {**r, "frequency": timeseries.frequency(df, r["column"]), "parts": {p: [{p: x["value"], "n": x["n"]} for x in parts[r["column"]] if x["part"] == p] for p in ("year", "month", "weekday", *(["hour"] if r["has_time"] else []))}}
            for r in _rows(stats.datetime_stats(df, dates))
        ] if dates else []
        small = [m.name for m in self.meta if m.semantic_type == "categorical" and 2 <= m.n_unique <= 30]
        small, out["categorical_limit"] = association.limited(small, 15)
        out["categorical_pairs"] = _rows(association.categorical_pairs(df, small)) if len(small) > 1 else []
        if target:
            out["target"] = self._target(df, target, problem, numeric, categorical + flags)
        cache[key] = jsonable(out)
        if len(cache) > 20:
            cache.popitem(last=False)
        return cache[key]

    def _target(self, df, target, problem, numeric, categorical) -> dict:
        m = next(m for m in self.meta if m.name == target)
        advised = association.recommend_problem(m.n_unique, m.semantic_type, m.is_integer)
        problem = problem or advised
        if problem not in (None, "classification", "regression"):
            raise ValueError("the problem is classification or regression")
        if problem is None:
            return {"recommendation": None, "associations": [], "leakage": []}
        if problem == "regression" and m.semantic_type != "numerical":
            raise ValueError("regression needs a numerical target")
        features = [c for c in numeric if c != target], [c for c in categorical if c != target]
        out: dict = {"recommendation": advised, "problem": problem, "associations": _rows(association.target_associations(df, target, *features, problem)) if any(features) else [], "leakage": _rows(association.leakage_suspects(df, target, *features, problem)) if any(features) else []}
        if problem == "classification":
            classes = _rows(association.class_distribution(df, target))
            out |= {"classes": classes, "minority_pct": classes[0]["minority_pct"] if classes else None}
            out["imbalanced"] = bool(classes) and classes[0]["minority_pct"] < 100 * self.engine.cfg.imbalance_minority_share
        return out

    def warnings(self, target: str | None = None) -> list[dict]:
        return warnings.build_warnings(self.engine.spark, self.document["rows"], self.document["columns"], self.quality(), self.eda(target), target, self.engine.cfg)

    def report(self, target: str | None = None) -> str:
        p, q, e = self.profile(), self.quality(), self.eda(target)
        return report.build(self.document["filename"], {"Overview": [p["overview"]], "Columns": p["columns"], "Warnings": self.warnings(target), "Missing values": q["missing"], "Numeric": e["numeric"], "Categories": e["categorical"]})


class Engine:
    """Everything a user of the service does, as methods over Spark."""

    def __init__(self, spark: SparkSession, root: str | Path, cfg: Config = DEFAULT):
        self.spark, self.cfg = spark, cfg
        self.store, self.registry = Store(spark, root, cfg), Registry(spark, root)
        self.root = self.store.root
        self.cache: OrderedDict = OrderedDict()
        self.results: dict[str, object] = {}
        self.busy = threading.Lock()

    def config(self) -> dict:
        return asdict(self.cfg)

    def ingest(self, path: str) -> Dataset:
        return Dataset(self, self.store.ingest(path)["id"])

    def datasets(self) -> list[dict]:
        return self.store.list()

    def train(self, dataset: Dataset, target: str, problem: str, **settings) -> dict:
        """Runs an experiment to completion or failure; either is recorded. One runs at a time in a process."""
        m = next((m for m in dataset.meta if m.name == target), None)
        if m is None:
            raise ValueError(f"no column {target}")
        if m.semantic_type in ("identifier", "text", "datetime", "empty"):
            raise ValueError(f"a {m.semantic_type} column can't be a target")
        if problem == "regression" and m.semantic_type != "numerical":
            raise ValueError("regression needs a numerical target")
        if not self.busy.acquire(blocking=False):
            raise RuntimeError("another experiment is running")
        doc = self.registry.create(dataset.document["filename"], {"target": target, "problem": problem, **settings})
        self._status(doc, "queued")
        try:
            self._status(doc, "running")
            chosen, left = select_features(dataset.meta, target, settings.get("keep", ()), settings.get("drop", ()))
            result = models.train(dataset.frame, [c.name for c in chosen], models.Settings(target, problem, ROW_ID, **settings), self.cfg)
            leader = next(r for r in result.board if r["key"] == result.leader)
            doc["results"] = {"models": result.board, "leader": result.leader, "primary_metric": result.primary, "primary_test": leader["test"][result.primary], "beats_baseline": result.beats_baseline, "classes": result.classes, "split": result.split, "decisions": left}
            doc["results"] |= {"diagnostics": jsonable(artifacts.diagnostics(result)), "schema": jsonable(_rows(models.input_schema(dataset.frame, result.spec)))}
            artifacts.save(result, self._model_path(doc["id"]))
            self.results[doc["id"]] = result
            self._status(doc, "completed")
            self._mirror(doc)
        except Exception as e:  # a failed run is a result of its own
            doc["error"] = f"{type(e).__name__}: {e}"
            self._status(doc, "failed")
        finally:
            self.busy.release()
        return doc

    def forecast(self, dataset: Dataset, ts: str, y: str, **settings) -> dict:
        doc = self.registry.create(dataset.document["filename"], {"target": y, "datetime": ts, **settings}, "forecast")
        self._status(doc, "running")
        try:
            r = forecast.train(dataset.frame, ts, y, cfg=self.cfg, **settings)
            artifacts.save_forecast(r, self._model_path(doc["id"]))
            self.results[doc["id"]] = r
            primary = settings.get("primary", "rmse")
            leader = next(m for m in r["models"] if m["key"] == r["leader"])
            doc["results"] = {"models": r["models"], "leader": r["leader"], "primary_metric": primary, "primary_test": leader["test"][primary], "beats_baseline": r["beats_baseline"], "info": r["info"], "future": _rows(r["future"])}
            self._status(doc, "completed")
        except Exception as e:  # a failed run is a result of its own
            doc["error"] = f"{type(e).__name__}: {e}"
            self._status(doc, "failed")
        return doc

    def _status(self, doc: dict, status: str) -> None:
        doc["status"] = status
        self.registry.save(doc)

    def _completed(self, experiment_id: str):
        """The result of a completed run; one of an earlier process is read back."""
        doc = self.registry.get(experiment_id)
        if doc["status"] != "completed":
            raise ValueError("no completed run with a model")
        if experiment_id not in self.results:
            read = artifacts.load if "schema" in doc["results"] else artifacts.load_forecast
            self.results[experiment_id] = read(self.spark, self._model_path(experiment_id))
        return self.results[experiment_id]

    def _model_path(self, experiment_id: str) -> str:
        return f"{self.root}/models/{experiment_id}"

    def metrics(self, experiment_id: str) -> dict:
        """Leaderboard and the leader's diagnostics on the held-out rows."""
        r = self.registry.get(experiment_id)["results"] or {}
        return {k: r.get(k) for k in ("models", "leader", "primary_metric", "diagnostics")}

    def schema(self, experiment_id: str) -> list[dict]:
        """The inputs of a model, for a form."""
        return (self.registry.get(experiment_id)["results"] or {}).get("schema") or []

    def explain(self, experiment_id: str, key: str | None = None, rows: int = 500, repeats: int = 5) -> dict:
        """Permutation importance of the leader, and coefficients or Shapley values of a model."""
        r = self._completed(experiment_id)
        key = key or r.leader
        out = {"permutation": _rows(models.permutation_importance(r, repeats, rows))}
        if key in ("logreg", "linear"):
            return out | {"effects": _rows(models.linear_effects(r, self.spark, key))}
        if hasattr(r.fitted[key].model, "trees"):
            out |= {"shap": _rows(models.tree_shap(r, key)), "beeswarm": _rows(models.beeswarm(r, key))}
        return out

    def preprocessing(self, experiment_id: str) -> dict:
        """What each model's preprocessing learned."""
        return {k: artifacts.preprocessing(f.prep) for k, f in self._completed(experiment_id).fitted.items() if f.prep is not None}

    def experiment_report(self, experiment_id: str) -> str:
        """An HTML page about a run."""
        doc = self.registry.get(experiment_id)
        r = doc["results"] or {}
        d = r.get("diagnostics") or {}
        sections: dict = {"Run": [{"status": doc["status"], "leader": r.get("leader"), "metric": r.get("primary_metric"), "test": r.get("primary_test"), "beats the baseline": r.get("beats_baseline")}]}
        board = [{"model": m["key"], "status": m["status"], "cv": m.get("primary_cv")} for m in r.get("models", [])]
        sections["Models"] = report.table(board) + report.bars([m["model"] for m in board if m["cv"] is not None], [m["cv"] for m in board if m["cv"] is not None])
        sections |= {name.capitalize(): rows for name, rows in d.items() if name not in ("roc", "pr")}
        if d.get("roc"):
            sections["ROC curve"] = report.lines({"true positives": [p["tpr"] for p in d["roc"]], "false positives": [p["fpr"] for p in d["roc"]]})
        return report.build(doc["model"]["name"], sections)

    def check_inputs(self, experiment_id: str, rows: DataFrame) -> dict[str, list[str]]:
        """Columns of the model that the table lacks, and those with values that do not parse; both count as missing."""
        result = self._completed(experiment_id)
        clean, typed = self._typed(result, rows)
        lost = [f.name for f in result.spec if f.name in clean.columns]
        counts = typed.agg(*[F.count_if(clean_.isNotNull() & typed_.isNull()).alias(f"n{k}") for k, (clean_, typed_) in enumerate((F.col(f"`_raw_{c}`"), F.col(f"`{c}`")) for c in lost)]).first() if lost else {}
        return {"missing": [f.name for f in result.spec if f.name not in clean.columns], "unparseable": [c for k, c in enumerate(lost) if counts[f"n{k}"]]}

    def _typed(self, result, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The table without placeholders, and with the model's columns parsed beside what they were."""
        inputs = {f.name: f.kind for f in result.spec}
        clean = quality.normalize_placeholders(rows)
        parse = {"numeric": lambda c: F.coalesce(typing.C.parse_plain(c), typing.C.parse_formatted(c)), "bool": typing.C.parse_boolean, "datetime": lambda c: typing.C.parse_datetime(c, None)}
        strings = {c for c, t in clean.dtypes if t == "string"}
        kept = {f"_raw_{c}": F.col(f"`{c}`") for c in inputs if c in clean.columns}
        typed = clean.withColumns(kept) if kept else clean
        parsed = {c: parse[k](F.col(f"`{c}`")) for c, k in inputs.items() if c in strings and k in parse}
        return clean, typed.withColumns(parsed) if parsed else typed

    def predict(self, experiment_id: str, records: list[dict], key: str | None = None) -> DataFrame:
        return self.batch(experiment_id, from_records(self.spark, records), key)

    def batch(self, experiment_id: str, rows: DataFrame, key: str | None = None) -> DataFrame:
        """Predictions for a table of strings or typed columns; values that do not parse count as missing."""
        result = self._completed(experiment_id)
        inputs = {f.name: f.kind for f in result.spec}
        if not set(inputs) & set(rows.columns):
            raise ValueError("none of the model's columns is there")
        clean, typed = self._typed(result, rows)
        return models.predict(result, typed.select(*[F.col(f"`{c}`") for c in clean.columns]), key)

    def future(self, experiment_id: str, periods: int, key: str | None = None) -> DataFrame:
        r = self._completed(experiment_id)
        return forecast.future(r, periods, key)

    def _mirror(self, doc: dict) -> None:
        """Logs a run to MLflow where it is set up; never fails a run."""
        if os.environ.get("MLFLOW_TRACKING_URI"):
            try:
                import mlflow

                with mlflow.start_run(run_name=doc["model"]["name"]):
                    mlflow.log_params(doc["config"])
                    leader = next(m for m in doc["results"]["models"] if m["key"] == doc["results"]["leader"])
                    mlflow.log_metrics({f"test_{k}": v for k, v in (leader.get("test") or {}).items() if v is not None})
            except Exception:  # optional mirror
                pass
