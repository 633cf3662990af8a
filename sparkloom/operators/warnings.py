"""Warnings about a dataset: declared rules over small findings, put together and ordered in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.config import DEFAULT, Config

#: From the most severe down.
SEVERITIES = ("HIGH", "WARNING", "INFO")
FIELDS = ("severity", "column", "issue", "evidence", "recommendation", "category")
_SCHEMA = ", ".join(f"`{f}` string" for f in FIELDS)


@dataclass(frozen=True)
class Facts:
    """What the rules look at: the sizes, types, findings and statistics of one dataset."""

    rows: int
    meta: list[dict]
    quality: dict
    eda: dict
    target: str | None
    cfg: Config


@dataclass(frozen=True)
class Rule:
    """A kind of warning: where its findings are, when one counts, how severe it is, and what is said of it."""

    category: str
    findings: Callable[[Facts], Iterable[dict]]
    when: Callable[[dict, Facts], bool]
    severity: Callable[[dict, Facts], str]
    column: Callable[[dict, Facts], str | None]
    issue: Callable[[dict], str]
    evidence: Callable[[dict, Facts], str]
    advice: str

    def apply(self, facts: Facts) -> list[tuple]:
        found = [f for f in self.findings(facts) if self.when(f, facts)]
        return [(self.severity(f, facts), self.column(f, facts), self.issue(f), self.evidence(f, facts), self.advice, self.category) for f in found]


def _always(level: str):
    return lambda f, x: level


def _of(kind: str, *path: str):
    """Findings under a part of the facts: lists as they are, single records in a list."""

    def get(facts: Facts):
        found = getattr(facts, kind)
        for p in path:
            found = (found or {}).get(p)
        return found if isinstance(found, list) else [found] if found else []

    return get


def _placeholders(facts: Facts) -> list[dict]:
    """One finding a column, with all its values."""
    values: dict[str, list[str]] = {}
    for p in _of("quality", "placeholders")(facts):
        values.setdefault(p["column"], []).append(f"{p['value']!r} x {p['n']}")
    return [{"column": c, "values": v} for c, v in values.items()]


_named = lambda f, x: f["column"]
_meta = lambda f, x: f["name"]
_whole = lambda f, x: None
_any = lambda f, x: True

RULES = (
    Rule("leakage", _of("eda", "target", "leakage"), _any, _always("HIGH"), lambda f, x: f["feature"], lambda f: "Possible leakage of the target", lambda f, x: f"{f['reason']} {f['strength']:.3f}", "Make sure it is known when predictions are made."),
    Rule(
        "target", _of("quality", "missing"), lambda f, x: f["column"] == x.target and f["missing_pct"] > 0, lambda f, x: SEVERITIES[(f["missing_pct"] <= x.cfg.missing_moderate) + (f["missing_pct"] < x.cfg.missing_low)], _named,
        lambda f: f"{f['missing_pct']:.1f}% of the target is missing", lambda f, x: f"{f['missing']} rows", "Training leaves these rows out; make sure that is right.",
    ),
    Rule("target", _of("eda", "target"), lambda f, x: bool(f.get("imbalanced")), _always("WARNING"), lambda f, x: x.target, lambda f: "Imbalanced target", lambda f, x: f"smallest class {f['minority_pct']:.1f}%", "Judge by precision, recall and PR-AUC; classes are weighted."),
    Rule("size", lambda x: [{"rows": x.rows}], lambda f, x: f["rows"] < 200, _always("WARNING"), _whole, lambda f: "Few rows", lambda f, x: f"{f['rows']} rows", "Expect unstable metrics and keep models simple."),
    Rule("missing", _of("quality", "missing"), lambda f, x: f["column"] != x.target and f["level"] in ("high", "very_high"), _always("WARNING"), _named, lambda f: f"{f['missing_pct']:.1f}% missing", lambda f, x: f"{f['missing']} of {x.rows} rows", "Find out why, or drop the column."),
    Rule("missing", _of("quality", "missing_totals"), lambda f, x: bool(f.get("flagged_rows")), _always("WARNING"), _whole, lambda f: f"{f['flagged_rows']} rows lack most of their values", lambda f, x: f"at least {x.cfg.row_missing_flag:.0%}", "Consider dropping them."),
    Rule("duplicates", _of("quality", "duplicates"), lambda f, x: bool(f.get("exact")), _always("WARNING"), _whole, lambda f: f"{f['exact']} rows repeat others", lambda f, x: "", "Check whether they are real records."),
    Rule("duplicates", _of("quality", "duplicates"), lambda f, x: not f.get("exact") and bool(f.get("without_ids")), _always("WARNING"), _whole, lambda f: f"{f['without_ids']} rows repeat others but for identifiers", lambda f, x: "", "Identifiers may hide repeated records."),
    Rule("identifier", _of("meta"), lambda f, x: bool(f["identifier_level"]), _always("WARNING"), _meta, lambda f: f"{f['identifier_level']} identifier", lambda f, x: "; ".join(f["evidence"]), "Left out of models unless kept on purpose."),
    Rule("cardinality", _of("meta"), lambda f, x: f["high_cardinality"], _always("WARNING"), _meta, lambda f: "Many categories", lambda f, x: f"{f['n_unique']} values", "Encoded by frequency."),
    Rule("constant", _of("quality", "constants"), _any, _always("WARNING"), _named, lambda f: f["kind"].replace("_", " "), lambda f, x: f"{f['top_value']!r}", "Carries next to no information."),
    Rule(
        "outliers", _of("eda", "numeric"), lambda f, x: bool(f.get("outliers")), lambda f, x: SEVERITIES[1 + (f["outlier_pct"] <= x.cfg.outlier_warn_pct)], _named,
        lambda f: "Outliers", lambda f, x: f"{f['outliers']} values outside [{f['lower_bound']:.3g}, {f['upper_bound']:.3g}]", "Look at them before removing any.",
    ),
    Rule("correlation", _of("eda", "high_pairs"), _any, lambda f, x: SEVERITIES[1 + (abs(f["pearson"]) < x.cfg.corr_warn)], lambda f, x: f"{f['a']} / {f['b']}", lambda f: f"Correlation {f['pearson']:.2f}", lambda f, x: "Pearson", "Linear models may suffer."),
    Rule("distribution", _of("eda", "numeric"), lambda f, x: (f.get("skew_class") or "").startswith("strongly"), _always("INFO"), _named, lambda f: f["skew_class"], lambda f, x: f"skewness {f['skewness']:.2f}", "A logarithm may help linear models."),
    Rule("placeholder", _placeholders, _any, _always("INFO"), _named, lambda f: "Placeholder values", lambda f, x: ", ".join(f["values"]), "Read as missing; check that it is no category."),
    Rule("formatting", _of("quality", "formatting"), lambda f, x: bool(f.get("kind")), _always("INFO"), _named, lambda f: f"Looks like {f['kind'].replace('_', ' ')}", lambda f, x: "", "Review the format before use."),
    Rule("datetime", _of("meta"), lambda f, x: f["semantic_type"] == "datetime", _always("INFO"), _meta, lambda f: "Datetime column", lambda f, x: "; ".join(f["evidence"]), "Can carry a forecast; otherwise used as calendar features."),
)


def as_frame(spark: SparkSession, rows: int, meta: list[dict], quality: dict, eda: dict | None = None, target: str | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Warnings with FIELDS and rank: by severity, then in the order of RULES and of their findings.

    quality: missing, missing_totals, duplicates, constants, placeholders, formatting;
    eda: numeric, high_pairs, target. All are lists of small rows, at most a few a column.
    """
    facts = Facts(rows, meta, quality, eda or {}, target, cfg)
    found = [(*w, k) for k, w in enumerate(w for rule in RULES for w in rule.apply(facts))]
    level = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return spark.createDataFrame(found, f"{_SCHEMA}, place long").orderBy(level, "place").select(*FIELDS)


def build_warnings(spark: SparkSession, *args, **kwargs) -> list[dict]:
    """The same as records."""
    return [r.asDict() for r in as_frame(spark, *args, **kwargs).collect()]
