"""Queries over sources, the dataset store and assembled findings."""

from __future__ import annotations


from pyspark.sql import functions as F

from sparkloom.operators import quality as Q
from sparkloom.operators import stats as S
from sparkloom.operators import typing as T
from sparkloom.operators import warnings as W
from sparkloom.plans.profile_queries import TYPES_SQL, CLEAN, clean, raw
from sparkloom.plans.registry import query
from sparkloom.sources import tables
from sparkloom.sources.scratch import new_folder


@query("scan_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t):
    df = t("customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    path = new_folder(df.sparkSession, "csv")
    df.write.option("header", True).csv(path)
    return tables.read_csv(df.sparkSession, path)


@query("load_typed", f"SELECT row_id, CAST(replace(amount, '$', '') AS DOUBLE) AS amount, CAST(CAST(day AS DATE) AS TIMESTAMP) AS day, lower(flag) = 'yes' AS flag FROM ({CLEAN})")
def _(t):
    """Raw table written, its types inferred once, and read back typed by that metadata."""
    df = raw(t).select("row_id", "amount", "day", "flag")
    path = new_folder(df.sparkSession, "raw")
    df.write.parquet(path)
    back = Q.normalize_placeholders(df.sparkSession.read.parquet(path))
    return T.coerce_types(back, T.infer_types(back.drop("row_id")))


@query("scan_xlsx", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def _(t):
    """Suppliers as workbooks, written by tasks, and back by ranges of rows."""
    df = t("supplier").select(F.col("s_suppkey").cast("string").alias("s_suppkey"), "s_name")
    path = new_folder(df.sparkSession, "workbooks")
    tables.write_workbooks(df, path)
    return tables.read_xlsx(df.sparkSession, path, rows=5000)


def _findings(t):
    df = clean(t).drop("row_id")
    meta = [m.as_dict() for m in T.infer_types(df)]
    rows = lambda x: [r.asDict() for r in x.collect()]  # noqa: E731  small findings
    exact = Q.duplicate_count(df).first()
    found = {"missing": rows(Q.missing_columns(df)), "duplicates": {"exact": exact["duplicates"]}, "constants": rows(Q.constants(df)), "placeholders": rows(Q.placeholder_report(raw(t).drop("row_id")))}
    return df, meta, found, exact["rows"]


@query(
    "quality_summary",
    f"""WITH {TYPES_SQL}, m AS (SELECT "column", count(*) - count(value) AS missing, (count(*) - count(value)) * 100.0 / count(*) AS pct FROM u GROUP BY 1),
g AS (SELECT "column", value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL), s AS (SELECT "column", count(*) AS k, max(n) / CAST(sum(n) AS DOUBLE) AS share FROM g GROUP BY 1)
SELECT 'missing' AS kind, "column", CASE WHEN pct < 5 THEN 'low' WHEN pct < 20 THEN 'moderate' WHEN pct < 80 THEN 'high' ELSE 'very_high' END AS detail FROM m WHERE missing > 0
UNION ALL SELECT 'constant', "column", CASE WHEN k = 1 THEN 'constant' ELSE 'near_constant' END FROM s WHERE k = 1 OR share >= 0.95
UNION ALL SELECT 'identifier', name, identifier_level FROM typed WHERE identifier_level IS NOT NULL""",
)
def _(t):
    df, meta, found, _rows = _findings(t)
    rows = [("missing", m["column"], m["level"]) for m in found["missing"] if m["missing"]] + [("constant", c["column"], c["kind"]) for c in found["constants"]] + [("identifier", m["name"], m["identifier_level"]) for m in meta if m["identifier_level"]]
    return df.sparkSession.createDataFrame(rows, "kind string, column string, detail string")


@query("warnings")
def _(t):
    df, meta, found, rows = _findings(t)
    return W.as_frame(df.sparkSession, rows, meta, found)


@query("union_rules", "SELECT 'constant' AS rule, 'o_shippriority' AS \"column\" WHERE 1 = 0 UNION ALL SELECT 'identifier', 'o_orderkey' FROM (SELECT count(*) - count(DISTINCT o_orderkey) AS d FROM orders) WHERE d = 0")
def _(t):
    df = t("orders").select("o_orderkey", "o_orderstatus")
    total = df.agg(F.count("*").alias("rows"))
    unique = S.distinct_counts(df, df.columns).crossJoin(F.broadcast(total)).where("unique = rows").select(F.lit("identifier").alias("rule"), "column")
    return Q.constants(df).select(F.lit("constant").alias("rule"), "column").unionByName(unique)
