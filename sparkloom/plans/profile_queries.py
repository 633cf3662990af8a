"""Queries over raw and typed tables: cleaning, typing, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.config import AMBIGUOUS_FORMATS, DATETIME_FORMATS
from sparkloom.functions import columns as C
from sparkloom.operators import quality as Q
from sparkloom.operators import stats as S
from sparkloom.operators import typing as T
from sparkloom.plans.registry import query, rounded

#: orders as a raw string table with the dirt that uploads have.
RAW = """SELECT o_orderkey AS row_id, CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderkey % 7 = 0 THEN ' N/A ' WHEN o_orderkey % 11 = 0 THEN '  ' WHEN o_orderkey % 13 = 0 THEN 'Unknown' ELSE o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 17 = 0 THEN '-' ELSE '$' || CAST(o_custkey AS VARCHAR) || '.50' END AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_custkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS flag,
 CAST(o_custkey AS VARCHAR) AS cust, CASE WHEN o_orderkey % 2 = 0 THEN '0' || CAST(o_custkey AS VARCHAR) ELSE 'x' END AS code, 'same' AS const FROM orders"""
_TOKENS = "('nan','null','none','na','n/a','n.a.','unknown','undefined','missing','not available','not applicable','?','??','-','--','#n/a','nil')"
_COLUMNS = ("order_id", "priority", "amount", "day", "flag", "cust", "code", "const")
_CLEAN = ", ".join(f"CASE WHEN lower(trim({c})) IN {_TOKENS} OR trim({c}) = '' THEN NULL ELSE {c} END AS {c}" for c in _COLUMNS)
CLEAN = f"SELECT row_id, {_CLEAN} FROM ({RAW})"


def raw(t):
    k, key, cust = F.col("o_orderkey"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    return t("orders").select(
        k.alias("row_id"), key.alias("order_id"), F.when(k % 7 == 0, " N/A ").when(k % 11 == 0, "  ").when(k % 13 == 0, "Unknown").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(k % 17 == 0, "-").otherwise(F.concat(F.lit("$"), cust, F.lit(".50"))).alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_custkey") % 2 == 0, "Yes").otherwise("no").alias("flag"),
        cust.alias("cust"), F.when(k % 2 == 0, F.concat(F.lit("0"), cust)).otherwise("x").alias("code"), F.lit("same").alias("const"),
    )


def clean(t):
    return Q.normalize_placeholders(raw(t))


@query("normalize_placeholders", CLEAN)
def _(t):
    return clean(t)


def _counts_sql(cols, table):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM {table}" for c in cols)


@query(
    "placeholder_report",
    f"""WITH r AS ({RAW}), c AS ({_counts_sql(_COLUMNS, 'r')}), p AS (SELECT "column", CASE WHEN trim(value) = '' THEN '<blank>' ELSE trim(value) END AS value FROM c WHERE lower(trim(value)) IN {_TOKENS} OR trim(value) = ''),
g AS (SELECT "column", value, count(*) AS n FROM p GROUP BY ALL)
SELECT "column", value, n, CAST(sum(n) OVER (PARTITION BY "column") AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INT) AS rank FROM g QUALIFY rank <= 10""",
)
def _(t):
    return Q.placeholder_report(raw(t))


def _dates_sql(columns, table: str) -> str:
    """A CTE body (name, format, ambiguous): the first format that parses 95 % of a column, and whether day and month may be swapped."""
    shares = " UNION ALL ".join(f"SELECT '{c}' AS name, {k} AS k, '{f}' AS f, avg(CAST(try_strptime({c}, '{f}') IS NOT NULL AS INT)) AS share FROM {table} WHERE {c} IS NOT NULL" for c in columns for k, (f, _) in enumerate(DATETIME_FORMATS))
    swapped = " OR ".join(f"count(*) FILTER (f IN ('{x}', '{y}')) = 2" for x, y in AMBIGUOUS_FORMATS)
    return f"SELECT name, arg_min(f, k) AS format, ({swapped}) AS ambiguous FROM ({shares}) WHERE share >= 0.95 GROUP BY 1"


_WORDS = {"true": "('true','t','yes','y')", "false": "('false','f','no','n')"}
#: The rules of the types, in SQL: evidence of each column (e), and the cascade over it (typed). CTEs to begin a query with.
TYPES_SQL = rf"""c AS ({CLEAN}), u AS ({_counts_sql(_COLUMNS, 'c')}), dates AS ({_dates_sql(_COLUMNS, 'c')}),
p AS (SELECT "column" AS name, value, lower(trim(value)) AS key, TRY_CAST(value AS DOUBLE) AS plain, CASE WHEN regexp_full_match(trim(value), '[-+]?[$€£₹¥]?\s?(\d{{1,3}}(,\d{{3}})+|\d+)(\.\d+)?\s?%?') THEN TRY_CAST(regexp_replace(value, '[,$€£₹¥%\s]', '', 'g') AS DOUBLE) END AS shaped FROM u WHERE value IS NOT NULL),
e AS (SELECT name, count(*) AS n, count(DISTINCT value) AS n_unique, avg(CAST(plain IS NOT NULL AS INT)) AS plain, avg(CAST(shaped IS NOT NULL AS INT)) AS shaped, avg(CAST(regexp_full_match(value, '0\d+') AS INT)) AS zeros,
 bool_and(plain % 1 = 0) AS whole_plain, bool_and(shaped % 1 = 0) AS whole_shaped, max(coalesce(plain, shaped)) - min(coalesce(plain, shaped)) + 1 AS width, bool_and(key IN {_WORDS['true']} OR key IN {_WORDS['false']}) AS bools,
 count(DISTINCT key) FILTER (key IN {_WORDS['true']}) AS trues, count(DISTINCT key) FILTER (key IN {_WORDS['false']}) AS falses, avg(CAST(regexp_matches(value, '\d') AS INT)) AS digits, avg(length(value)) AS avg_len, median(length(value)) AS med_len,
 median(len(regexp_extract_all(value, '\S+'))) AS med_tokens,
 regexp_matches(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '(^|[^a-z0-9])(id|uuid|guid)([^a-z0-9]|$)|identifier') AS by_name FROM p GROUP BY name),
k AS (SELECT e.*, n_unique / CAST(n AS DOUBLE) AS ratio, CASE WHEN bools AND trues = 1 AND falses = 1 THEN 'boolean' WHEN zeros <= 0.05 AND (plain >= 0.95 OR shaped >= 0.95) THEN 'number' WHEN format IS NOT NULL AND digits >= 0.95 AND med_len >= 6 THEN 'datetime'
 WHEN (avg_len >= 40 OR med_tokens >= 5) AND n_unique / CAST(n AS DOUBLE) >= 0.3 THEN 'text' ELSE 'other' END AS rule, CASE WHEN plain >= 0.95 THEN whole_plain ELSE whole_shaped END AS whole FROM e LEFT JOIN dates USING (name)),
i AS (SELECT *, CASE WHEN rule NOT IN ('number', 'other') OR rule = 'number' AND NOT (whole OR by_name) THEN NULL WHEN by_name AND ratio >= 0.99 THEN 'strong' WHEN rule = 'number' AND whole AND NOT by_name AND n >= 30 AND n_unique = n AND width = n THEN 'possible'
 WHEN by_name AND ratio >= 0.8 THEN 'possible' WHEN NOT by_name AND rule = 'other' AND n >= 30 AND ratio >= 0.9 THEN 'possible' END AS level FROM k),
typed AS (SELECT name, n, n_unique, CASE WHEN level IS NOT NULL THEN 'identifier' WHEN rule = 'number' THEN 'numerical' WHEN rule = 'other' THEN 'categorical' ELSE rule END AS semantic_type, CASE rule WHEN 'boolean' THEN 'bool' WHEN 'number' THEN 'numeric' WHEN 'datetime' THEN 'datetime' ELSE 'string' END AS storage_type, level AS identifier_level FROM i)"""


@query("infer_types", f"WITH {TYPES_SQL} SELECT name, semantic_type, storage_type, identifier_level FROM typed")
def _(t):
    df = clean(t).drop("row_id")
    meta = T.infer_types(df)
    return df.sparkSession.createDataFrame([(m.name, m.semantic_type, m.storage_type, m.identifier_level) for m in meta], "name string, semantic_type string, storage_type string, identifier_level string")


@query(
    "column_evidence",
    f"""WITH c AS ({CLEAN}), u AS ({_counts_sql(_COLUMNS, 'c')})
SELECT "column", count(value) AS n, round(avg(CASE WHEN value IS NOT NULL THEN CAST(TRY_CAST(value AS DOUBLE) IS NOT NULL AS INT) END), 6) AS plain,
 round(avg(CAST(regexp_matches(value, '^0[0-9]+$') AS INT)), 6) AS zeros, round(avg(CAST(regexp_matches(value, '[0-9]') AS INT)), 6) AS digits, round(avg(CAST(length(value) AS DOUBLE)), 6) AS avg_len, CAST(quantile_cont(length(value), 0.5) AS DOUBLE) AS med_len
FROM u GROUP BY 1""",
)
def _(t):
    return rounded(T.column_evidence(clean(t).drop("row_id")).select("column", "n", "plain", "zeros", "digits", "avg_len", "med_len"))


@query("parse_numeric", f"SELECT row_id, CAST(replace(amount, '$', '') AS DOUBLE) AS value FROM ({CLEAN})")
def _(t):
    return clean(t).select("row_id", C.parse_formatted(F.col("amount")).alias("value"))


@query("bool_vocab", f"SELECT lower(trim(flag)) AS word, min(flag) AS label, count(*) AS n, lower(trim(flag)) IN ('true','t','yes','y') AS truth FROM ({CLEAN}) WHERE flag IS NOT NULL GROUP BY 1")
def _(t):
    df = clean(t).where("flag is not null")
    return df.groupBy(F.lower(C.strip(F.col("flag"))).alias("word")).agg(F.min("flag").alias("label"), F.count("*").alias("n"), F.first(C.parse_boolean(F.col("flag"))).alias("truth"))


_DMY = f"SELECT day, priority, strftime(CAST(day AS DATE), '%d/%m/%Y') AS dmy, CASE WHEN row_id % 2 = 0 THEN strftime(CAST(day AS DATE), '%d.%m.%Y') ELSE strftime(CAST(day AS DATE), '%b %d, %Y') END AS two FROM ({CLEAN})"


@query("detect_datetime", f"WITH d AS ({_DMY}), f AS ({_dates_sql(('day', 'priority', 'dmy', 'two'), 'd')}) SELECT name AS \"column\", format, ambiguous FROM f UNION ALL SELECT 'two', 'mixed', false FROM (SELECT avg(CAST(coalesce(try_strptime(two, '%d.%m.%Y'), try_strptime(two, '%b %d, %Y')) IS NOT NULL AS INT)) AS share FROM d) WHERE share >= 0.95 AND NOT EXISTS (FROM f WHERE name = 'two')")
def _(t):
    day = F.to_date("day")
    df = clean(t).select("day", "priority", F.date_format(day, "dd/MM/yyyy").alias("dmy"), F.when(F.col("row_id") % 2 == 0, F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "MMM dd, yyyy")).alias("two"))
    found = T.datetime_format(df, df.columns)
    return df.sparkSession.createDataFrame([(c, f, a) for c, (f, a) in found.items()], "column string, format string, ambiguous boolean")


@query("parse_datetime", f"SELECT row_id, CAST(CAST(day AS DATE) AS TIMESTAMP) AS ts FROM ({CLEAN})")
def _(t):
    return clean(t).select("row_id", C.parse_datetime(F.col("day"), "%Y-%m-%d").alias("ts"))


@query("coerce_types", f"SELECT row_id, priority, CAST(replace(amount, '$', '') AS DOUBLE) AS amount, CAST(CAST(day AS DATE) AS TIMESTAMP) AS day, lower(flag) = 'yes' AS flag FROM ({CLEAN})")
def _(t):
    meta = [T.ColumnMeta("priority"), T.ColumnMeta("amount", storage_type="numeric", formatted_numeric=True), T.ColumnMeta("day", storage_type="datetime", datetime_format="%Y-%m-%d"), T.ColumnMeta("flag", storage_type="bool")]
    return T.coerce_types(clean(t).select("row_id", "priority", "amount", "day", "flag"), meta)


@query(
    "text_detect",
    """SELECT round(avg(CAST(length(text) AS DOUBLE)), 6) AS avg_len, CAST(quantile_cont(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')), 0.5) AS DOUBLE) AS med_tokens,
round(count(DISTINCT text) / CAST(count(text) AS DOUBLE), 6) AS unique_ratio FROM conversations""",
)
def _(t):
    e = T.column_evidence(t("conversations"), ["text"]).select("avg_len", "med_tokens", "n")
    u = S.distinct_counts(t("conversations"), ["text"]).select("unique")
    return rounded(e.crossJoin(F.broadcast(u)).select("avg_len", "med_tokens", (F.col("unique") / F.col("n").cast("double")).alias("unique_ratio")))


@query(
    "identifier_tiers",
    """SELECT 'o_orderkey' AS column, count(*) AS n, count(DISTINCT o_orderkey) AS n_unique, max(o_orderkey) - min(o_orderkey) + 1 = count(*) AND count(DISTINCT o_orderkey) = count(*) AS sequential FROM orders
UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey), max(o_custkey) - min(o_custkey) + 1 = count(*) AND count(DISTINCT o_custkey) = count(*) FROM orders""",
)
def _(t):
    df = t("orders")
    rows = df.agg(*[f(F.col(c)).alias(f"{c}_{m}") for c in ("o_orderkey", "o_custkey") for m, f in (("n", F.count), ("lo", F.min), ("hi", F.max))])
    flat = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_n").alias("n"), (F.col(f"{c}_hi") - F.col(f"{c}_lo") + 1).alias("span")) for c in ("o_orderkey", "o_custkey")])))
    return flat.join(S.distinct_counts(df, ["o_orderkey", "o_custkey"]), "column").select("column", "n", F.col("unique").alias("n_unique"), ((F.col("span") == F.col("n")) & (F.col("unique") == F.col("n"))).alias("sequential"))


_HOLES = "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity END AS l_quantity, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_discount END AS l_discount, CASE WHEN l_suppkey % 10 > 0 THEN NULL ELSE l_tax END AS l_tax, l_returnflag FROM lineitem"


def holes(t):
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_partkey") % 50 != 0, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_suppkey") % 10 <= 0, F.col("l_tax")).alias("l_tax"), "l_returnflag",
    )


_LEVEL = "CASE WHEN p <= 0 THEN 'none' WHEN p < 5 THEN 'low' WHEN p < 20 THEN 'moderate' WHEN p < 80 THEN 'high' ELSE 'very_high' END"


@query(
    "missing_columns",
    "WITH h AS (" + _HOLES + "), m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count({c}) AS non_null FROM h" for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")) + f"), p AS (SELECT *, missing / CAST(missing + non_null AS DOUBLE) * 100 AS p FROM m) SELECT \"column\", missing, non_null, round(p, 3) AS missing_pct, {_LEVEL} AS level FROM p",
)
def _(t):
    return Q.missing_columns(holes(t))


_ROWS = f"WITH h AS ({_HOLES}), r AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST((l_quantity IS NULL)::INT + (l_discount IS NULL)::INT + (l_tax IS NULL)::INT AS BIGINT) AS missing, CAST(3 AS BIGINT) AS total FROM h)"


def _numbered(t):
    return holes(t).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_quantity", "l_discount", "l_tax")


@query("missing_rows", _ROWS + " SELECT * FROM r WHERE missing / CAST(total AS DOUBLE) >= 0.7 ORDER BY missing DESC, row_id LIMIT 20")
def _(t):
    return Q.missing_rows(_numbered(t), "row_id")


@query(
    "missing_totals",
    _ROWS + " SELECT CAST(sum(missing) AS BIGINT) AS missing_cells, round(sum(missing) / CAST(sum(total) AS DOUBLE) * 100, 3) AS missing_cell_pct, count(*) FILTER (missing > 0) AS rows_with_any_missing, count(*) FILTER (missing / CAST(total AS DOUBLE) >= 0.7) AS flagged_rows FROM r",
)
def _(t):
    return Q.missing_totals(_numbered(t), "row_id")


@query("duplicates_exact", "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM (SELECT user_id, event_type, CAST(floor(value / 50) AS BIGINT) AS v FROM events) GROUP BY user_id, event_type, v)")
def _(t):
    return Q.duplicate_count(t("events").select("user_id", "event_type", F.floor(F.col("value") / 50).cast("long").alias("v")))


@query("duplicates_no_id", "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)")
def _(t):
    return Q.duplicate_count(t("customer"), ["c_nationkey", "c_mktsegment"])


@query("duplicate_examples", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS k FROM customer) WHERE k > 1 ORDER BY c_custkey LIMIT 10")
def _(t):
    return Q.duplicate_examples(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")


_CONST = "SELECT 'x' AS same, CASE WHEN o_orderkey % 100 = 0 THEN 'a' ELSE 'b' END AS nearly, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS none FROM orders"


@query(
    "constants",
    f"""WITH c AS ({_CONST}), u AS ({_counts_sql(('same', 'nearly', 'status', 'none'), 'c')}), g AS (SELECT "column", value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL),
s AS (SELECT "column", count(*) AS u, max(n) AS top, sum(n) AS total, arg_max(value, n) AS v FROM g GROUP BY 1)
SELECT "column", CASE WHEN u = 1 THEN 'constant' ELSE 'near_constant' END AS kind, u AS "unique", v AS top_value, round(top / CAST(total AS DOUBLE), 4) AS top_share FROM s WHERE u = 1 OR top / CAST(total AS DOUBLE) >= 0.95
UNION ALL SELECT 'none', 'all_missing', 0, NULL, NULL""",
)
def _(t):
    return Q.constants(t("orders").select(F.lit("x").alias("same"), F.when(F.col("o_orderkey") % 100 == 0, "a").otherwise("b").alias("nearly"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("none")))


def _formatting_sql(column, table):
    share = lambda p: f"round(avg(CAST(regexp_matches(x, '{p}') AS INT)), 6)"
    return (
        f"WITH v AS (SELECT {column} AS x FROM {table}), s AS (SELECT count(x) AS n, {share(r'^[^@ ]+@[^@ ]+[.][^@ ]+$')} AS email, {share(r'^(https?://|www[.])[^ ]+$')} AS url, {share(r'[^a-zA-Z0-9_ \\t\\n\\r]')} AS punctuation FROM v) "
        "SELECT *, CASE WHEN email >= 0.5 THEN 'email_like' WHEN url >= 0.5 THEN 'url_like' WHEN punctuation >= 0.3 THEN 'categorical_with_punctuation' END AS kind FROM s"
    )


@query("formatting_url", _formatting_sql("url", "pages"))
def _(t):
    return rounded(Q.formatting(t("pages"), ["url"]).select("n", "email", "url", "punctuation", "kind"))


@query("formatting_email", _formatting_sql("'user' || CAST(c_custkey AS VARCHAR) || '@mail.example'", "customer"))
def _(t):
    df = t("customer").select(F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@mail.example")).alias("address"))
    return rounded(Q.formatting(df, ["address"]).select("n", "email", "url", "punctuation", "kind"))


@query("formatting_phone", "WITH v AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'call ' ELSE '+1 ' END || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS x FROM customer), s AS (SELECT count(x) AS n, avg(CAST(regexp_full_match(x, '[+]?[0-9 ().-]{7,20}') AS INT)) AS phone, bool_or(regexp_matches(x, '[ ()+-]')) AS apart FROM v) SELECT n, round(phone, 6) AS phone, CASE WHEN phone >= 0.5 AND apart THEN 'phone_like' END AS kind FROM s")
def _(t):
    df = t("customer").select(F.concat(F.when(F.col("c_custkey") % 3 == 0, "call ").otherwise("+1 "), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone"))
    return rounded(Q.formatting(df, ["phone"]).select("n", "phone", "kind"))


@query("formatting_punct", _formatting_sql("c_name", "customer"))
def _(t):
    return rounded(Q.formatting(t("customer"), ["c_name"]).select("n", "email", "url", "punctuation", "kind"))


@query(
    "profile_overview",
    "SELECT count(*) AS rows, CAST(4 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS missing_cells, 0.0::DOUBLE AS missing_cell_pct, (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type, p_size, p_name)) AS duplicate_rows FROM part",
)
def _(t):
    return S.overview(t("part").select("p_brand", "p_type", "p_size", "p_name"))


@query("filter_nulls", f"SELECT count(*) AS kept, (SELECT count(*) FROM lineitem) - count(*) AS removed FROM ({_HOLES}) WHERE l_quantity IS NOT NULL")
def _(t):
    return holes(t).agg(F.count("l_quantity").alias("kept"), F.count_if(F.col("l_quantity").isNull()).alias("removed"))


@query("distinct_counts", " UNION ALL ".join(f"SELECT '{c}' AS column, count(DISTINCT {c}) AS \"unique\" FROM lineitem" for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_suppkey")))
def _(t):
    return S.distinct_counts(t("lineitem"), ["l_returnflag", "l_linestatus", "l_quantity", "l_suppkey"])


@query("set_vocab", "SELECT list_sort(list(DISTINCT w)) AS words, len(list(DISTINCT w) FILTER (w IN ('yes','no'))) AS known FROM (SELECT lower(trim(flag)) AS w FROM (" + CLEAN + "))")
def _(t):
    words = clean(t).select(C.strip(F.lower(F.col("flag"))).alias("w")).distinct().agg(F.array_sort(F.collect_set("w")).alias("words"))  # a boolean column's vocabulary
    return words.select("words", F.size(F.array_intersect("words", F.array(F.lit("yes"), F.lit("no")))).cast("long").alias("known"))
