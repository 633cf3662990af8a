"""Queries over statistics and associations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import association as A
from sparkloom.operators import stats as S
from sparkloom.operators.common import mean_ranks
from sparkloom.plans.registry import query, rounded

_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _union(template: str, columns) -> str:
    return " UNION ALL ".join(template.replace("@", c) for c in columns)


_SUMMARY = """SELECT '@' AS "column", count(@) AS count, count(*) - count(@) AS missing, 0.0::DOUBLE AS missing_pct, round(avg(@), 6) AS mean, round(median(@), 6) AS median, round(stddev_samp(@), 6) AS std, min(@) AS min,
 round(quantile_cont(@, 0.25), 6) AS q1, round(quantile_cont(@, 0.75), 6) AS q3, max(@) AS max, round(quantile_cont(@, 0.75) - quantile_cont(@, 0.25), 6) AS iqr, round(skewness(@), 6) AS skewness, round(kurtosis(@), 6) AS kurtosis,
 CASE WHEN abs(skewness(@)) < 0.5 THEN 'approximately symmetric' WHEN abs(skewness(@)) < 1 THEN 'moderately ' || CASE WHEN skewness(@) > 0 THEN 'right' ELSE 'left' END || '-skewed' ELSE 'strongly ' || CASE WHEN skewness(@) > 0 THEN 'right' ELSE 'left' END || '-skewed' END AS skew_class FROM lineitem"""


@query("numeric_summary", _union(_SUMMARY, _MEASURES))
def _(t):
    return rounded(S.numeric_summary(t("lineitem"), list(_MEASURES)))


_FENCES = """SELECT '@' AS "column", lo AS lower_bound, hi AS upper_bound, count(*) FILTER (v < lo OR v > hi) AS outliers, round(count(*) FILTER (v < lo OR v > hi) / CAST(count(v) AS DOUBLE) * 100, 3) AS outlier_pct,
 min(v) FILTER (v BETWEEN lo AND hi) AS whisker_low, max(v) FILTER (v BETWEEN lo AND hi) AS whisker_high
 FROM (SELECT value AS v, quantile_cont(value, 0.25) OVER () - 1.5 * (quantile_cont(value, 0.75) OVER () - quantile_cont(value, 0.25) OVER ()) AS lo, quantile_cont(value, 0.75) OVER () + 1.5 * (quantile_cont(value, 0.75) OVER () - quantile_cont(value, 0.25) OVER ()) AS hi
 FROM (SELECT @ AS value FROM #)) GROUP BY lo, hi"""


def _rounded_sql(sql: str, columns: dict[str, bool]) -> str:
    return "SELECT " + ", ".join(f'round({c}, 6) AS {c}' if r else c for c, r in columns.items()) + f" FROM ({sql})"


_FENCE_COLUMNS = {'"column"': False, "lower_bound": True, "upper_bound": True, "outliers": False, "outlier_pct": True, "whisker_low": True, "whisker_high": True}


@query("outliers_iqr", _rounded_sql(_FENCES.replace("@", "value").replace("#", "events"), _FENCE_COLUMNS))
def _(t):
    return rounded(S.outliers(t("events"), ["value"]))


@query("boxplot", "SELECT \"column\", whisker_low, whisker_high FROM (" + _FENCES.replace("@", "o_totalprice").replace("#", "orders") + ")")
def _(t):
    return S.outliers(t("orders"), ["o_totalprice"]).select("column", "whisker_low", "whisker_high")


@query(
    "histogram",
    """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, CAST(least(30, greatest(5, floor(sqrt(count(value))))) AS INT) AS b FROM events), w AS (SELECT *, (hi - lo) / b AS w FROM s),
c AS (SELECT CAST(least(floor((value - lo) / w), b - 1) AS INT) AS bin, count(*) AS n FROM events, w GROUP BY 1)
SELECT CAST(k AS INT) AS bin, round(lo + k * w, 6) AS low, round(lo + (k + 1) * w, 6) AS high, coalesce(n, 0) AS n FROM w, range(30) r(k) LEFT JOIN c ON c.bin = k""",
)
def _(t):
    return rounded(S.histogram(t("events"), "value"))


@query(
    "kde",
    """WITH s AS (SELECT count(value) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM events), h AS (SELECT *, sd * pow(n, -0.2) AS h, (hi - lo) / 79 AS step FROM s),
g AS (SELECT CAST(k AS INT) AS k, lo + k * step AS x, h, n FROM h, range(80) r(k))
SELECT k, round(any_value(x), 6) AS x, round(sum(exp(-pow((x - value) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS y FROM g, events GROUP BY k""",
)
def _(t):
    return rounded(S.kde(t("events"), "value"))


_CATS = ("o_orderstatus", "o_orderpriority")


@query(
    "categorical_stats",
    _union(
        """SELECT '@' AS "column", CAST(sum(n) AS BIGINT) AS count, CAST(0 AS BIGINT) AS missing, count(*) AS "unique", round(count(*) / CAST(sum(n) AS DOUBLE), 4) AS cardinality_ratio, max(v) FILTER (k = 1) AS most_frequent, max(n) AS frequency,
 round(max(n) / CAST(sum(n) AS DOUBLE) * 100, 3) AS frequency_pct, CASE WHEN count(*) <= 10 THEN 'low' WHEN count(*) <= 50 THEN 'medium' ELSE 'high' END AS cardinality_class, count(*) FILTER (n / CAST(t AS DOUBLE) < 0.01) AS rare_categories,
 round(sum(n) FILTER (k <= 5) / CAST(sum(n) AS DOUBLE) * 100, 3) AS top5_pct FROM (SELECT @ AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, @) AS k, sum(count(*)) OVER () AS t FROM orders GROUP BY @)""",
        _CATS,
    ),
)
def _(t):
    return S.categorical_stats(t("orders"), list(_CATS))


@query("top_values", "SELECT 'p_brand' AS \"column\", CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS INT) AS rank, p_brand AS value, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 3) AS pct FROM part GROUP BY p_brand QUALIFY rank <= 20")
def _(t):
    return S.top_values(t("part"), ["p_brand"])


@query("rare_categories", "SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY p_size HAVING count(*) / CAST((SELECT count(*) FROM part) AS DOUBLE) < 0.02")
def _(t):
    return S.rare_categories(t("part"), "p_size", share=0.02)


@query("boolean_stats", "SELECT 'late' AS \"column\", count(*) FILTER (b) AS n_true, count(*) FILTER (NOT b) AS n_false, CAST(0 AS BIGINT) AS missing, round(count(*) FILTER (b) / CAST(count(*) AS DOUBLE) * 100, 3) AS true_pct, round(count(*) FILTER (NOT b) / CAST(count(*) AS DOUBLE) * 100, 3) AS false_pct FROM (SELECT l_linestatus = 'O' AS b FROM lineitem)")
def _(t):
    return S.boolean_stats(t("lineitem").select((F.col("l_linestatus") == "O").alias("late")), ["late"])


@query("text_stats", "SELECT 'text' AS \"column\", round(avg(CAST(length(text) AS DOUBLE)), 6) AS avg_length, CAST(quantile_cont(length(text), 0.5) AS DOUBLE) AS median_length, count(*) - count(text) AS missing, count(DISTINCT text) AS \"unique\" FROM documents")
def _(t):
    return rounded(S.text_stats(t("documents"), ["text"]))


@query(
    "token_counts",
    "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']{3,}')) AS token FROM conversations) WHERE token NOT IN (" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + ") GROUP BY token ORDER BY n DESC, token LIMIT 15",
)
def _(t):
    return S.token_counts(t("conversations"), "text")


@query("datetime_stats", "SELECT 'ts' AS \"column\", count(*) - count(ts) AS missing, min(ts) AS min, max(ts) AS max, round(date_diff('microsecond', min(ts), max(ts)) / 86400e6, 6) AS duration_days, bool_or(ts <> date_trunc('day', ts)) AS has_time FROM events")
def _(t):
    return rounded(S.datetime_stats(t("events"), ["ts"]))


for _part, _sql in (("year", "year(ts)"), ("month", "month(ts)"), ("weekday", "isodow(ts) - 1"), ("hour", "hour(ts)")):

    @query(f"by_{_part}", f"SELECT CAST({_sql} AS BIGINT) AS {_part}, count(*) AS n FROM events GROUP BY 1")
    def _(t, part=_part):
        return S.date_part_counts(t("events"), "ts", part)


_PAIRS = [(a, b) for k, a in enumerate(_MEASURES) for b in _MEASURES[k + 1 :]]


@query("pearson_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS pearson FROM lineitem" for a, b in _PAIRS))
def _(t):
    return rounded(A.pearson(t("lineitem"), list(_MEASURES)))


@query("high_corr_pairs", "WITH x AS (SELECT l_quantity, l_quantity * 2 + l_discount AS l_extendedprice, l_tax FROM lineitem), r AS (SELECT " + ", ".join(f"{c}, CAST(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS DOUBLE) AS r_{c}" for c in ("l_quantity", "l_extendedprice", "l_tax")) + " FROM x), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS p, corr(r_{a}, r_{b}) AS s FROM r" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax"))) + ") SELECT a, b, round(p, 6) AS pearson, round(s, 6) AS spearman, 'high' AS strength FROM p WHERE abs(p) >= 0.7")
def _(t):
    df = t("lineitem").select("l_quantity", (F.col("l_quantity") * 2 + F.col("l_discount")).alias("l_extendedprice"), "l_tax")
    return rounded(A.high_pairs(df))


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("spearman", f"SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(rx, ry), 6) AS spearman FROM (SELECT CAST({_RANK.format(c='l_quantity')} AS DOUBLE) AS rx, CAST({_RANK.format(c='l_extendedprice')} AS DOUBLE) AS ry FROM lineitem)")
def _(t):
    return rounded(A.spearman(t("lineitem"), "l_quantity", "l_extendedprice"))


@query("pct_rank", f"SELECT DISTINCT value, round(CAST({_RANK.format(c='value')} AS DOUBLE) / count(*) OVER (), 6) AS pct_rank FROM events WHERE value IS NOT NULL")
def _(t):
    ranks = mean_ranks(t("events"), "value")
    n = ranks.agg(F.sum("n").alias("total"))
    return rounded(ranks.crossJoin(F.broadcast(n)).select("value", (F.col("rank") / F.col("total")).alias("pct_rank")))


@query("crosstab", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    return A.crosstab(t("orders"), "o_orderstatus", "o_orderpriority")


def _cramers_sql(a: str, b: str, table: str) -> str:
    return f"""(WITH c AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, CAST(count(*) AS DOUBLE) AS o FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb FROM c),
s AS (SELECT sum(o * o / (ra * cb)) AS s, CAST(count(DISTINCT a) AS DOUBLE) AS r, CAST(count(DISTINCT b) AS DOUBLE) AS k, sum(o) AS n FROM m)
SELECT '{a}' AS a, '{b}' AS b, round(sqrt(greatest(0, s - 1 - (k - 1) * (r - 1) / (n - 1)) / (least(k - pow(k - 1, 2) / (n - 1), r - pow(r - 1, 2) / (n - 1)) - 1)), 6) AS cramers_v FROM s)"""


@query("cramers_v", "SELECT * FROM " + _cramers_sql("l_returnflag", "l_linestatus", "lineitem"))
def _(t):
    return rounded(A.cramers_v(t("lineitem"), "l_returnflag", "l_linestatus"))


@query("categorical_pairs", "SELECT * FROM (" + " UNION ALL ".join("SELECT * FROM " + _cramers_sql(a, b, "(SELECT l_returnflag, l_linestatus, l_returnflag || 'x' AS copy FROM lineitem)") for a, b in (("l_returnflag", "l_linestatus"), ("l_returnflag", "copy"), ("l_linestatus", "copy"))) + ") WHERE cramers_v >= 0.5")
def _(t):
    return rounded(A.categorical_pairs(t("lineitem").select("l_returnflag", "l_linestatus", F.concat("l_returnflag", F.lit("x")).alias("copy")), ["l_returnflag", "l_linestatus", "copy"]))


def _eta_sql(c: str, x: str, table: str) -> str:
    return f"(SELECT sqrt(sum(n * pow(m - mu, 2)) / any_value(sst)) AS eta FROM (SELECT {c} AS c, count(*) AS n, avg({x}) AS m FROM {table} GROUP BY 1), (SELECT avg({x}) AS mu, var_pop({x}) * count({x}) AS sst FROM {table}))"


@query("correlation_ratio", f"SELECT round(eta, 6) AS eta FROM {_eta_sql('o_orderpriority', 'o_totalprice', 'orders')}")
def _(t):
    return rounded(A.correlation_ratio(t("orders"), "o_orderpriority", "o_totalprice"))


@query("cap_categories", "WITH k AS (SELECT p_size FROM part GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 5) SELECT p_partkey, CASE WHEN p_size IN (SELECT p_size FROM k) THEN CAST(p_size AS VARCHAR) ELSE '__other__' END AS p_size FROM part")
def _(t):
    # the key is ordered as a number before it becomes text
    df = t("part").select("p_partkey", F.lpad(F.col("p_size").cast("string"), 6, "0").alias("p_size"))
    return S.cap_categories(df, "p_size", top=5).select("p_partkey", F.regexp_replace("p_size", "^0+(?=\\d)", "").alias("p_size"))


@query("class_distribution", "WITH g AS (SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1) SELECT value, n, round(n / CAST(sum(n) OVER () AS DOUBLE) * 100, 3) AS pct, count(*) OVER () AS n_classes, round(min(n) OVER () / CAST(sum(n) OVER () AS DOUBLE) * 100, 3) AS minority_pct, round(max(n) OVER () / CAST(min(n) OVER () AS DOUBLE), 3) AS imbalance_ratio FROM g")
def _(t):
    return A.class_distribution(t("orders"), "o_orderstatus")


_BAND = "CASE WHEN abs(strength) < 0.3 THEN 'low' WHEN abs(strength) < 0.7 THEN 'moderate' ELSE 'high' END AS band"


@query(
    "target_associations",
    "SELECT feature, measure, round(strength, 6) AS strength, " + _BAND + " FROM (SELECT 'l_quantity' AS feature, 'pearson' AS measure, abs(corr(l_quantity, l_extendedprice)) AS strength FROM lineitem UNION ALL SELECT 'l_discount', 'pearson', abs(corr(l_discount, l_extendedprice)) FROM lineitem UNION ALL SELECT 'l_returnflag', 'correlation_ratio', eta FROM "
    + _eta_sql("l_returnflag", "l_extendedprice", "lineitem") + ")",
)
def _(t):
    return rounded(A.target_associations(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"], "regression"))


@query("recommend_problem", " UNION ALL ".join(f"SELECT '{c}' AS target, CASE WHEN {text} OR n = 2 OR {whole} AND n <= 10 THEN 'classification' ELSE 'regression' END AS problem FROM (SELECT count(DISTINCT {c}) AS n FROM orders)" for c, text, whole in (("o_orderstatus", "true", "false"), ("o_totalprice", "false", "false"), ("o_orderkey", "false", "true"))))
def _(t):
    df = t("orders")
    rows = [(r["column"], A.recommend_problem(r["unique"], "categorical" if r["column"] == "o_orderstatus" else "numerical", r["column"] == "o_orderkey")) for r in S.distinct_counts(df, ["o_orderstatus", "o_totalprice", "o_orderkey"]).collect()]
    return df.sparkSession.createDataFrame(rows, "target string, problem string")


@query("leakage_suspects", "SELECT 'copy' AS feature, 1.0::DOUBLE AS strength, 'identical' AS reason UNION ALL SELECT 'double', round(r, 6), 'pearson' FROM (SELECT abs(corr(l_extendedprice, 2 * l_extendedprice + l_tax)) AS r FROM lineitem)")
def _(t):
    x = F.col("l_extendedprice")
    df = t("lineitem").select("l_extendedprice", x.alias("copy"), (2 * x + F.col("l_tax")).alias("double"), "l_quantity")
    return rounded(A.leakage_suspects(df, "l_extendedprice", ["copy", "double", "l_quantity"], [], "regression"))


@query("det_sample", "SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey LIMIT 100")
def _(t):
    """The 100 rows of lowest hash: the same rows on every run and layout (a sampling operator)."""
    return S.plot_sample(t("orders"), "o_orderkey", 100).select("o_orderkey")


@query("spearman_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS spearman FROM (SELECT CAST({_RANK.format(c=a)} AS DOUBLE) AS ra, CAST({_RANK.format(c=b)} AS DOUBLE) AS rb FROM lineitem)" for a, b in _PAIRS))
def _(t):
    return rounded(A.spearman_matrix(t("lineitem"), list(_MEASURES)))


# ---------------------------------------------------------------- scalar functions


@query("fn_string", "SELECT c_custkey, lower(c_name) AS low, CAST(length(c_name) AS INT) AS size, left(c_name, 8) AS head, regexp_replace(c_name, '[0-9]', '', 'g') AS letters, contains(c_name, '0') AS zero, len(string_split(c_mktsegment, 'I')) AS parts FROM customer")
def _(t):
    n = F.col("c_name")
    return t("customer").select("c_custkey", F.lower(n).alias("low"), F.length(n).alias("size"), F.substring(n, 1, 8).alias("head"), F.regexp_replace(n, "[0-9]", "").alias("letters"), n.contains("0").alias("zero"), F.size(F.split("c_mktsegment", "I")).cast("long").alias("parts"))


@query("fn_date_parts", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, isodow(o_orderdate) - 1 AS wd, dayofyear(o_orderdate) AS doy, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ms, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS qs FROM orders")
def _(t):
    d = F.col("o_orderdate")
    trunc = lambda p: F.date_trunc(p, d).cast("timestamp_ntz")
    return t("orders").select("o_orderkey", *[f(d).cast("long").alias(n) for n, f in (("y", F.year), ("m", F.month), ("d", F.dayofmonth), ("wd", F.weekday), ("doy", F.dayofyear))], trunc("month").alias("ms"), trunc("quarter").alias("qs"))


@query("fn_cyclical", "SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS s, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS c FROM orders")
def _(t):
    s, c = C.cyclical(F.month("o_orderdate"), 12)
    return rounded(t("orders").select("o_orderkey", s.alias("s"), c.alias("c")))


@query("fn_math", "SELECT event_id, round(ln(1 + value), 6) AS log1p, round(sqrt(value), 6) AS root, abs(value - 50) AS gap, value % 1 = 0 AS whole, least(value, 10) AS low, greatest(value, 10) AS high FROM events")
def _(t):
    v = F.col("value")
    return rounded(t("events").select("event_id", F.log1p(v).alias("log1p"), F.sqrt(v).alias("root"), F.abs(v - 50).alias("gap"), (v % 1 == 0).alias("whole"), F.least(v, F.lit(10.0)).alias("low"), F.greatest(v, F.lit(10.0)).alias("high")))


@query("fn_conditional", "SELECT l_orderkey, l_linenumber, l_returnflag IN ('A', 'R') AS returned, coalesce(nullif(l_discount, 0), -1) AS discount, CASE WHEN l_tax > 0.04 THEN 'high' END AS band, TRY_CAST(l_returnflag AS DOUBLE) AS number FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").isin("A", "R").alias("returned"), F.coalesce(F.nullif(F.col("l_discount"), F.lit(0.0)), F.lit(-1.0)).alias("discount"), F.when(F.col("l_tax") > 0.04, "high").alias("band"), F.col("l_returnflag").try_cast("double").alias("number"))


@query("fn_map_counts", "SELECT o_orderstatus, CAST(to_json(map_from_entries(list({'k': o_orderpriority, 'v': n} ORDER BY o_orderpriority))) AS VARCHAR) AS counts FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def _(t):
    counts = t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return counts.groupBy("o_orderstatus").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderpriority", "n"))))).alias("counts"))  # a few priorities per status


@query("fn_sha256", "SELECT page_id, sha256(url) AS digest FROM pages")
def _(t):
    return t("pages").select("page_id", F.sha2("url", 256).alias("digest"))


@query("skew_label", "SELECT x, CASE WHEN abs(x) < 0.5 THEN 'approximately symmetric' WHEN abs(x) < 1 THEN 'moderately ' || CASE WHEN x > 0 THEN 'right' ELSE 'left' END || '-skewed' ELSE 'strongly ' || CASE WHEN x > 0 THEN 'right' ELSE 'left' END || '-skewed' END AS label FROM (SELECT DISTINCT (l_quantity - 25) / 10 AS x FROM lineitem)")
def _(t):
    return t("lineitem").select(((F.col("l_quantity") - 25) / 10).alias("x")).distinct().select("x", C.skew_class(F.col("x")).alias("label"))
