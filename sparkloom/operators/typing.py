"""Semantic types of raw string columns, and coercion to them."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.config import AMBIGUOUS_FORMATS, DATETIME_FORMATS, DEFAULT, FALSE_WORDS, TRUE_WORDS, Config
from sparkloom.functions import columns as C
from sparkloom.operators.common import value_counts
from sparkloom.operators.stats import distinct_counts

#: What stands for the letters of a datetime pattern that are no numbers.
_SHAPES = {"MMM": r"[A-Za-z]+[.]?", "'T'": "T", "T": "T"}


@dataclass
class ColumnMeta:
    """What is known about a column; stored once and replayed on later reads."""

    name: str
    semantic_type: str = "categorical"
    storage_type: str = "string"
    identifier_level: str | None = None
    n_unique: int = 0
    unique_ratio: float = 0.0
    n_non_null: int = 0
    formatted_numeric: bool = False
    datetime_format: str | None = None
    is_integer: bool = False
    cardinality_class: str | None = None
    high_cardinality: bool = False
    evidence: list[str] = field(default_factory=list)
    constant: bool = False
    bool_labels: dict[str, str] | None = None

    def as_dict(self) -> dict:
        return asdict(self)


def name_looks_like_id(name: str) -> bool:
    """Has id, uuid or guid as a word of its own (camel case counts), or the word identifier anywhere."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower()
    return "identifier" in words or bool({"id", "uuid", "guid"} & set(re.findall(r"[a-z0-9]+", words)))


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of every cell: the expressions over it are written, and compiled, once for all columns."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])))


def column_evidence(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per string column with the counts and shares that types are decided on, from one read; partial sums are one row per column and task."""
    names = columns or [c for c, t in df.dtypes if t == "string"]
    v = F.col("value")
    cells = _cells(df, names).withColumns({"bare": C.strip(v)})
    cells = cells.withColumns({"key": F.lower("bare"), "plain_": C.parse_plain(v), "shaped_": F.when(F.col("bare").rlike(C.FORMATTED_NUMBER), C.parse_formatted(v)), "tokens": F.size(F.filter(F.split(v, r"(?U)\s+"), lambda t: t != ""))})
    share = lambda cond: F.avg(cond.cast("double"))
    present, key, number = v.isNotNull(), F.col("key"), F.coalesce("plain_", "shaped_")
    used = lambda words: F.bit_count(F.coalesce(F.bit_or(F.coalesce(*[F.when(key == w, F.lit(1 << k)) for k, w in enumerate(words)], F.lit(0))), F.lit(0)))
    return cells.groupBy("column").agg(
        F.count("value").alias("n"), share(F.when(present, F.col("plain_").isNotNull())).alias("plain"), share(F.when(present, F.col("shaped_").isNotNull())).alias("shaped"), share(v.rlike(C.LEADING_ZERO)).alias("zeros"),
        F.min(F.col("plain_") % 1 == 0).alias("integral_plain"), F.min(F.col("shaped_") % 1 == 0).alias("integral_shaped"), F.min(number).alias("low"), F.max(number).alias("high"),
        F.min(key.isin(*TRUE_WORDS, *FALSE_WORDS)).alias("bools"), F.min(F.when(key.isin(*TRUE_WORDS), F.col("bare"))).alias("first_true"), F.min(F.when(key.isin(*FALSE_WORDS), F.col("bare"))).alias("first_false"),
        used(TRUE_WORDS).alias("trues"), used(FALSE_WORDS).alias("falses"), share(v.rlike(r"\d")).alias("digits"), F.avg(F.length(v).cast("double")).alias("avg_len"),
        F.percentile(F.length(v).cast("double"), F.lit(0.5)).alias("med_len"), F.percentile(F.when(present, F.col("tokens")).cast("double"), F.lit(0.5)).alias("med_tokens"),
    )


def datetime_format(df: DataFrame, columns: list[str]) -> dict[str, tuple[str, bool]]:
    """Format name (or 'mixed') and whether day and month may be swapped, for columns that parse as datetimes in 95 % of values."""
    if not columns:
        return {}
    v = F.col("value")
    shaped = lambda p: v.rlike("^" + re.sub(r"[A-Za-z]+|'T'", lambda m: _SHAPES.get(m[0], r"\d+"), re.sub(r"([.\-/])", r"[\1]", p)) + "$")  # noqa: E731  what cannot match is not parsed
    ways = {f"f{k}": F.when(shaped(p), F.try_to_timestamp(v, F.lit(p))) for k, (_, p) in enumerate(DATETIME_FORMATS)}
    counts = value_counts(df, columns)  # each distinct value is parsed once
    total = F.sum("n").cast("double")
    rows = counts.groupBy("column").agg(*[(F.sum(F.when(w.isNotNull(), F.col("n"))) / total).alias(k) for k, w in ways.items()])
    rows = {r["column"]: r for r in rows.collect()}
    rest = [c for c, r in rows.items() if not any((r[k] or 0) >= 0.95 for k in ways)]
    free = {r["column"]: r["free"] for r in counts.where(F.col("column").isin(rest)).groupBy("column").agg((F.sum(F.when(C.parse_datetime(v, None).isNotNull(), F.col("n"))) / total).alias("free")).collect()} if rest else {}
    out = {}
    for r in rows.values():
        passing = [name for k, (name, _) in enumerate(DATETIME_FORMATS) if (r[f"f{k}"] or 0) >= 0.95]
        if passing:
            out[r["column"]] = (passing[0], any(set(pair) <= set(passing) for pair in AMBIGUOUS_FORMATS))
        elif (free.get(r["column"]) or 0) >= 0.95:
            out[r["column"]] = ("mixed", False)
    return out


def _identify(m: ColumnMeta, by_name: bool, sequential: bool, cfg: Config) -> ColumnMeta:
    share = f"{m.unique_ratio:.1%} of its values are unique"
    level = why = None
    if by_name and m.unique_ratio >= cfg.id_strong_unique:
        level, why = "strong", f"named like an identifier; {share}"
    elif sequential and not by_name:
        level, why = "possible", "consecutive integers without repeats"
    elif by_name and m.unique_ratio >= cfg.id_name_possible_unique:
        level, why = "possible", f"named like an identifier; {share}"
    elif not by_name and m.storage_type == "string" and m.n_non_null >= cfg.id_min_rows and m.unique_ratio >= cfg.id_possible_unique:
        level, why = "possible", share
    if level:
        m.semantic_type, m.identifier_level = "identifier", level
        m.evidence.append(why)
    return m


def infer_types(df: DataFrame, cfg: Config = DEFAULT) -> list[ColumnMeta]:
    """Metadata of each string column. Two reads of the table, and one more of the columns that may hold datetimes; decisions are made on one row per column."""
    names = [c for c, t in df.dtypes if t == "string"]
    unique = {r["column"]: r["unique"] for r in distinct_counts(df, names).collect()}
    seen = {r["column"]: r for r in column_evidence(df, names).collect()}
    dates = datetime_format(df, [c for c in names if seen[c]["n"] and seen[c]["digits"] >= 0.95 and seen[c]["med_len"] >= 6 and seen[c]["plain"] < 0.95 and (seen[c]["shaped"] < 0.95 or seen[c]["zeros"] > 0.05)])
    out = []
    for c in names:
        e, n = seen[c], seen[c]["n"]
        m = ColumnMeta(c, n_unique=unique[c], unique_ratio=unique[c] / n if n else 0.0, n_non_null=n, constant=unique[c] <= 1)
        by_name = name_looks_like_id(c)
        out.append(m)
        if not n:
            m.semantic_type = "empty"
            m.evidence.append("no values")
        elif e["bools"] and e["trues"] == 1 and e["falses"] == 1:
            m.semantic_type, m.storage_type = "boolean", "bool"
            m.bool_labels = {"true": e["first_true"], "false": e["first_false"]}
            m.evidence.append("one word for true and one for false")
        elif e["zeros"] <= 0.05 and (e["plain"] >= 0.95 or e["shaped"] >= 0.95):
            m.semantic_type, m.storage_type, m.formatted_numeric = "numerical", "numeric", e["plain"] < 0.95
            m.is_integer = bool(e["integral_shaped"] if m.formatted_numeric else e["integral_plain"])
            if m.formatted_numeric:
                m.evidence.append("numbers with currency, percent or thousands signs")
            if m.is_integer or by_name:
                sequential = m.is_integer and n >= cfg.id_min_rows and unique[c] == n and e["high"] - e["low"] + 1 == n
                _identify(m, by_name, sequential, cfg)
        elif c in dates:
            m.semantic_type, m.storage_type = "datetime", "datetime"
            m.datetime_format, ambiguous = dates[c]
            m.evidence.append(f"datetimes of format {m.datetime_format}")
            if ambiguous:
                m.evidence.append("day and month could be swapped; the day was read first")
        elif (e["avg_len"] >= cfg.text_min_avg_len or e["med_tokens"] >= cfg.text_min_median_tokens) and m.unique_ratio >= cfg.text_min_unique_ratio:
            m.semantic_type = "text"
            m.evidence.append(f"{e['avg_len']:.0f} characters on average, {e['med_tokens']:.0f} words in the median")
        else:
            _identify(m, by_name, False, cfg)
            if m.semantic_type == "categorical":
                m.cardinality_class = "low" if m.n_unique <= cfg.card_low else "medium" if m.n_unique <= cfg.card_high else "high"
                m.high_cardinality = m.cardinality_class == "high"
                if m.high_cardinality:
                    m.evidence.append(f"{m.n_unique} different values")
    return out


def coerce_types(df: DataFrame, meta: list[ColumnMeta]) -> DataFrame:
    """Typed columns by stored metadata; what does not parse becomes null. One projection."""
    typed = []
    for m in meta:
        if m.name not in df.columns:
            continue
        c = F.col(f"`{m.name}`")
        if m.storage_type == "numeric":
            c = C.parse_formatted(c) if m.formatted_numeric else C.parse_plain(c)
        elif m.storage_type == "bool":
            c = C.parse_boolean(c)
        elif m.storage_type == "datetime":
            c = C.parse_datetime(c, m.datetime_format)
        typed.append(c.alias(m.name))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in {m.name for m in meta}], *typed)
