"""Data-quality findings: placeholders, missing values, duplicates, constants, formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.config import DEFAULT, Config
from sparkloom.functions import columns as C
from sparkloom.operators.common import per_column, present, top_n, value_counts

ADVICE = {
    "none": ("Nothing missing", None),
    "low": ("Few values missing", "Impute rather than drop rows."),
    "moderate": ("Some values missing", "Impute, and consider an indicator for what was missing."),
    "high": ("Many values missing", "Find out why; imputed values will be weak."),
    "very_high": ("Most values missing", "Consider dropping the column unless its gaps carry meaning."),
}


def normalize_placeholders(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """String columns with placeholder tokens and blanks turned to null; one projection."""
    names = columns or [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: C.without_placeholders(F.col(f"`{c}`")) for c in names})


def placeholder_report(df: DataFrame, columns: list[str] | None = None, top: int = 10) -> DataFrame:
    """(column, value, n, total, rank): the most frequent placeholder values of each column as they are shown."""
    names = columns or [c for c, t in df.dtypes if t == "string"]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("raw")) for c in names])
    found = df.select(F.inline(cells)).where(C.is_placeholder(F.col("raw")))
    shown = F.when(C.strip(F.col("raw")) == "", "<blank>").otherwise(C.strip(F.col("raw")))
    counts = found.groupBy("column", shown.alias("value")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return top_n(counts, top, [F.desc("n"), F.asc("value")], ["column"]).join(F.broadcast(totals), "column").select("column", "value", "n", "total", "rank")


def missing_columns(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(column, missing, non_null, missing_pct, level) for each column, from one aggregate. NaN and infinities are missing."""
    flags = df.select(*[F.when(present(df, c), F.lit(1)).alias(c) for c in df.columns])
    out = per_column(flags, df.columns, {"missing": lambda c: F.count_if(c.isNull()), "non_null": lambda c: F.count(c)})
    total = F.col("missing") + F.col("non_null")
    pct = F.when(total > 0, F.col("missing") / total.cast("double") * 100).otherwise(F.lit(0.0))
    return out.select("column", "missing", "non_null", F.round(pct, 3).alias("missing_pct"), C.missing_level(pct, cfg).alias("level"))


def missing_per_row(df: DataFrame, row_id: str) -> DataFrame:
    """(row_id, missing, total) of each row; no shuffle. NaN and infinities are missing."""
    names = [c for c in df.columns if c != row_id]
    count = sum(((~present(df, c)).cast("int") for c in names), F.lit(0))
    return df.select(F.col(row_id), count.cast("long").alias("missing"), F.lit(len(names)).cast("long").alias("total"))


def missing_rows(df: DataFrame, row_id: str, top: int = 20, cfg: Config = DEFAULT) -> DataFrame:
    """The rows with the largest share of missing values, where that reaches the flag."""
    rows = missing_per_row(df, row_id).where(F.col("missing") / F.greatest(F.col("total"), F.lit(1)) >= cfg.row_missing_flag)
    return rows.orderBy(F.desc("missing"), F.asc(row_id)).limit(top)


def missing_totals(df: DataFrame, row_id: str, cfg: Config = DEFAULT) -> DataFrame:
    """Cells missing, rows with any missing and rows over the flag."""
    rows = missing_per_row(df, row_id)
    share = F.col("missing") / F.greatest(F.col("total"), F.lit(1))
    return rows.agg(
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_cells"),
        F.round(F.coalesce(F.sum("missing") / F.sum("total").cast("double") * 100, F.lit(0.0)), 3).alias("missing_cell_pct"),
        F.count_if(F.col("missing") > 0).alias("rows_with_any_missing"), F.count_if(share >= cfg.row_missing_flag).alias("flagged_rows"),
    )


def duplicate_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows (null equals null), and how many rows there are."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in (columns or df.columns)]).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def duplicate_examples(df: DataFrame, row_id: str, columns: list[str] | None = None, top: int = 10) -> DataFrame:
    """row_ids of the earliest rows that repeat an earlier one.

    First occurrences come from a partial aggregate and are joined back, so a row that
    is repeated everywhere is never sorted in one task.
    """
    names = columns or [c for c in df.columns if c != row_id]
    groups = df.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.min(row_id).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    same = [df[c].eqNullSafe(groups[c]) for c in names]
    return df.join(groups, same).where(F.col(row_id) > F.col("_first")).select(df[row_id]).orderBy(row_id).limit(top)


def constants(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(column, kind, unique, top_value, top_share) of all-missing, constant and near-constant columns."""
    counts = value_counts(df, df.columns)
    tops = counts.groupBy("column").agg(F.count("*").alias("unique"), F.max(F.struct("n", "value")).alias("top"), F.sum("n").alias("total"))
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    share = F.col("top.n") / F.col("total").cast("double")
    kind = F.when(F.col("unique").isNull(), "all_missing").when(F.col("unique") == 1, "constant").when(share >= cfg.near_constant_share, "near_constant")
    found = names.join(tops, "column", "left").select("column", kind.alias("kind"), F.coalesce("unique", F.lit(0)).cast("long").alias("unique"), F.col("top.value").alias("top_value"), F.round(share, 4).alias("top_share"))
    return found.where("kind is not null")


def formatting(df: DataFrame, columns: list[str], texts: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> DataFrame:
    """(column, n, share of addresses, links, phone numbers, punctuation and formatted numbers) of string columns, over all values.

    `kind` is formatted_numeric for the columns in `numbers`; else the first of e-mail, link
    and phone that half of the values match (a phone also needs a separator somewhere), else
    punctuation from a share of 0.3, in free text (the columns in `texts`) or in categories.
    """
    share = lambda pattern: lambda c: F.avg(c.rlike(pattern).cast("double"))
    out = per_column(
        df, columns,
        {
            "n": lambda c: F.count(c), "email": share(C.EMAIL), "url": share(C.URL), "phone": share(C.PHONE), "separators": lambda c: F.max(c.rlike(C.PHONE_SEPARATOR)), "punctuation": share(r"(?U)[^\w\s]"),
            "formatted": lambda c: F.avg(C.strip(c).rlike(C.FORMATTED_NUMBER).cast("double")),
        },
    )
    kind = (
        F.when(F.col("column").isin(*numbers), "formatted_numeric").when(F.col("email") >= 0.5, "email_like").when(F.col("url") >= 0.5, "url_like").when((F.col("phone") >= 0.5) & F.col("separators"), "phone_like").when(F.col("punctuation") >= 0.3, F.when(F.col("column").isin(*texts), "punctuation_rich_text").otherwise("categorical_with_punctuation"))
    )
    return out.withColumn("kind", kind)
