"""Named queries over the test tables, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import quality, stats
from sparkloom.plans import model_queries, profile_queries, series_queries, source_queries, stat_queries  # noqa: F401  they register their queries
from sparkloom.plans.registry import ORACLES, QUERIES, rounded

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per measure of lineitem: summary, missing share and outliers."""
    measures = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    missing = quality.missing_columns(measures).select("column", F.col("level").alias("missing_level"))
    return rounded(stats.numeric_summary(measures).join(missing, "column").join(stats.outliers(measures), "column"))
