"""Positions of rows in an order, found without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts that a group's rows are dealt into by hash; their counts are what a window runs over.
PARTS = 1024


def group_positions(df: DataFrame, group: list[str], spread: Column, order: list[Column], into: str = "position") -> DataFrame:
    """Adds each row's position (from 0) in its group.

    Rows of a group are dealt into PARTS parts by the hash of `spread`; a row's position
    is the number of rows in earlier parts plus its place in its part, by `order`. So the
    largest window holds about a PARTS-th of a group, and counts are at most PARTS rows a
    group. Group columns must not be null. Rows that tie in spread and order may change
    places between runs.
    """
    own = df.withColumn("_part", F.pmod(spread, F.lit(PARTS)).cast("int"))
    sizes = own.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1
    ranked = own.withColumn("_place", place).join(starts, [*group, "_part"])
    return ranked.withColumn(into, F.col("_start") + F.col("_place")).drop("_part", "_start", "_place")
