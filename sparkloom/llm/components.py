"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.session import cut


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link to another node; component is the smallest node reachable.

    Each round points the neighbours of a node to the smallest of them, with
    group-by-min and joins only, so a hub's neighbours are never gathered in one
    task. Rounds grow with the logarithm of the longest chain. Links with a null
    end and links of a node to itself say nothing and are left out; no links give
    an empty frame.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    edges = cut(edges.distinct())
    before = _digest(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), "m")
        large = edges.join(low, edges["v"] == low["node"], "left").select("u", F.coalesce("m", "v").alias("v"))  # larger neighbours of a node go to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        edges = cut(small.where("u > v").distinct())
        now = _digest(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
