"""Packing into length buckets whose bounds minimise padding.

The global histogram of sequence lengths, one row for each length up to the longest
allowed, goes to the driver, where dynamic programming chooses the bucket bounds.
Inside each bucket sequences are numbered without gathering it anywhere, and every
run of as many as the token budget holds is a batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.ranking import group_positions
from sparkloom.llm.session import written


def optimal_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets such that padding each length to its bucket's bound costs least.

    Bounds are lengths that occur, the last one the largest. Of equal costs the one with
    the smaller bounds wins. An empty histogram has no bounds.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), dtype=np.int64)
    n = len(lengths)
    if not n:
        return []
    counts = np.concatenate([[0], np.cumsum([histogram[int(k)] for k in lengths])]).astype(object if sum(histogram.values()) * int(lengths[-1]) >= 2**62 else np.int64)
    weights = np.concatenate([[0], np.cumsum([histogram[int(k)] * int(k) for k in lengths])]).astype(counts.dtype)
    buckets = min(buckets, n)
    cost = [counts[j] * lengths[j - 1] - weights[j] if j else 0 for j in range(n + 1)]  # one bucket for the first j lengths
    choice = np.zeros((buckets + 1, n + 1), dtype=np.int64)
    for k in range(2, buckets + 1):
        best = list(cost)
        before = np.array(cost, dtype=counts.dtype)
        for j in range(k, n + 1):
            at = np.arange(k - 1, j)
            total = before[at] + (counts[j] - counts[at]) * lengths[j - 1] - (weights[j] - weights[at])
            low = int(np.argmin(total))
            best[j], choice[k, j] = total[low], at[low]
        cost = best
    out, j = [], n
    for k in range(buckets, 0, -1):
        out.append(int(lengths[j - 1]))
        j = int(choice[k, j])
    return out[::-1]


def word_count(text: Column) -> Column:
    """Words: runs of other than space and \\t-\\r. Null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class LengthBuckets:
    """Batches of whole documents by token budget, in padding-minimal length buckets.

    A document's length is `length` (its words, unless told otherwise); one longer than
    `max_tokens` becomes consecutive pieces of max_tokens, the last one shorter, so
    nothing is cut off. A batch pads its sequences to the bucket's bound and holds at
    most `token_budget` padded tokens. A document without tokens, or with null text,
    has one row without a bucket. Repeated rows are separate sequences; which of equal
    ones comes first in a batch is settled by doc_id and piece. Empty tables give no
    rows; further columns are ignored.
    """

    def __init__(self, buckets: int = 16, max_tokens: int = 4096, token_budget: int = 65536):
        if buckets < 1 or max_tokens < 1 or token_budget < max_tokens:
            raise ValueError("the token budget must hold the longest sequence")
        self.buckets, self.max_tokens, self.token_budget = buckets, max_tokens, token_budget

    def pieces(self, docs: DataFrame, length: Column | None = None) -> DataFrame:
        """(doc_id, piece, first_token, n_tokens). Lengths are counted once and written."""
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (word_count(F.col("text")) if length is None else length.cast("long")).alias("total"))
        own = written(own)
        most = F.lit(self.max_tokens).cast("long")
        last = F.greatest(F.ceil(F.col("total") / most) - 1, F.lit(0)).cast("long")
        cut = own.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
        return cut.select("doc_id", "piece", (F.col("piece") * most).alias("first_token"), F.least(most, F.col("total") - F.col("piece") * most).alias("n_tokens"))

    def bounds(self, pieces: DataFrame) -> list[int]:
        """Bucket bounds for these pieces; the histogram has at most max_tokens rows."""
        return optimal_bounds({r["n_tokens"]: r["n"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}, self.buckets)

    def run(self, docs: DataFrame, length: Column | None = None) -> DataFrame:
        """(doc_id, piece, first_token, n_tokens, bucket, bucket_tokens, batch, slot): batch counts within its bucket, slot within the batch."""
        pieces = self.pieces(docs, length)
        bounds = self.bounds(pieces)
        if not bounds:
            none = F.lit(None)
            return pieces.select("*", none.cast("int").alias("bucket"), none.cast("long").alias("bucket_tokens"), none.cast("long").alias("batch"), none.cast("int").alias("slot"))
        all_bounds = F.array(*[F.lit(b).cast("long") for b in bounds])
        bucket = F.when(F.col("n_tokens") > 0, F.size(F.filter(all_bounds, lambda b: b < F.col("n_tokens")))).otherwise(-1)
        placed = group_positions(pieces.withColumn("bucket", bucket), ["bucket"], F.xxhash64("doc_id", "piece"), [F.asc_nulls_last("doc_id"), F.asc("piece"), F.asc("n_tokens")])
        placed = placed.withColumn("bucket_tokens", F.element_at(all_bounds, F.greatest(F.col("bucket"), F.lit(0)) + 1))
        rows = F.floor(F.lit(self.token_budget).cast("long") / F.col("bucket_tokens")).cast("long")
        has = F.col("n_tokens") > 0
        return placed.select(
            "doc_id", "piece", "first_token", "n_tokens",
            F.when(has, F.col("bucket")).alias("bucket"), F.when(has, F.col("bucket_tokens")).alias("bucket_tokens"),
            F.when(has, F.floor(F.col("position") / rows)).cast("long").alias("batch"), F.when(has, F.pmod(F.col("position"), rows)).cast("int").alias("slot"),
        )
