"""Ranked lexical search: impact vectors in order of length, pruned by Cauchy-Schwarz and by bounds on coordinates.

A document is a vector of integer impacts over the terms of the queries, a query a set
of terms, and a score their inner product. Vectors are dealt by ranges of their length
and lie longest first, so a batch of them is a bucket of similar lengths:

1. A bucket's vectors score at most length times the query's length. Those that stay
   under the query's k-th best score so far are a tail of the bucket, or all of it.
2. In the rest, some focus coordinates (the query's heaviest terms) are added up. What
   the others can add is bounded by the length that is left, and by the largest impact
   of each of them in the bucket.
3. Survivors are scored over all terms in integers.

The longest vectors are searched first, by themselves: the k-th best scores among them
are what the others must reach, and the shortest length that can reach one of them goes
into the scan of the table as a filter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.kernels import ALNUM_WORD, ASCII_LOWER, U64, steps, total
from sparkloom.llm.session import written

#: Terms (with repeats between queries) and best rows that one round's queries have at most; more queries are searched in several rounds.
ROUND_TERMS, ROUND_BEST = 1 << 20, 1 << 17
#: Lengths are counted by steps of a quarter of a power of two.
LEVELS = 4
#: Coordinates of a query that are added up before the bound.
FOCUS = 6
#: Lengths and bounds are doubles; this share more keeps them above what they bound.
ABOVE = 1 + 1e-9


def _words(column) -> tuple:
    """The column's words as (first row, words) in slices."""
    return steps(column, ALNUM_WORD, ASCII_LOWER)


def _distinct(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, name) in order of group and name, and how often each stands."""
    order = np.lexsort((high, low, group))
    g, a, b = group[order], low[order], high[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return g[at], a[at], b[at], np.diff(np.append(at, len(g)))


def _term_sets(batches):
    """Each item's distinct terms as two lanes of names, and the name of the set."""
    for batch in batches:
        for row, words in _words(batch.column("text")):
            docs = len(words.counts)
            group, low, high, _ = _distinct(words.doc, *words.name)
            first = np.searchsorted(group, np.arange(docs + 1))
            named = total((low, high), first)
            lanes = [[lane[a:b].tobytes() for a, b in zip(first, first[1:])] for lane in (low, high)]
            columns = [batch.column("item_id").slice(row, docs), *[pa.array(x.view(np.int64)) for x in named], *[pa.array(x, pa.binary()) for x in lanes]]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "set_low", "set_high", "lows", "highs"])


def _lists(values: np.ndarray, first: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def _counts(shared):
    """Terms of each document (all of them, with repeats) and the occurrences of those that some query has."""

    def run(batches):
        lows, highs = shared.value
        for batch in batches:
            for row, words in _words(batch.column("text")):
                docs = len(words.counts)
                low, high = words.name
                at = np.minimum(np.searchsorted(lows, low), max(len(lows) - 1, 0))
                known = np.flatnonzero((lows[at] == low) & (highs[at] == high)) if len(lows) else np.zeros(0, np.int64)
                pair, tf = np.unique(words.doc[known] * max(len(lows), 1) + at[known], return_counts=True)
                doc, term = np.divmod(pair, max(len(lows), 1))
                first = np.searchsorted(doc, np.arange(docs + 1))
                columns = [batch.column("doc_id").slice(row, docs), pa.array(words.counts, pa.int64()), _lists(term, first, pa.int32()), _lists(tf, first, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    return run


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column without nulls, and where each list begins."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _impacts(shared, n_docs: int, n_terms: int):
    """The vectors: impacts above 0, and their length."""

    def run(batches):
        weight = shared.value
        for batch in batches:
            term, first = _flat(batch.column("terms"))
            tf, _ = _flat(batch.column("tfs"))
            m = 100 - 90 + (90 * batch.column("n").to_numpy() * n_docs) // n_terms
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            keep = np.flatnonzero(impact > 0)
            term, impact, row = term[keep], impact[keep], row[keep]
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            norm = np.sqrt(np.bincount(row, np.square(impact, dtype=np.float64), batch.num_rows)) * ABOVE
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(norm), _lists(term, first, pa.int32()), _lists(impact, first, pa.int64())], names=["doc_id", "norm", "terms", "impacts"])

    return run


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k of rows with the highest scores, equal ones by smaller ids."""
    if len(rows) > 4 * k:  # what is under the k-th score goes before the sort
        rows = rows[scores[rows] >= np.partition(scores[rows], len(rows) - k)[len(rows) - k]]
    return rows[np.lexsort((ids[rows], -scores[rows]))][:k]


class Bucket:
    """Vectors of one batch, longest first, by coordinate."""

    def __init__(self, norm: np.ndarray, term: np.ndarray, impact: np.ndarray, first: np.ndarray):
        row = np.repeat(np.arange(len(norm)), np.diff(first))
        order = np.argsort(term, kind="stable")
        self.norm, self.row, self.impact = norm, row[order], impact[order]
        self.term, self.start = np.unique(term[order], return_index=True)
        self.start = np.append(self.start, len(order))
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if len(order) else np.zeros(0, np.int64)

    def search(self, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows with scores of `least` or more (at least 1), and all scores known. query: terms, heaviest first."""
        reach = int(np.searchsorted(-self.norm, -(least / (math.sqrt(len(query)) * ABOVE)), "right"))  # Cauchy-Schwarz: a prefix
        if not reach or not len(self.term):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.term, query), len(self.term) - 1)
        at = at[self.term[at] == query]
        focus, rest = at[:FOCUS], at[FOCUS:]
        score, square = np.zeros(reach, np.int64), np.zeros(reach)
        for t in focus:
            rows, impact = self.row[self.start[t] : self.start[t + 1]], self.impact[self.start[t] : self.start[t + 1]]
            end = np.searchsorted(rows, reach)
            score[rows[:end]] += impact[:end]
            square[rows[:end]] += np.square(impact[:end], dtype=np.float64)
        left = np.sqrt(np.maximum(np.square(self.norm[:reach]) - square, 0)) * math.sqrt(len(rest)) * ABOVE + 1 if len(rest) else 0
        alive = score + np.minimum(left, float(self.most[rest].sum())) >= max(least, 1)
        for t in rest if alive.any() else []:
            rows, impact = self.row[self.start[t] : self.start[t + 1]], self.impact[self.start[t] : self.start[t + 1]]
            end = np.searchsorted(rows, reach)
            own = alive[rows[:end]]
            score[rows[:end][own]] += impact[:end][own]
        return np.flatnonzero(alive & (score >= max(least, 1))), score


def _search(shared, k: int):
    """(query, doc_id, score): the k best of each query in a task, of those that reach what is asked for."""

    def run(batches):
        queries, least = shared.value
        least = least.copy()
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            norm = batch.column("norm").to_numpy()
            term, first = _flat(batch.column("terms"))
            bucket = Bucket(norm, term, _flat(batch.column("impacts"))[0], first)
            ids = batch.column("doc_id")
            known = ~ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            for q, query in enumerate(queries):
                rows, scores = bucket.search(query, int(least[q]))
                if not len(rows):
                    continue
                rows = best(rows, scores, ids, k)
                own = np.stack([scores[rows], ids[rows], known[rows]])
                if q in found:
                    own = np.concatenate([found[q], own], axis=1)
                    own = own[:, np.lexsort((own[1], -own[0]))[:k]]
                found[q] = own
                if own.shape[1] == k:
                    least[q] = max(least[q], own[0, -1])
        for q, own in found.items():
            ids = pa.array(own[1], pa.int64(), mask=own[2] == 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(own.shape[1], q), pa.int32()), ids, pa.array(own[0], pa.int64())], names=["query", "doc_id", "score"])

    return run


class RankedSearch:
    """The k highest-scoring documents of each item.

    Terms are runs of letters, digits and bytes above 0x7F; only A-Z are lower-cased. The
    score is a sum of integer impacts over the item's distinct terms, see `weight` and
    `_impacts`. Null and empty texts have no terms: such documents count for nothing and
    match nothing, such items give no rows. Each row of the documents ranks on its own,
    also where a doc_id is repeated; a null doc_id comes after others of its score. Each
    row of the items gets its result; equal sets of terms are searched once. Empty tables
    give no rows. Further columns are ignored.

    Terms are told apart by 128-bit names. Queries go to the executors in rounds of about
    ROUND_TERMS terms and ROUND_BEST results; documents are read once a round.
    """

    def __init__(self, k: int = 10, first_share: int = 16):
        """k: results an item; first_share: one of so many vectors, the longest, is searched first."""
        if k < 1 or first_share < 1:
            raise ValueError("k and first_share are at least 1")
        self.k, self.first_share = k, first_share

    @staticmethod
    def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
        """floor(1000 ln((2 N + 2) / (2 df + 1))), 0 or more as df is at most N."""
        return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)

    def _rounds(self, queries: DataFrame) -> list[DataFrame]:
        size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("lows") / 8), F.lit(0)).alias("terms")).first()
        rounds = max(1, math.ceil(size["terms"] / ROUND_TERMS), math.ceil(size["n"] * self.k / ROUND_BEST))
        return [queries.where(F.pmod("set_low", F.lit(rounds)) == r) for r in range(rounds)] if size["n"] else []

    def vectors(self, docs: DataFrame, lows: np.ndarray, highs: np.ndarray) -> tuple[DataFrame, np.ndarray] | None:
        """Impact vectors in order of length, and the terms' weights."""
        sc = docs.sparkSession.sparkContext
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        counted = written(own.mapInArrow(_counts(sc.broadcast((lows, highs))), "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0"))
        whole = counted.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
        if not whole["n"]:
            return None
        df = np.zeros(len(lows), np.int64)
        for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the round at most
            df[r["term"]] = r["count"]
        weight = self.weight(whole["n"], df)
        made = counted.where(F.size("terms") > 0).mapInArrow(_impacts(sc.broadcast(weight), whole["n"], whole["terms"]), "doc_id long, norm double, terms array<int>, impacts array<long>")
        order = F.col("norm").desc()
        return written(made.where("norm > 0").repartitionByRange(order, F.xxhash64("doc_id", "terms")).sortWithinPartitions(order)), weight

    def _first_cut(self, vectors: DataFrame) -> float:
        """A length that about one of first_share vectors has or exceeds."""
        level = F.floor(F.log2("norm") * LEVELS)
        counts = sorted(((r["level"], r["count"]) for r in vectors.groupBy(level.alias("level")).count().collect()), reverse=True)  # some hundred levels at most
        wanted, seen = sum(n for _, n in counts) / self.first_share, 0
        for own, n in counts:
            seen += n
            if seen >= wanted:
                return 2.0 ** (own / LEVELS)
        return 0.0

    def _best(self, vectors: DataFrame, queries: list[np.ndarray], least: np.ndarray) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((queries, least))
        return vectors.mapInArrow(_search(shared, self.k), "query int, doc_id long, score long")

    def _round(self, docs: DataFrame, rows: list) -> DataFrame | None:
        """(set_low, set_high, rank, doc_id, score) of one round's queries."""
        spark = docs.sparkSession
        lanes = [[np.frombuffer(r[c], U64) for r in rows] for c in ("lows", "highs")]
        _, lows, highs, _ = _distinct(np.zeros(sum(map(len, lanes[0])), np.int8), *map(np.concatenate, lanes))
        made = self.vectors(docs, lows, highs)
        if made is None:
            return None
        vectors, weight = made
        queries = []
        for own in lanes[0]:
            terms = np.searchsorted(lows, own)
            queries.append(terms[np.argsort(-weight[terms], kind="stable")])
        cut, least = self._first_cut(vectors), np.ones(len(rows), np.int64)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)
        start = top(self._best(vectors.where(F.col("norm") >= cut), queries, least)).select("query", "doc_id", "score", "rank").collect()  # k rows a query at most
        for r in start:
            if r["rank"] == self.k:
                least[r["query"]] = max(1, r["score"])
        floor = float(min(x / (math.sqrt(len(q)) * ABOVE**2) for x, q in zip(least, queries)))
        rest = self._best(vectors.where((F.col("norm") < cut) & (F.col("norm") >= floor)), queries, least)
        both = rest.unionByName(spark.createDataFrame([(r["query"], r["doc_id"], r["score"]) for r in start], "query int, doc_id long, score long"))
        named = spark.createDataFrame([(q, r["set_low"], r["set_high"]) for q, r in enumerate(rows)], "query int, set_low long, set_high long")
        return top(both).join(named, "query").select("set_low", "set_high", "rank", "doc_id", "score")

    def run(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        """(item_id, rank, doc_id, score), rank from 1."""
        sets = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_term_sets, f"item_id {items.schema['item_id'].dataType.simpleString()}, set_low long, set_high long, lows binary, highs binary")
        sets = sets.where(F.length("lows") > 0)
        queries = sets.groupBy("set_low", "set_high").agg(F.min("lows").alias("lows"), F.min("highs").alias("highs"))
        found = [self._round(docs, part.collect()) for part in self._rounds(queries)]  # a round's queries
        empty = docs.sparkSession.createDataFrame([], "set_low long, set_high long, rank int, doc_id long, score long")
        for part in found:
            empty = empty if part is None else empty.unionByName(part)
        return sets.select("item_id", "set_low", "set_high").join(empty, ["set_low", "set_high"]).select("item_id", "rank", "doc_id", "score")
