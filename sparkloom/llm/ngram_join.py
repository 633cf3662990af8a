"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are distinct shingle sets (documents with the same set are one row),
columns are shingles, ordered from rare to common. Two sets whose Jaccard similarity
reaches t share a shingle among their first |A| - ceil(t |A|) + 1 ones, so only those
columns are multiplied to find out which cells of the product can be wanted; columns
with the same rows are multiplied once.

A wanted cell is then computed over all columns, which are cut into blocks by their
hash. A row knows how many of its shingles lie in each block, so the sum over blocks of
the smaller number bounds a cell before any set is sent, and pairs below the bound
that their sizes ask for go. Overlaps of the others are added up block by block; a pair
goes as soon as its sum so far and the bound of the blocks to come stay below.

Only cells between rows that are not yet known to be connected are looked at: first
each column's rows are held against its most central one; then, in columns that still
hold several components, rows outside the largest one against a few of it; at last those
still outside against all. A column of g near copies costs a few times g cells instead of
g*g, and no link between different components is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernels as K
from sparkloom.llm.components import connected_components
from sparkloom.llm.session import cut, written

#: Shingles are counted in this many hash buckets; their counts only order the columns.
COUNT_BUCKETS = 1 << 18
_SLICE = 1 << 14
#: Bits of the maps that tell which shingles may stand in several sets, and which documents' sets are wanted. A map is
#: as large for any input: where it fills up, more rows pass than need to, and no others are lost.
SHARED_BITS, WANTED_BITS = 27, 24
_MAP_PARTS = 256
#: Rows of a column's largest component that each one outside is held against before the full comparison.
REPRESENTATIVES = 8
#: Shingles of a set that lie in a column block, on average, in the bound on pairs; and the number of blocks that overlaps are added up in.
PER_BLOCK, ADDED_BLOCKS = 6, 8
#: Rows that share a set are dealt by document into so many parts, so that no task joins a whole group of copies.
PARTS = 256


def shingle_sets(column, n: int):
    """For each slice of a text column: first row, set sizes, where each set begins, and the shingles' names, sorted within a set."""
    for row, w in K.steps(column, K.BLANK_WORD, K.ASCII_LOWER):
        at, grams = w.windows(n)
        docs = w.doc[at]
        for size in range(1, n):  # a document of fewer words is one shingle
            few = np.flatnonzero(w.counts == size)
            if len(few):
                at, name = w.windows(size)
                grams = tuple(np.concatenate([g, x]) for g, x in zip(grams, K.pick(name, np.searchsorted(at, w.first[few]))))
                docs = np.concatenate([docs, few])
        for order in (np.lexsort((grams[0], docs)), np.lexsort((grams[1], grams[0], docs))):
            low, high, own = grams[0][order], grams[1][order], docs[order]
            again = (low[1:] == low[:-1]) & (own[1:] == own[:-1])
            if not (again & (high[1:] != high[:-1])).any():
                break  # names that agree in the first lane agree in both
        keep = np.ones(len(own), bool)
        keep[1:] = ~again | (high[1:] != high[:-1])
        low, high, own = low[keep], high[keep], own[keep]
        first = np.searchsorted(own, np.arange(len(w.counts) + 1))
        yield row, np.diff(first), first, (low, high)


def _required(size_a, size_b, num: int, den: int):
    """The least overlap with which sets of these sizes link."""
    return -((-(size_a + size_b) * num) // (den + num))


def _ceil_share(size, num: int, den: int):
    return -((-size * num) // den)


def _columns(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(8)).astype(np.int64) % COUNT_BUCKETS


def _sign(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        total = np.zeros(COUNT_BUCKETS, dtype=np.int64)
        for batch in batches:
            sizes, lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for _, size, first, grams in shingle_sets(batch.column("text"), n):
                total += np.bincount(_columns(grams[0]), minlength=COUNT_BUCKETS)
                low, high = K.total(grams, first)
                sizes.append(size), lows.append(low), highs.append(high)
            size = np.concatenate(sizes).astype(np.int64)
            names = [pa.array(np.concatenate(x).view(np.int64), mask=size == 0) for x in (lows, highs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size), *names, pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())], schema=schema)
        if total.any():
            parts = total.reshape(-1, _SLICE)
            none = [pa.nulls(len(parts), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], schema=schema)

    return run


def _sum_slices(table):
    blobs = table.column("counts").to_pylist()
    total = np.sum([np.frombuffer(b, np.int64) for b in blobs], axis=0)
    return pa.table({"slice": table.column("slice").slice(0, 1).cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def n_blocks(size: np.ndarray) -> np.ndarray:
    """Column blocks in which a set of this size counts its shingles: a power of two."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(size / PER_BLOCK, 16))).astype(np.int64))


def _lists(values: np.ndarray, sizes: np.ndarray):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _blobs(values: np.ndarray, sizes: np.ndarray):
    """A binary column of the bytes of consecutive pieces of values."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _rows(n: int, num: int, den: int, counts: Broadcast):
    """Rows of the matrix: a set's name and size, the columns that have to be multiplied, from rare to common, and how many of its shingles lie in each column block."""
    schema = pa.schema([("doc_id", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("size", pa.int64()), ("prefix", pa.list_(pa.int64())), ("blocks", pa.binary())])

    def run(batches):
        for batch in batches:
            for row, size, first, grams in shingle_sets(batch.column("text"), n):
                used = np.flatnonzero(size)
                if not len(used):
                    continue
                low, high = K.total(grams, first)
                doc = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((grams[0], counts.value[_columns(grams[0])], doc))
                length = size - _ceil_share(size, num, den) + (size > 0)
                keep = np.arange(len(doc)) - first[doc] < length[doc]
                blocks = np.where(size > 0, n_blocks(size), 0)
                start = np.concatenate([[0], np.cumsum(blocks)])
                inside = np.bincount(start[doc] + (grams[0].astype(np.int64) & (blocks[doc] - 1)), minlength=start[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(size)).cast(pa.int64()).take(pa.array(used)), pa.array(low[used].view(np.int64)), pa.array(high[used].view(np.int64)), pa.array(size[used].astype(np.int64)),
                        _lists(grams[0][order][keep].view(np.int64), length[used]), _blobs(np.minimum(inside, 65535).astype(np.uint16), blocks[used]),
                    ],
                    schema=schema,
                )

    return run


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the rows that they stand in."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)


def _announce(batches):
    """32 bits of the hash of each distinct prefix shingle of a batch, by the first 8 bits; and, once, of those of several sets of the batch."""
    schema = pa.schema([("part", pa.int32()), ("blob", pa.binary())])
    for batch in batches:
        unique, times = np.unique(K.mix(_flat(batch.column("prefix"))[0]), return_counts=True)
        first = np.searchsorted(unique, np.arange(_MAP_PARTS, dtype=np.uint64) << np.uint64(56))
        short = (unique >> np.uint64(24)).astype(np.uint32)
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(first, [*first[1:], len(unique)])) if a < b]
        blobs = [np.concatenate([short[a:b], short[a:b][times[a:b] > 1]]).tobytes() for _, a, b in spans]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in spans], pa.int32()), pa.array(blobs, pa.binary())], schema=schema)


def _shared(table):
    """A part of the map: bits of hashes that were announced more than once."""
    sent = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("blob").to_pylist()])
    unique, times = np.unique(sent, return_counts=True)
    bits = np.zeros(1 << (SHARED_BITS - 8), np.uint8)
    bits[(unique[times > 1] >> np.uint32(32 - SHARED_BITS + 8)).astype(np.int64)] = 1
    return pa.table({"part": table.column("part").slice(0, 1).cast(pa.int32()), "blob": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _postings(shared: Broadcast):
    """Entries of the matrix in the columns to multiply; pos is the column's place in the row."""
    schema = pa.schema([("shingle", pa.int64()), ("row", pa.int64()), ("low", pa.int64()), ("size", pa.int64()), ("pos", pa.int64())])

    def run(batches):
        for batch in batches:
            grams, of = _flat(batch.column("prefix"))
            pos = np.arange(len(of)) - np.searchsorted(of, of)
            keep = np.flatnonzero(_has(shared.value, K.mix(grams) >> np.uint64(64 - SHARED_BITS)))
            at = pa.array(of[keep])
            yield pa.RecordBatch.from_arrays([pa.array(grams[keep].view(np.int64)), *[batch.column(c).take(at) for c in ("row", "low", "size")], pa.array(pos[keep].astype(np.int64))], schema=schema)

    return run


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at.astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _wanted(batches):
    """A map of the rows of a task, without its empty parts."""
    bits = np.zeros(1 << WANTED_BITS, np.uint8)
    for batch in batches:
        bits[(K.mix(batch.column("row").to_numpy().view(np.uint64)) >> np.uint64(64 - WANTED_BITS)).astype(np.int64)] = 1
    parts = np.packbits(bits).reshape(_MAP_PARTS, -1)
    used = [k for k in range(_MAP_PARTS) if parts[k].any()]
    if used:
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["part", "blob"])


def _either(table):
    bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("blob").to_pylist()])
    return pa.table({"part": table.column("part").slice(0, 1).cast(pa.int32()), "blob": pa.array([bits.tobytes()], pa.binary())})


def _map(parts: DataFrame, combine, bits: int) -> Broadcast:
    """The whole map, 2 ** bits / 8 bytes, on every executor."""
    whole = np.zeros((_MAP_PARTS, (1 << bits) // 8 // _MAP_PARTS), np.uint8)
    for r in parts.groupBy("part").applyInArrow(combine, "part int, blob binary").collect():
        whole[r["part"]] = np.frombuffer(r["blob"], np.uint8)
    return parts.sparkSession.sparkContext.broadcast(whole.reshape(-1))


def _sets(n: int, wanted: Broadcast):
    schema = pa.schema([("low", pa.int64()), ("high", pa.int64()), ("set", pa.binary())])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            keep = ids.is_valid().to_numpy(zero_copy_only=False)
            keep &= _has(wanted.value, K.mix(ids.fill_null(0).to_numpy().view(np.uint64)) >> np.uint64(64 - WANTED_BITS))
            batch = batch.filter(pa.array(keep))
            for _, size, first, grams in shingle_sets(batch.column("text"), n):
                low, high = K.total(grams, first)
                yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), _blobs(grams[0], size)], schema=schema)

    return run


def _bytes(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column, and where each row's begin."""
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    bounds = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(values.tobytes(), kind), (bounds - bounds[0]) // np.dtype(kind).itemsize


def _bounded(num: int, den: int):
    """Pairs whose overlap may reach what their sizes ask for, going by the shingles in each column block."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in (part for whole in batches for part in K.slices(whole, 4096)):
            (one, at_one), (two, at_two) = _bytes(batch.column("blocks_a"), np.uint16), _bytes(batch.column("blocks_b"), np.uint16)
            wide_a, wide_b = np.diff(at_one), np.diff(at_two)
            least = np.minimum(wide_a, wide_b)
            bound = np.zeros(batch.num_rows, dtype=np.int64)
            for wide in np.unique(least):
                own = np.flatnonzero(least == wide)
                for k in range(0, len(own), max(1, (1 << 20) // int(wide))):
                    pairs = own[k : k + max(1, (1 << 20) // int(wide))]
                    sides = []
                    for values, at, widths in ((one, at_one, wide_a), (two, at_two, wide_b)):
                        side, full = np.zeros((len(pairs), wide), dtype=np.int64), np.zeros(len(pairs), bool)
                        for fold in range(int(widths[pairs].max()) // int(wide)):  # more blocks fold into fewer, as their number is a power of two
                            has = np.flatnonzero(widths[pairs] > fold * wide)
                            part = values[(at[pairs[has]] + fold * wide)[:, None] + np.arange(wide)]
                            side[has] += part
                            full[has] |= (part == 65535).any(axis=1)
                        side[full] = 1 << 40  # a block too full to count bounds nothing
                        sides.append(side)
                    bound[pairs] = np.minimum(*sides).sum(axis=1)
            size_a, size_b = (batch.column(c).to_numpy().astype(np.int64) for c in ("size_a", "size_b"))
            keep = pa.array(bound >= _required(size_a, size_b, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], schema=schema)

    return run


def _product(num: int, den: int):
    """Cells of the product that link their rows: overlaps are added up over column blocks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64()), ("n_union", pa.int64())])
    shift = np.uint64(64 - int(np.log2(ADDED_BLOCKS)))

    def cut_up(column):
        values, at = _bytes(column, np.uint64)
        pair = np.repeat(np.arange(len(at) - 1), np.diff(at))
        inside = np.bincount(pair * ADDED_BLOCKS + (values >> shift).astype(np.int64), minlength=(len(at) - 1) * ADDED_BLOCKS).reshape(-1, ADDED_BLOCKS)
        return values, at[:-1, None] + np.cumsum(inside, axis=1) - inside, inside

    def run(batches):
        for batch in (part for whole in batches for part in K.slices(whole)):
            sides = [cut_up(batch.column(c)) for c in ("set_a", "set_b")]
            size_a, size_b = (s[2].sum(axis=1) for s in sides)
            required = _required(size_a, size_b, num, den)
            to_come = np.minimum(sides[0][2], sides[1][2])
            left, overlap = to_come.sum(axis=1), np.zeros(len(required), dtype=np.int64)
            alive = np.flatnonzero(left >= required)
            for block in range(ADDED_BLOCKS):
                values, pairs = [], []
                for of, start, inside in sides:
                    count = inside[alive, block]
                    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    values.append(of[np.repeat(start[alive, block], count) + within])
                    pairs.append(np.repeat(alive, count))
                value, pair = np.concatenate(values), np.concatenate(pairs)
                order = np.lexsort((value, pair))
                value, pair = value[order], pair[order]
                both = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
                overlap += np.bincount(pair[1:][both], minlength=len(overlap))
                left -= to_come[:, block]
                alive = alive[(overlap + left)[alive] >= required[alive]]
            keep = pa.array(alive)
            union = (size_a + size_b - overlap)[alive]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep), pa.array(overlap[alive]), pa.array(union)], schema=schema)

    return run


class NgramJaccardJoin:
    """Documents whose sets of distinct n-word shingles have a Jaccard similarity of at least percent / 100.

    Words are runs of other than space and \\t-\\r, with A-Z lower-cased. A document
    of fewer than n words has its whole sequence as its one shingle; one without
    words, or with null text, has an empty set and links with nothing. Repeated rows
    and ties count as copies. Rows that share a doc_id are versions of one document and
    linked with each other, unless their text has no words; rows with a null doc_id are
    given back unlinked. Tables may be empty and texts of any length. Further columns of
    docs are ignored, whatever their names.

    Shingles and sets are told apart by 128-bit names, overlaps of two sets are counted
    on the first 64 bits of them.
    """

    def __init__(self, n: int = 5, percent: int = 80):
        if n < 1 or not 0 < percent <= 100:
            raise ValueError("n must be at least 1 and percent in 1..100")
        self.n, self.num, self.den = n, percent, 100

    def signatures(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, low, high) of every row, beside slices of the counts of shingles by bucket. low and high name the set."""
        return cut(_own(docs).mapInArrow(_sign(self.n), "doc_id long, n_shingles long, low long, high long, slice int, counts binary"))

    def _sizes_possible(self, size_a, size_b):
        return F.least(size_a, size_b) * self.den >= F.greatest(size_a, size_b) * self.num

    def _pairs_possible(self, size_a, size_b, pos_a, pos_b):
        """Sizes and positions of the first shared column that leave the bound within reach."""
        left = F.least(size_a - pos_a, size_b - pos_b)
        return self._sizes_possible(size_a, size_b) & (left * (self.den + self.num) >= (size_a + size_b) * self.num)

    def rows(self, docs: DataFrame, signed: DataFrame) -> DataFrame:
        """The matrix, a row for each distinct set: the smallest doc_id that has it, its name and size, the columns to multiply, and its shingles by column block."""
        slices = signed.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(_sum_slices, "slice int, counts binary").collect()
        rank = np.zeros(COUNT_BUCKETS, dtype=np.int64)  # COUNT_BUCKETS numbers, however many documents there are
        for s in slices:
            rank[s["slice"] * _SLICE : (s["slice"] + 1) * _SLICE] = np.frombuffer(s["counts"], np.int64)
        counts = docs.sparkSession.sparkContext.broadcast(rank.astype(np.float32))
        every = _own(docs).where("doc_id is not null").mapInArrow(_rows(self.n, self.num, self.den, counts), "doc_id long, low long, high long, size long, prefix array<long>, blocks binary")
        first = every.groupBy("low", "high").agg(F.min(F.struct("doc_id", "size", "prefix", "blocks")).alias("r"))
        return written(first.select(F.col("r.doc_id").alias("row"), "low", "high", "r.size", "r.prefix", "r.blocks"))

    def columns(self, rows: DataFrame) -> DataFrame:
        """Entries (shingle, row, size, pos, central) of the columns to multiply that have several rows; columns with the same rows are one. central: how many entries share the row's columns."""
        shared = _map(rows.select("prefix").mapInArrow(_announce, "part int, blob binary"), _shared, SHARED_BITS)
        entries = rows.select("row", "low", "size", "prefix").mapInArrow(_postings(shared), "shingle long, row long, low long, size long, pos long")
        own = F.xxhash64("row", "low")
        columns = entries.groupBy("shingle").agg(F.count("*").alias("n"), F.bit_xor(own).alias("x"), F.bit_xor(F.xxhash64(own, F.lit(1))).alias("y"), F.min("pos").alias("first")).where("n > 1")
        merged = columns.groupBy("n", "x", "y").agg(F.min(F.struct("first", "shingle")).alias("s"), F.count("*").alias("times")).select(F.col("s.shingle").alias("shingle"), (F.col("n") * F.col("times")).alias("weight"))
        members = written(entries.drop("low").join(merged, "shingle").select("shingle", "row", "size", "pos", "weight"))
        central = members.groupBy("row").agg(F.sum("weight").alias("central"))
        return written(members.join(central, "row").select("shingle", "row", "size", "pos", "central"))

    def links(self, docs: DataFrame, rows: DataFrame) -> DataFrame:
        """Verified links (a, b, overlap, n_union) between rows that connect all components of the join."""
        first, more, last, _ = self._search(docs, rows)
        return first.unionByName(more).unionByName(last)

    def _search(self, docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Links of the three comparisons, and the components after the first two."""
        members = self.columns(rows)

        # Each row against its column's most central one: the one whose columns have most rows.
        tops = members.groupBy("shingle").agg(F.max(F.struct("central", "row", "size", "pos")).alias("top"))
        star = members.join(tops, "shingle").where(F.col("row") != F.col("top.row")).where(self._pairs_possible(F.col("top.size"), F.col("size"), F.col("top.pos"), F.col("pos")))
        star = self._within_bounds(rows, star.select(F.least("row", "top.row").alias("a"), F.greatest("row", "top.row").alias("b")).distinct())
        known = cut(self._linked(docs, rows, star))
        found = connected_components(known, "a", "b")

        # Columns that still hold several components: rows outside the largest one against some central ones of it.
        mixed = written(self._mixed(members, found))
        main = F.col("part") == F.col("main")
        ranks = [F.max(F.when(main, F.struct((F.col("central") * (F.pmod(F.xxhash64("row", F.lit(k)), F.lit(1024)) + 1024)).alias("h"), "row", "size"))).alias(f"r{k}") for k in range(REPRESENTATIVES)]
        chosen = mixed.groupBy("shingle").agg(*ranks)
        outside = mixed.where("part <> main").join(chosen, "shingle").groupBy("row", "size", "main").agg(*[F.max(f"r{k}").alias(f"r{k}") for k in range(REPRESENTATIVES)])
        some = outside.select("row", "size", F.explode(F.array(*[f"r{k}" for k in range(REPRESENTATIVES)])).alias("r")).where(self._sizes_possible(F.col("size"), F.col("r.size")))
        some = some.select(F.least("row", "r.row").alias("a"), F.greatest("row", "r.row").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
        tried = self._within_bounds(rows, some)
        more = cut(self._linked(docs, rows, tried))
        joined = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b"))
        found = connected_components(joined, "a", "b")

        # What is still outside, against all other rows of its columns.
        mixed = written(self._mixed(mixed.drop("part", "main"), found))
        one = mixed.where("part <> main").select("shingle", F.col("row").alias("x"), F.col("size").alias("x_size"), F.col("pos").alias("x_pos"), F.col("part").alias("x_part"))
        other = mixed.select("shingle", F.col("row").alias("y"), F.col("size").alias("y_size"), F.col("pos").alias("y_pos"), F.col("part").alias("y_part"))
        rest = (
            one.join(other, "shingle")
            .where(F.col("x_part") != F.col("y_part"))
            .where(self._pairs_possible(F.col("x_size"), F.col("y_size"), F.col("x_pos"), F.col("y_pos")))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
            .join(star.unionByName(tried), ["a", "b"], "left_anti")
        )
        return known, more, cut(self._linked(docs, rows, self._within_bounds(rows, rest))), found

    def _mixed(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """Entries of the columns that hold several components, with their component and the column's largest one."""
        labelled = members.join(found, members["row"] == found["node"], "left").select("shingle", "row", "size", "pos", "central", F.coalesce("component", "row").alias("part"))
        parts = labelled.groupBy("shingle", "part").agg(F.count("*").alias("n"))
        main = parts.groupBy("shingle").agg(F.max(F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("shingle", F.col("main.part").alias("main"))
        return labelled.join(main, "shingle")

    def _within_bounds(self, rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """Pairs whose shingles by column block leave a link within reach."""
        side = lambda name: rows.select(F.col("row").alias(name), F.col("size").alias(f"size_{name}"), F.col("blocks").alias(f"blocks_{name}"))
        return cut(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounded(self.num, self.den), "a long, b long"))

    def _linked(self, docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """Pairs whose whole sets link. Only documents that stand for a row in a pair send their set (and a few more, where the map of wanted ones says so by chance)."""
        if pairs.isEmpty():
            return pairs.select("a", "b", F.lit(0).cast("long").alias("overlap"), F.lit(0).cast("long").alias("n_union"))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("row"))
        bits = _map(wanted.mapInArrow(_wanted, "part int, blob binary"), _either, WANTED_BITS)
        sets = written(_own(docs).mapInArrow(_sets(self.n, bits), "low long, high long, set binary").join(rows.select("row", "low", "high"), ["low", "high"]).select("row", "set"))
        both = pairs.join(sets.select(F.col("row").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("row").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
        return both.mapInArrow(_product(self.num, self.den), "a long, b long, overlap long, n_union long")

    def run(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every row of docs; component_id is the smallest doc_id reachable by links."""
        signed = self.signatures(docs)
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
        every = signed.where("slice is null").select("doc_id", "n_shingles", "low", "high", part.alias("part"))
        parts = every.where("low is not null and doc_id is not null").groupBy("low", "high", "part").agg(F.min("doc_id").alias("least"))
        rows = parts.groupBy("low", "high").agg(F.min("least").alias("row"))
        named = written(parts.drop("least").join(rows, ["low", "high"]))
        mapped = every.join(named, ["low", "high", "part"], "left").select("doc_id", "n_shingles", "row")
        several = mapped.groupBy("doc_id").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("doc_id")
        versions = mapped.join(several, "doc_id", "left_semi").where("row is not null").select(F.col("doc_id").alias("a"), F.col("row").alias("b"))

        _, _, last, found = self._search(docs, self.rows(docs, signed))
        late = cut(last.select("a", "b").unionByName(versions))
        if not late.isEmpty():
            found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late), "a", "b")
        labels = named.join(found, named["row"] == found["node"], "left").select("low", "high", "part", F.coalesce("component", "row").alias("component_id"))
        return every.join(labels, ["low", "high", "part"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
