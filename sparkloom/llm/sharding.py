"""Shards along a Hilbert curve over document metadata.

Source, language and length are quantised to a small cube of cells: names by ranges of
about equal row counts in their order, lengths by powers of two. The curve index of a cell
orders documents so that neighbours on the curve are alike in all dimensions, and the
order is cut into runs of equal count. A reader that filters on any of the dimensions, or
prunes by their smallest and largest values, then needs few files. DataFrame functions
only.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.ranking import group_positions

#: Bits of each dimension: the cube has 2 ** (3 * BITS) cells, whatever the table's size.
BITS = 4
DIMS = 3


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve of a point whose coordinates are 0 .. 2**bits - 1.

    The coordinates are rotated and reflected level by level, from the top bit down, and
    the result is Gray-decoded and interleaved. Runs as one aggregate over the levels.
    """
    dims = len(axes)
    start = F.array(*[a.cast("long") for a in axes])
    levels = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(d).alias("d")) for b in range(bits - 1, 0, -1) for d in range(dims)])

    def turn(x: Column, step: Column) -> Column:
        low = step["q"] - 1
        own = F.element_at(x, step["d"] + 1)
        first = F.element_at(x, 1)
        is_set = own.bitwiseAND(step["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)

        def moved(v: Column, i: Column) -> Column:
            flipped = F.when(i == 0, v.bitwiseXOR(low)).otherwise(v)
            traded = F.when((i == 0) | (i == step["d"]), v.bitwiseXOR(swap)).otherwise(v)
            return F.when(is_set, flipped).otherwise(traded)

        return F.transform(x, moved)

    turned = F.aggregate(levels, start, turn) if bits > 1 else start

    def gray(x: Column) -> Column:
        """Each coordinate xor all before it, then all xor the parity that the last one leaves."""
        return F.transform(x, lambda _, i: F.aggregate(F.slice(x, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)))

    def finish(x: Column) -> Column:
        last = F.element_at(x, dims)
        parity = F.aggregate(F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, -1, -1)]), F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(x, lambda v: v.bitwiseXOR(parity))

    bit_places = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(d + 1).alias("d")) for b in range(bits - 1, -1, -1) for d in range(dims)])
    held = F.transform(F.array(turned), gray)
    held = F.transform(held, finish)
    index = F.transform(held, lambda x: F.aggregate(bit_places, F.lit(0).cast("long"), lambda n, p: n * 2 + F.when(F.element_at(x, p["d"]).bitwiseAND(p["q"]) != 0, 1).otherwise(0)))
    return F.element_at(index, 1)


def _named_cells(docs: DataFrame, names: list[str]) -> list[Column]:
    """For each column: 0 for null, else 1 .. 2**BITS - 1, growing with the value: equal values share a cell.

    A value's place is read from the six bytes after what all values begin with, and the
    cells are cut at approximate quantiles of that, so a frequent value has a cell of its own.
    """
    text = {c: F.col(c).cast("string") for c in names}
    ends = docs.agg(*[f(text[c]).alias(f"{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))]).first()
    place = {}
    for c in names:
        common = len(os.path.commonprefix([(ends[f"lo_{c}"] or "").encode(), (ends[f"hi_{c}"] or "").encode()]))
        place[c] = F.conv(F.rpad(F.hex(F.substring(text[c].cast("binary"), common + 1, 6)), 12, "0"), 16, 10).cast("double")
    cells = (1 << BITS) - 1
    cuts = docs.agg(*[F.percentile_approx(place[c], [k / cells for k in range(1, cells)], 1000).alias(c) for c in names]).first()
    out = []
    for c in names:
        own = sorted(set(cuts[c] or []))
        bounds = F.array(*[F.lit(v) for v in own]).cast("array<double>")
        at = place[c]
        rank = F.size(F.filter(bounds, lambda b: b < at))  # noqa: B023  used at once
        spread = F.least(F.floor(rank * (cells - 1) / F.lit(max(1, len(own) - 1))), F.lit(cells - 1))  # few values lie as far apart as the cube allows
        out.append(F.when(text[c].isNull(), F.lit(0)).otherwise(spread + 1).cast("long"))
    return out


def _size_cell(size: Column) -> Column:
    """Powers of two of the size, from 16 bytes up."""
    return F.least(F.floor(F.log2(size.cast("double") / 16)), F.lit((1 << BITS) - 1)).cast("long")


class HilbertShards:
    """Deals documents into `shards` runs along the curve, whose row counts differ by at most one.

    Dimensions: source, lang and size (UTF-8 bytes of the text plus 16). Null source or
    lang have a cell of their own; a null text counts as empty. Within a cell rows are
    ordered by a hash and doc_id, so a cell with many rows (one source, equal texts)
    spreads over as many shards as its share of rows asks. Repeated rows are separate
    rows; null doc_ids come last in their part; an empty table gives no rows; further
    columns are ignored.
    """

    law = "rows"

    def __init__(self, shards: int = 40):
        if shards < 1:
            raise ValueError("at least one shard")
        self.shards = shards

    def run(self, docs: DataFrame) -> DataFrame:
        """(doc_id, size, text_crc32, curve, position, shard, slot): position in the whole order, slot in the shard."""
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        size = F.octet_length(text).cast("long") + 16
        source, lang = _named_cells(docs, ["source", "lang"])
        rows = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), source.alias("x"), lang.alias("y"), _size_cell(size).alias("z")
        ).withColumn("cell", (F.col("x") * (1 << BITS) + F.col("y")) * (1 << BITS) + F.col("z"))
        cells = rows.groupBy("cell", "x", "y", "z").agg(F.count("*").alias("n")).withColumn("curve", hilbert_index([F.col("x"), F.col("y"), F.col("z")], BITS))
        along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)  # over cells: at most 2 ** (DIMS * BITS) rows
        starts = cells.select("cell", "curve", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
        own = group_positions(rows.drop("x", "y", "z"), ["cell"], F.xxhash64("doc_id", "text_crc32"), [F.asc_nulls_last("doc_id"), F.asc("text_crc32"), F.asc("size")], "within")
        k, n, m = F.col("position"), F.col("total"), F.lit(self.shards).cast("long")
        short, long_runs = F.floor(n / m).cast("long"), F.pmod(n, m)
        head = long_runs * (short + 1)  # rows in the shards that take one more
        shard = F.when(k < head, F.floor(k / (short + 1))).otherwise(long_runs + F.floor((k - head) / F.greatest(short, F.lit(1)))).cast("int")
        first = F.col("shard") * short + F.least(F.col("shard").cast("long"), long_runs)
        return (
            own.join(F.broadcast(starts), "cell")  # a row for each cell of the cube at most
            .withColumn("position", F.col("before") + F.col("within"))
            .withColumn("shard", shard)
            .withColumn("slot", (k - first).cast("long"))
            .select("doc_id", "size", "text_crc32", "curve", "position", "shard", "slot")
        )
