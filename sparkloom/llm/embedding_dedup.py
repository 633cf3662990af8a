"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with a cosine of at least t are within a squared distance of 2 - 2 t.
After a rotation the dimensions are cut into blocks; each block gets a share of that
squared distance in proportion to its dimensions, and two vectors within the whole
distance are within the share in at least one block. So each block is range-joined
under its share, and whatever any block brings up is verified by the cosine itself.

The rotation orders the principal directions so that every block begins with one of
the widest; the range join of a block cuts that first coordinate into slabs as wide as
the block's radius, so partners lie in the same slab or the next one. Slabs are cut
into tiles of bounded size, and a task holds two tiles: it takes block distances by
matrix products, verifies what is within the share, and returns sums and a spanning
forest of the links, never the pairs. A pair counts in the first block that brings it
up, so the union needs no distinct. Equal vectors are one row of the join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import connected_components
from sparkloom.llm.session import cut

#: Rows that a tile holds at most, whatever the table's size.
TILE_ROWS = 16384
_STEP = 512
_SLACK = 1e-5


def _vectors(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an array column without nulls in it."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])


def _matrix(column, width: int) -> np.ndarray:
    values, offsets = _vectors(column)
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return values.reshape(len(sizes), width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1], sizes)] = values
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(width: int):
    schema = pa.schema([("k", pa.int32()), ("row", pa.binary())])

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            u = _unit(_matrix(batch.column("vector"), width))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], schema=schema)

    return run


def _add_rows(table):
    total = np.sum([np.frombuffer(b) for b in table.column("row").to_pylist()], axis=0)
    return pa.table({"k": table.column("k").slice(0, 1).cast(pa.int32()), "row": pa.array([total.tobytes()], pa.binary())})


class Blocks:
    """The rotation, and which rotated dimensions each block has."""

    def __init__(self, moments: np.ndarray, block_dims: int, cosine: float):
        width = len(moments)
        count = max(1, width // block_dims)
        _, directions = np.linalg.eigh(moments)
        order = [d for b in range(count) for d in range(b, width, count)]  # block b begins with the b-th widest direction
        self.rotation = directions[:, ::-1][:, order].copy()
        sizes = [len(range(b, width, count)) for b in range(count)]
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        self.budget = 2 - 2 * cosine
        self.shares = [self.budget * s / width for s in sizes]
        self.radii = [math.sqrt(s + _SLACK) for s in self.shares]
        self.count, self.width, self.cosine = count, width, cosine


def _deal(blocks: Blocks, slab_tiles, kind):
    """A row for each task that needs a vector: those of its tile and of the tiles of the slabs beside it."""
    schema = pa.schema([("key", pa.int64()), ("side", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("dims", pa.int32()), ("vector", pa.binary()), ("turned", pa.binary())])

    def run(batches):
        counts = slab_tiles.value
        for batch in batches:
            x = _matrix(batch.column("vector"), blocks.width)
            unit = _unit(x)
            turned = unit @ blocks.rotation
            node = batch.column("node").to_numpy()
            copies, dims = batch.column("copies").to_numpy(), batch.column("dims").to_numpy().astype(np.int32)
            spread = (node * np.int64(0x9E3779B97F4A7C15 - 2**64)).astype(np.uint64) >> np.uint64(33)
            raw, rot = [v.tobytes() for v in x.astype(kind)], [v.tobytes() for v in turned.astype(np.float32)]
            at, key, side = [], [], []
            for b in range(blocks.count):
                slab = np.floor(turned[:, blocks.edges[b]] / blocks.radii[b]).astype(np.int64)
                tiles = {s: counts[b].get(s, 1) for x in np.unique(slab).tolist() for s in (x - 1, x, x + 1)}
                own, above, below = (np.array([tiles[s + d] for s in slab.tolist()], dtype=np.int64) for d in (0, 1, -1))
                mine = (spread % own.astype(np.uint64)).astype(np.int64)
                for many, step in ((own, 0), (above, 1), (below, -1)):  # its slab's tiles, and those of the slabs beside it
                    who = np.repeat(np.arange(len(slab)), many)
                    tile = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
                    first, second = (np.minimum(mine[who], tile), np.maximum(mine[who], tile)) if step == 0 else (mine[who], tile) if step > 0 else (tile, mine[who])
                    at.append(who)
                    key.append(_key(b, slab[who] + min(step, 0), first, slab[who] + max(step, 0), second))
                    side.append((mine[who] > tile).astype(np.int32) if step == 0 else np.full(len(who), int(step < 0), np.int32))
            at, key, side = (np.concatenate(x) for x in (at, key, side))
            for k in range(0, len(at), 4096):
                a = at[k : k + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[k : k + 4096], pa.int64()), pa.array(side[k : k + 4096], pa.int32()), pa.array(node[a]), pa.array(copies[a]), pa.array(dims[a]), pa.array([raw[i] for i in a], pa.binary()), pa.array([rot[i] for i in a], pa.binary())],
                    schema=schema,
                )

    return run


def _key(block: int, slab_a, tile_a, slab_b, tile_b):
    """Numbers the pairs of tiles, one by one or as arrays."""
    return (((block << 12 | (slab_a + 2048)) << 1 | (slab_b - slab_a)) << 21 | tile_a) << 21 | tile_b


class _Forest:
    """Links within a task, as a forest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Joins a[i] to b[i]; returns the links that joined anything."""
        used = []
        up = self.up
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                break
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            _, first = np.unique(hi, return_index=True)
            up[hi[first]] = lo[first]
            used += list(zip(a[first].tolist(), b[first].tolist()))
        return used

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[x]
            if (nxt == x).all():
                return x
            up[x] = up[nxt]
            x = up[x]


def _compare(blocks: Blocks, kind):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(table):
        key = table.column("key")[0].as_py()
        b = key >> 55
        within = key >> 42 & 1 == 0 and (key >> 21) & (2**21 - 1) == key & (2**21 - 1)  # a tile with itself
        table = table.sort_by([("side", "ascending"), ("node", "ascending")])
        node, copies, dims = (table.column(c).to_numpy() for c in ("node", "copies", "dims"))
        side = table.column("side").to_numpy()
        unit = _unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(len(node), -1).astype(np.float64))
        turned = np.frombuffer(b"".join(table.column("turned").to_pylist()), np.float32).reshape(len(node), -1)
        na = int(np.searchsorted(side, 1)) if not within else len(node)
        first_b = 0 if within else na
        lo, hi = blocks.edges[b], blocks.edges[b + 1]
        own = turned[:, lo:hi]
        norms, ones = (own * own).sum(axis=1, keepdims=True), np.ones((len(own), 1), np.float32)
        rows_of, columns_of = np.hstack([own, norms, ones]), np.ascontiguousarray(np.hstack([-2 * own, ones, norms]).T)  # their product is the squared distance
        limit = np.float32(blocks.shares[b] + _SLACK)
        links = np.zeros(len(node), dtype=np.int64)
        forest, edges = _Forest(len(node)), []
        for k in range(0, na, _STEP):
            rows = slice(k, min(na, k + _STEP))
            from_b = k if within else first_b
            near = np.flatnonzero(rows_of[rows] @ columns_of[:, from_b:] <= limit)
            i, j = np.divmod(near, len(node) - from_b)
            i, j = i + k, j + from_b
            if within:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 65536):
                x, y = i[s : s + 65536], j[s : s + 65536]
                gap = (turned[x] - turned[y]) ** 2
                early = np.zeros(len(x), bool)
                for e in range(b):
                    early |= gap[:, blocks.edges[e] : blocks.edges[e + 1]].sum(axis=1) <= blocks.shares[e] + _SLACK / 2
                here = gap[:, lo:hi].sum(axis=1) <= blocks.shares[b] + _SLACK / 2
                keep = here & ~early & (dims[x] == dims[y])
                x, y = x[keep], y[keep]
                keep = (unit[x] * unit[y]).sum(axis=1) >= blocks.cosine
                x, y = x[keep], y[keep]
                links += np.bincount(x, copies[y], len(node)).astype(np.int64) + np.bincount(y, copies[x], len(node)).astype(np.int64)
                edges += forest.link(x, y)
        seen = np.flatnonzero(links)
        ea = np.array([e[0] for e in edges], dtype=np.int64)
        eb = np.array([e[1] for e in edges], dtype=np.int64)
        return pa.table(
            [pa.array(np.concatenate([node[seen], node[ea]])), pa.array(np.concatenate([links[seen], np.zeros(len(ea), np.int64)])), pa.array(np.concatenate([np.zeros(len(seen), np.int64), node[eb]]), mask=np.concatenate([np.ones(len(seen), bool), np.zeros(len(ea), bool)]))],
            schema=schema,
        )

    return run


class EmbeddingDedup:
    """Links vectors whose cosine, in double precision, is at least `cosine`.

    Vectors that are null, empty or zero, or hold null or non-finite components, link
    with nothing; so do vectors of different lengths with each other. Repeated vectors
    link as any others; different vectors of one vec_id are one item, which has the links
    of all of them. Rows with a null vec_id are given back without links and with no
    class, and link nothing. Empty tables give no rows; further columns are ignored.
    """

    def __init__(self, cosine: float = 0.95, block_dims: int = 16):
        if not 0 < cosine <= 1 or block_dims < 1:
            raise ValueError("cosine must be in (0, 1], block_dims at least 1")
        self.cosine, self.block_dims = cosine, block_dims

    def run(self, embeddings: DataFrame) -> DataFrame:
        """(vec_id, n_links, component_id, kept) for each row; component_id and kept are null where vec_id is."""
        spark = embeddings.sparkSession
        kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
        number = np.float32 if kind == "float" else np.float64
        rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
        good = F.col("vec_id").isNotNull() & F.coalesce(F.exists("vector", lambda v: v != 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
        rows = cut(rows.select("vec_id", F.when(good, F.col("vector")).alias("vector")))
        sets = cut(rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("dims", F.size("vector")))
        head = sets.agg(F.max("dims").alias("width"), F.count("*").alias("n")).first()
        if not head["n"]:
            return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.when(F.col("vec_id").isNotNull(), True).alias("kept"))
        width, n = head["width"], head["n"]
        sums = sets.select("vector").mapInArrow(_moments(width), "k int, row binary").groupBy("k").applyInArrow(_add_rows, "k int, row binary").collect()
        blocks = Blocks(np.array([np.frombuffer(r["row"]) for r in sorted(sums, key=lambda r: r["k"])]), self.block_dims, self.cosine)

        tile = min(TILE_ROWS, max(1024, n // 4))
        slabs = self._slab_counts(sets, blocks)
        tiles = [{s: -(-c // tile) for s, c in of.items()} for of in slabs]
        dealt = sets.mapInArrow(_deal(blocks, spark.sparkContext.broadcast(tiles), number), "key long, side int, node long, copies long, dims int, vector binary, turned binary")
        found = cut(dealt.groupBy("key").applyInArrow(_compare(blocks, number), "node long, links long, other long"))
        links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
        parts = connected_components(found.where("other is not null").select("node", "other"), "node", "other")
        named = (
            sets.join(links, "node", "left")
            .join(parts, "node", "left")
            .select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
        )
        out = rows.join(named, "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))

    def _slab_counts(self, sets: DataFrame, blocks: Blocks) -> list[dict[int, int]]:
        """Rows by slab for each block. A slab is as wide as the block's radius and coordinates lie in -1..1, so there are few."""

        def count(batches):
            total: dict[tuple[int, int], int] = {}
            for batch in batches:
                turned = _unit(_matrix(batch.column("vector"), blocks.width)) @ blocks.rotation
                for b in range(blocks.count):
                    slab, times = np.unique(np.floor(turned[:, blocks.edges[b]] / blocks.radii[b]).astype(np.int64), return_counts=True)
                    for s, c in zip(slab.tolist(), times.tolist()):
                        total[b, s] = total.get((b, s), 0) + c
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["block", "slab", "n"])

        out: list[dict[int, int]] = [{} for _ in range(blocks.count)]
        for r in sets.select("vector").mapInArrow(count, "block int, slab long, n long").groupBy("block", "slab").agg(F.sum("n").alias("n")).collect():
            out[r["block"]][r["slab"]] = r["n"]
        return out
