"""Substring dedup by recompression.

Texts are rewritten in rounds. In each, a maximal run of equal symbols becomes one
symbol, and then neighbouring symbols whose coins show left and right become one pair
symbol. The name of a symbol is a 128-bit digest of what it stands for, so every
executor gives equal runs and pairs the same name without asking, and equal substrings
get equal symbols but for some at their edges: a run may go on outside, and a symbol at
the edge may have its partner outside.

A window is what the rounds leave of it: the runs and symbols that each round takes
from its two ends, and the top symbols between them. Equal windows, wherever they stand,
are taken apart in the same way, so this sequence is the same, and it spells the window.
One exchange finds which top symbols stand in more than one place; only windows whose
top symbols all do can repeat, and only those are spelled. A second exchange finds where
each spelling stands first.

Documents are dealt into chunks once; the three passes over a chunk (name, propose,
remove) reuse that exchange. Between passes a chunk sends each distinct name once,
packed by hash bucket, so a name that stands everywhere costs one entry per chunk, and
gets one bit back. Entries, and rows that hold them, are at most as many as the distinct
names of the chunks, whatever the number of buckets.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import kernels as K

CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
_LAST = np.iinfo(np.int64).max
_EMPTY = (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))


def plan_rounds(window: int) -> int:
    """Rounds after which a window usually still holds top symbols: each takes about three symbols from its ends and leaves symbols a third longer."""
    rounds = 0
    while 9 * ((4 / 3) ** (rounds + 1) - 1) <= 0.65 * window:
        rounds += 1
    return rounds


@dataclass
class Round:
    """One round over the symbols of some documents."""

    name: K.Name  # the symbols that come in
    first: np.ndarray  # where the run of each begins
    last: np.ndarray  # and ends
    run: np.ndarray  # its place among the runs
    run_name: K.Name
    coin: np.ndarray  # of each run: whether it is a right half
    into: np.ndarray  # its place among the symbols that go out


def recompress(name: K.Name, doc: np.ndarray, rounds: int) -> tuple[list[Round], K.Name]:
    """The rounds, and the names of the top symbols."""
    out = []
    for level in range(rounds):
        head = np.ones(len(doc), bool)
        head[1:] = (name[0][1:] != name[0][:-1]) | (name[1][1:] != name[1][:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(doc))
        run = np.cumsum(head) - 1
        runs, doc = K.pick(name, first), doc[first]
        many = np.flatnonzero(last - first > 1)
        if len(many):
            runs = tuple(x.copy() for x in runs)
            for lane, value in zip(runs, K.tagged(K.pick(runs, many), (last - first)[many])):
                lane[many] = value
        coin = (K.mix(runs[0] + np.uint64(level)) >> np.uint64(40) & np.uint64(1)).astype(bool)
        merge = np.zeros(len(doc), bool)
        merge[:-1] = ~coin[:-1] & coin[1:] & (doc[1:] == doc[:-1])
        stay = np.ones(len(doc), bool)
        stay[1:] = ~merge[:-1]
        left = np.flatnonzero(merge)
        pairs = K.join(K.pick(runs, left), K.pick(runs, left + 1))
        top = tuple(x.copy() for x in runs)
        for lane, value in zip(top, pairs):
            lane[left] = value
        out.append(Round(name, first[run], last[run], run, runs, coin, np.cumsum(stay) - 1))
        name, doc = K.pick(top, stay), doc[stay]
    return out, name


def inner(rounds: list[Round], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The top symbols [left, right) that each window of words [left, right) is left with."""
    for r in rounds:
        _, left, right, _ = _off_runs(r, left, right)
        _, left, right, _ = _off_halves(r, left, right)
    return left, right


def _moved(left: np.ndarray, right: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same stretches, counted in the symbols that `into` leads to; an empty one is [0, 0)."""
    some = left < right
    begin, end = np.where(some, left, 0), np.where(some, right - 1, 0)
    return np.where(some, into[begin], 0), np.where(some, into[end] + 1, 0)


def _off_runs(r: Round, left: np.ndarray, right: np.ndarray):
    """Takes a run off each end, as far as it lies in the window: (how many symbols on the left, new stretch in runs, how many on the right)."""
    if not len(r.run):
        return left * 0, left * 0, left * 0, left * 0
    some = left < right
    begin = np.where(some, np.minimum(r.last[np.where(some, left, 0)], right), left)
    some = begin < right
    end = np.where(some, np.maximum(r.first[np.where(some, right - 1, 0)], begin), right)
    taken, after = begin - left, right - end
    begin, end = _moved(begin, end, r.run)
    return taken, begin, end, after


def _off_halves(r: Round, left: np.ndarray, right: np.ndarray):
    """Takes off a right half at the left end and a left half at the right end, whose partners may stand outside."""
    if not len(r.coin):
        return left * 0, left * 0, left * 0, left * 0
    taken = ((left < right) & r.coin[np.where(left < right, left, 0)]).astype(np.int64)
    begin = left + taken
    after = ((begin < right) & ~r.coin[np.where(begin < right, right - 1, 0)]).astype(np.int64)
    begin, end = _moved(begin, right - after, r.into)
    return taken, begin, end, after


def spell(rounds: list[Round], top: K.Name, left: np.ndarray, right: np.ndarray) -> K.Name:
    """Names of windows of words [left, right) by what the rounds take from their ends and the top symbols that are left."""
    heads, tails = ([np.full(len(left), seed) for seed in _EMPTY] for _ in range(2))

    def put(chain, own, name):
        for lane, value in zip(chain, K.join(tuple(lane[own] for lane in chain), name)):
            lane[own] = value

    for r in rounds:
        taken, begin, end, after = _off_runs(r, left, right)
        own = np.flatnonzero(taken)
        put(heads, own, K.tagged(K.pick(r.name, left[own]), taken[own]))
        own = np.flatnonzero(after)
        put(tails, own, K.tagged(K.pick(r.name, right[own] - 1), after[own]))
        left, right = begin, end
        taken, begin, end, after = _off_halves(r, left, right)
        own = np.flatnonzero(taken)
        put(heads, own, K.pick(r.run_name, left[own]))
        own = np.flatnonzero(after)
        put(tails, own, K.pick(r.run_name, right[own] - 1))
        left, right = begin, end
    at, own = left.copy(), np.flatnonzero(left < right)
    while len(own):
        put(heads, own, K.pick(top, at[own]))
        at[own] += 1
        own = own[at[own] < right[own]]
    return K.join(tuple(heads), tuple(tails))


class _Chunk:
    """The documents of one chunk, parsed; rows in order of doc_id, so that the first of equal windows in a chunk comes first."""

    def __init__(self, table, window: int):
        ids = table.column("doc_id").fill_null(_LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.table = table.take(pa.array(order))
        self.ids = ids[order]
        self.window = window
        self.parts = list(K.steps(self.table.column("text"), K.BLANK_WORD, K.IDENTITY))
        self.rounds = [recompress(w.name, w.doc, plan_rounds(window)) for _, w in self.parts]
        names = np.concatenate([top[0] for _, top in self.rounds] or [np.zeros(0, np.uint64)])
        self.unique, self.of = np.unique(names, return_inverse=True)
        self.times = np.bincount(self.of, minlength=len(self.unique))

    def proposed(self, repeated: np.ndarray):
        """Windows whose top symbols all stand in several places: for each, its name (in two columns), doc_id, start in the document, step, and start in the step. Sorted by document and start."""
        found, flags, k = [], repeated[self.of], 0
        for n, ((row, w), (rounds, top)) in enumerate(zip(self.parts, self.rounds)):
            seen = np.concatenate([[0], np.cumsum(flags[k : k + len(top[0])])])
            k += len(top[0])
            count = len(w.doc) - self.window + 1
            if count <= 0:
                continue
            at = np.flatnonzero(w.doc[:count] == w.doc[self.window - 1 :])
            left, right = inner(rounds, at, at + self.window)
            at = at[seen[right] - seen[left] == right - left]
            low, high = spell(rounds, top, at, at + self.window)
            found.append((low, high, self.ids[row + w.doc[at]], at - w.first[w.doc[at]], np.full(len(at), n), at))
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)
        out = [np.concatenate(x).astype(t) for x, t in zip(zip(*found), kinds)] if found else [np.zeros(0, t) for t in kinds]
        if (self.ids[1:] == self.ids[:-1]).any():  # rows that share a doc_id
            order = np.lexsort((out[3], out[2]))
            out = [x[order] for x in out]
        return out


def _bucket(names: np.ndarray, n: int) -> np.ndarray:
    return ((names >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _pack(names: np.ndarray, n: int, columns: list[np.ndarray], chunk, schema) -> pa.Table:
    """A row for each bucket that has names: the columns' values, one after the other, as bytes."""
    order, first = K.by_group(_bucket(names, n), n)
    used = np.flatnonzero(np.diff(first))
    blobs = [b"".join(c[order[first[b] : first[b + 1]]].tobytes() for c in columns) for b in used]
    return pa.table([pa.array(used, pa.int32()), pa.array(np.full(len(used), chunk), pa.int64()), pa.array(blobs, pa.binary())], schema=schema)


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
_BACK = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
_SENT_SQL = "bucket int, chunk long, blob binary"
_BACK_SQL = "chunk long, kind int, bucket int, bits binary"


def _answer(names: np.ndarray, n: int, back, kind: int) -> np.ndarray:
    """The bit that came back for each name."""
    out = np.zeros(len(names), bool)
    order, first = K.by_group(_bucket(names, n), n)
    for k, b, bits in zip(back.column("kind").to_pylist(), back.column("bucket").to_pylist(), back.column("bits").to_pylist()):
        if k == kind:
            own = order[first[b] : first[b + 1]]
            out[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
    return out


def _name(window: int, n: int):
    def run(table):
        chunk = _Chunk(table, window)
        return _pack(chunk.unique, n, [chunk.unique.astype(np.uint32)], table.column("chunk")[0].as_py(), _SENT)

    return run


def _bits(table, kind: int, values: list[np.ndarray]) -> pa.Table:
    rows = len(values)
    bucket = table.column("bucket")[0].as_py()
    return pa.table(
        [pa.array(table.column("chunk").to_pylist(), pa.int64()), pa.array([kind] * rows, pa.int32()), pa.array([bucket] * rows, pa.int32()), pa.array([np.packbits(v).tobytes() for v in values], pa.binary())], schema=_BACK
    )


def _several(table):
    """Which names of each chunk stand in another chunk too."""
    blobs = [np.frombuffer(b, np.uint32) for b in table.column("blob").to_pylist()]
    _, of, times = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    return _bits(table, 0, np.split(times[of] > 1, np.cumsum([len(b) for b in blobs])[:-1]))


def _firsts(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct name stands first, in order, and which of these each window has. The windows come in order of document and start."""
    order = np.lexsort((high, low))
    head = np.ones(len(order), bool)
    head[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    first, of = order[head], np.empty(len(order), dtype=np.int64)
    place = np.empty(len(first), dtype=np.int64)
    place[np.argsort(first)] = np.arange(len(first))
    of[order] = place[np.cumsum(head) - 1]
    return np.sort(first), of


def _repeated(chunk: _Chunk, back, n: int) -> np.ndarray:
    return (chunk.times > 1) | _answer(chunk.unique, n, back, 0)


def _propose(window: int, n: int):
    def run(table, back):
        if not table.num_rows:
            return _SENT.empty_table()
        chunk = _Chunk(table, window)
        low, high, ids, starts = chunk.proposed(_repeated(chunk, back, n))[:4]
        first, _ = _firsts(low, high)
        return _pack(low[first], n, [low[first], high[first], ids[first], starts[first].astype(np.uint32)], table.column("chunk")[0].as_py(), _SENT)

    return run


def _earliest(table):
    """Which windows of each chunk stand first there of all places."""
    blobs = table.column("blob").to_pylist()
    sizes = [len(b) // 28 for b in blobs]

    def column(kind, at):
        return np.concatenate([np.frombuffer(b, kind, s, at * s) for b, s in zip(blobs, sizes)])

    low, high, ids, starts = column(np.uint64, 0), column(np.uint64, 8), column(np.int64, 16), column(np.uint32, 24)
    order = np.lexsort((starts, ids, high, low))
    low, high, ids, starts = low[order], high[order], ids[order], starts[order]
    head = np.ones(len(low), bool)
    head[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    first = np.empty(len(low), bool)
    first[order] = (ids == ids[lead]) & (starts == starts[lead])
    return _bits(table, 1, np.split(first, np.cumsum(sizes)[:-1]))


def _remove(window: int, n: int, schema: pa.Schema, carried: list[str], with_text: bool):
    def run(table, back):
        if not table.num_rows:
            return schema.empty_table()
        chunk = _Chunk(table, window)
        low, high, ids, starts, step, word = chunk.proposed(_repeated(chunk, back, n))
        lead, of = _firsts(low, high)
        first = _answer(low[lead], n, back, 1)[of]
        lead = lead[of]
        again = ~(first & (ids == ids[lead]) & (starts == starts[lead]))
        step, word = step[again], word[again]
        n_words, n_removed, sha, texts = [], [], [], []
        for k, (_, w) in enumerate(chunk.parts):
            cover = np.zeros(len(w.doc) + 1, dtype=np.int64)
            at = word[step == k]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            kept = np.cumsum(cover)[:-1] == 0
            left = np.flatnonzero(kept)
            follows = np.zeros(len(left), bool)
            follows[:-1] = w.doc[left[1:]] == w.doc[left[:-1]]
            edges = np.zeros(len(w.data) + 1, dtype=np.int64)
            np.add.at(edges, w.starts[left], 1)
            np.add.at(edges, w.ends[left], -1)
            stay = np.cumsum(edges)[:-1] > 0
            out = w.data.copy()
            gap = w.ends[left[follows]]
            stay[gap] = True
            out[gap] = 32
            sizes = np.zeros(len(stay) + 1, dtype=np.int64)
            np.cumsum(stay, out=sizes[1:])
            bounds, packed = sizes[w.offsets], out[stay].tobytes()
            gone = np.bincount(w.doc[~kept], minlength=len(w.counts))
            n_words.append(w.counts)
            n_removed.append(gone)
            own = [packed[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            sha += [hashlib.sha256(x).hexdigest() for x in own]
            if with_text:
                texts += [x.decode("utf-8", "replace") for x in own]
        columns = [chunk.table.column("doc_id"), pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_removed), pa.int64()), pa.array(sha, pa.string())]
        columns += [pa.array(texts, pa.string())] * with_text + [chunk.table.column(c) for c in carried]
        return pa.table(columns, schema=pa.schema([pa.field(f.name, f.type) for f in schema]))

    return run


class SubstringDedup:
    """Removes every word covered by a window of `window` consecutive words that also starts earlier: in a smaller doc_id, or in the same document further left.

    Words are runs of other than space and \\t-\\r, taken unchanged from whole texts;
    windows are judged on the input. Null and empty texts have no words; shorter
    documents have no windows. Rows with the same doc_id are separate documents of
    that id, and where equal windows stand at the same place of both, neither is
    earlier. A null doc_id comes after all others. Tables may be empty, texts of any
    length; further columns are ignored unless carried.

    Windows are told apart by 128-bit names. Rows of the same doc_id and text are held in
    one chunk; others are spread, whatever their doc_id.
    """

    def __init__(self, window: int = 20):
        if window < 1:
            raise ValueError("a window has at least one word")
        self.window = window

    def run(self, docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256[, kept_text], carried columns), a row for each row of docs."""
        total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("n")).first()["n"]
        n_chunks, n_buckets = max(128, total // CHUNK_BYTES), max(64, total // BUCKET_BYTES)
        inner = [f"carried_{k}" for k in range(len(carry))]
        own = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(n_chunks)).alias("chunk"), *[F.col(c).alias(i) for c, i in zip(carry, inner)]
        )
        names = own.groupBy("chunk").applyInArrow(_name(self.window, n_buckets), _SENT_SQL)
        several = names.groupBy("bucket").applyInArrow(_several, _BACK_SQL)
        windows = own.groupBy("chunk").cogroup(several.groupBy("chunk")).applyInArrow(_propose(self.window, n_buckets), _SENT_SQL)
        firsts = windows.groupBy("bucket").applyInArrow(_earliest, _BACK_SQL)
        back = several.unionByName(firsts)
        out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
        if with_text:
            out.add("kept_text", T.StringType())
        for c, i in zip(carry, inner):
            out.add(i, own.schema[i].dataType)
        from pyspark.sql.pandas.types import to_arrow_schema

        result = own.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_remove(self.window, n_buckets, to_arrow_schema(out), inner, with_text), out)
        return result.withColumnsRenamed(dict(zip(inner, carry)))
