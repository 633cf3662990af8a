"""Vectorised word handling shared by the text operators.

These small helpers run inside Spark tasks on one Arrow batch at a time. They
work on the UTF-8 bytes of a batch with numpy, so no Python code runs per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Names are 128 bits wide: two lanes of 64 bits, each with constants of its own, that never see each other.
_SEEDS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
_FACTORS = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))
#: Text bytes handled at a time; a longer document is handled on its own.
STEP_BYTES = 1 << 19
#: Words of more bytes are named one by one.
_LONG_WORD = 256
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # keeps the first k of 8 bytes

IDENTITY = np.arange(256, dtype=np.uint8)
ASCII_LOWER = IDENTITY.copy()
ASCII_LOWER[65:91] += 32

#: Words [^\x20\x09-\x0D]+
BLANK_WORD = np.ones(256, bool)
BLANK_WORD[[32, 9, 10, 11, 12, 13]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (of lower-cased text)
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[48:58] = ALNUM_WORD[97:123] = ALNUM_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


Name = tuple[np.ndarray, np.ndarray]


def pick(name: Name, at) -> Name:
    return name[0][at], name[1][at]


def join(left: Name, right: Name) -> Name:
    """Names of ordered pairs. In each lane, no two rights give the same name after one left, and no two lefts before one right."""
    return tuple(mix(mix(a ^ seed) * factor + b) for a, b, seed, factor in zip(left, right, _SEEDS, _FACTORS))


def tagged(name: Name, tag) -> Name:
    """Names of (name, number)."""
    number = np.atleast_1d(tag).astype(np.uint64)
    return join(name, tuple(mix(number + seed) for seed in _SEEDS))


def total(name: Name, first: np.ndarray) -> Name:
    """Names of the sets name[first[k]:first[k + 1]] of distinct names, in any order: sums of the mixed names."""
    out = []
    for lane, factor in zip(name, _FACTORS):
        sums = np.zeros(len(lane) + 1, dtype=np.uint64)
        np.cumsum(mix(lane ^ factor), out=sums[1:])
        out.append(sums[first[1:]] - sums[first[:-1]])
    return tagged(tuple(out), np.diff(first))


def _word_names(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Name:
    """Names of folded[start:end], taken 8 bytes at a time."""
    sizes = ends - starts
    lanes = [mix(sizes.astype(np.uint64) * factor + seed) for seed, factor in zip(_SEEDS, _FACTORS)]
    padded = np.concatenate([folded, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(folded) + 1,), np.dtype("<u8"), padded, 0, (1,))
    long = np.flatnonzero(sizes > _LONG_WORD)
    short = np.where(sizes > _LONG_WORD, 0, sizes)
    done, active = 0, np.flatnonzero(short > 0)
    while len(active):
        chunk = eight[starts[active] + done] & _HEAD[np.minimum(short[active] - done, 8)]
        for lane, seed in zip(lanes, _SEEDS):
            lane[active] = mix(lane[active] ^ mix(chunk + seed))
        done += 8
        active = active[short[active] > done]
    if len(long):
        digests = b"".join(hashlib.blake2b(folded[a:b].tobytes(), digest_size=16).digest() for a, b in zip(starts[long], ends[long]))
        for lane, part in zip(lanes, np.frombuffer(digests, "<u8").reshape(-1, 2).T):
            lane[long] = mix(lane[long] ^ part)
    return tuple(lanes)


class Words:
    """Words of some documents: where each starts and ends in data, its document and its name."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray):
        self.data, self.offsets = data, offsets
        folded = fold[data]
        inside = is_word[folded]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # first word of each document, and the end
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.name = _word_names(folded, self.starts, self.ends)

    def windows(self, n: int) -> tuple[np.ndarray, Name]:
        """First word and name of each run of n words that stays within a document.

        A run of 2 m words is a pair of runs of m words, one of n a pair that may overlap.
        """
        count = len(self.doc) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64), (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        name, m = self.name, 1
        while 2 * m <= n:
            name, m = join(pick(name, slice(0, len(name[0]) - m)), pick(name, slice(m, None))), 2 * m
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        name = join(pick(name, at), pick(name, at + (n - m))) if m < n else pick(name, at)
        return at, tagged(name, n)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, text = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(text, np.uint8)[offsets[0] : offsets[-1]] if text is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(column: pa.Array | pa.ChunkedArray, is_word: np.ndarray, fold: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, Words]]:
    """The column in slices of about `step` bytes: the first row of the slice, and its words."""
    data, offsets = utf8(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1)
        own = offsets[row : end + 1]
        yield row, Words(data[own[0] : own[-1]], own - own[0], is_word, fold)
        row = end


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch a few rows at a time, for work that holds several times what it reads."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def by_group(keys: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal keys (0..n_groups-1) together, and where each group begins."""
    order = np.argsort(keys, kind="stable")
    return order, np.searchsorted(keys[order], np.arange(n_groups + 1))
