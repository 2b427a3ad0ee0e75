"""Texts as byte buffers: words, hashes and duplicate marks with numpy, a bounded block of documents at a time.

A word is a maximal run of characters other than space and the characters 9 to 13. UTF-8 keeps these bytes out of all
other characters, so words are cut on bytes. A null text has no words, as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that numpy handles at once. A longer document is a block of its own.
BLOCK = 2 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
U64 = np.uint64
_LIBC = ctypes.CDLL(None)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def series(n: int, seed: int) -> np.ndarray:
    """n well spread 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


BASE = U64(0xD6E8FEB86659FD93)
#: Bytes that count in the last eight of a span, by how many are left.
LEFT = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


class _Places:
    """Well spread values for places 0, 1, 2, ..., for as far as was asked; each seed has its own."""

    tables: dict[int, np.ndarray] = {}

    @classmethod
    def upto(cls, n: int, seed: int) -> np.ndarray:
        table = cls.tables.get(seed)
        if table is None or len(table) < n:
            table = cls.tables[seed] = series(max(n, 4096), 11 + seed)
        return table


def placed(values: np.ndarray, places: np.ndarray, seed: int = 0) -> np.ndarray:
    """Values mixed with their places. Sums of these stand for sequences: no pattern of values cancels out, as it can with powers of a base."""
    return mix(values ^ _Places.upto(int(places.max()) + 1 if len(places) else 1, seed)[places])


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span, the same wherever a span stands. Spans are not empty. Seeds give independent hashes."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    eights = (lens + 7) >> 3
    first = np.cumsum(eights) - eights
    inside = np.arange(int(eights.sum())) - np.repeat(first, eights)
    bytes_ = np.concatenate((buf, np.zeros(8, np.uint8)))
    at_any = np.ndarray((len(buf) + 1,), "<u8", bytes_, strides=(1,))
    value = at_any[np.repeat(starts, eights) + 8 * inside]
    value &= LEFT[np.minimum(np.repeat(lens, eights) - 8 * inside, 8)]
    return mix(np.add.reduceat(placed(value, inside, seed), first) + mix(lens.astype(U64)))


def sequence_hashes(hashes: np.ndarray, edges: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each run hashes[edges[i]:edges[i + 1]] of a sequence; an empty run has one too."""
    lens = np.diff(edges)
    inside = np.arange(len(hashes)) - np.repeat(edges[:-1] - edges[0], lens)
    # wrapping sums of 64-bit values subtract exactly
    total = np.concatenate((np.zeros(1, U64), np.cumsum(placed(hashes, inside, seed), dtype=U64)))
    return mix(total[edges[1:] - edges[0]] - total[edges[:-1] - edges[0]] + mix(lens.astype(U64)))


@dataclass
class Block:
    """Some documents: rows first to first + n of a batch, their bytes, where each starts, and their words."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray  # n + 1
    starts: np.ndarray  # of words
    ends: np.ndarray
    words: np.ndarray  # n + 1: where each document's words start

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def doc(self) -> np.ndarray:
        """Of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.words))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """Of each word."""
        return span_hashes(self.buf, self.starts, self.ends, seed)

    def keys(self, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the word sequence of each document; `hashes` are those of the words, where they are known."""
        first = self.hashes() if hashes is None else hashes
        return sequence_hashes(first, self.words).view(np.int64), sequence_hashes(self.hashes(1), self.words, 1).view(np.int64)

    def per_doc(self, weights: np.ndarray) -> np.ndarray:
        """Sums over each document of something known for each byte."""
        total = np.concatenate(([0], np.cumsum(weights, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def per_doc_words(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(weights, dtype=np.int64)))
        return total[self.words[1:]] - total[self.words[:-1]]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def cut(buf: np.ndarray, offsets: np.ndarray, first: int = 0) -> Block:
    buf, offsets = buf[offsets[0] : offsets[-1]], offsets - offsets[0]
    word = ~IS_SPACE[buf]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return Block(first, buf, offsets, starts, ends, np.searchsorted(starts, offsets))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Consecutive blocks of at most `limit` bytes, or one longer document."""
    buf, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield cut(buf, offsets[at : end + 1], at)
        at = end
    give_back()


def give_back() -> None:
    """Unused memory goes back to the system: a worker outlives its task, and the next may need the memory elsewhere."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, by its first word. len(hashes) - n + 1 of them; the caller drops those that cross documents."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    out, done = hashes.copy(), 1
    result, left = None, n
    # windows of n words from windows of powers of two words
    at = 0
    while left:
        if left & 1:
            part = out[at : at + count]
            result = part.copy() if result is None else mix(result * U64(0x9E3779B97F4A7C15) + part)
            at += done
        left >>= 1
        if left:
            out = mix(out[: len(out) - done] * BASE + out[done:])
            done *= 2
    return mix(result + U64(n))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key whether it occurs twice or more, and whether an equal one stands before it."""
    both, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later[order[1:]] = same
        both[order[1:]] |= same
        both[order[:-1]] |= same
    return both, later
