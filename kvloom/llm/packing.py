"""Packing token pieces into fixed windows by non-negative least squares.

A document's ids are cut at every multiple of the window; the last piece is what is left. Piece lengths make a histogram of
at most `window` rows. All combinations of up to three lengths that fill a window are enumerated, repeat counts that best
explain the histogram are solved for with non-negative least squares and rounded down, and what they leave is packed greedily, largest first.
The plan says, for each length, which run of its pieces goes to which sequences; pieces find their place by their rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvloom.llm import shared
from kvloom.llm import text as T
from kvloom.llm.tokens import DICTIONARY_BLOCK, word_ids

WINDOW = 2048
END_ID = 1
STEPS = 300
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(window: int, have: np.ndarray) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of lengths that are there and sum to the window; 0 stands for no piece."""
    a, b = np.meshgrid(np.arange(window + 1), np.arange(window + 1), indexing="ij", sparse=True)
    c = window - a - b
    a, b = np.nonzero((a >= b) & (b >= c) & (c >= 0))
    rows = np.stack([a, b, window - a - b], axis=1)
    there = have.copy()
    there[0] = True
    return rows[there[rows].all(axis=1) & (rows[:, 0] < window)]


def solve(rows: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 with rows' lengths times x close to the histogram: accelerated projected gradient, scaled by 1/sqrt(count)."""
    scale = 1 / np.sqrt(np.maximum(histogram, 1.0))
    scale[0] = 0
    weight = scale[rows]

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), weights=(weight * x[:, None]).ravel(), minlength=len(histogram))

    norm = np.ones(len(rows))
    for _ in range(12):
        image = weight * apply(norm)[rows]
        norm = image.sum(axis=1)
        size = np.linalg.norm(norm)
        norm /= max(size, 1e-30)
    step = 1 / max(1.05 * size, 1e-30)
    target = scale * histogram
    x = look = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        slope = (weight * (apply(look) - target)[rows]).sum(axis=1)
        new = np.maximum(look - step * slope, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look = new + (before - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: np.ndarray, window: int = WINDOW, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use the histogram up."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    rows = combinations(window, left > 0)
    if len(rows):
        x = np.floor(solve(rows, left, steps) + 1e-9).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if x[i] == 0:
                break
            lengths = tuple(int(v) for v in rows[i] if v)
            n = min(int(x[i]), *(int(left[v]) // lengths.count(v) for v in lengths))
            if n:
                for v in lengths:
                    left[v] -= n
                out.append((lengths, n))
    while left.any():
        lengths, space = [], window
        rest = left.copy()
        while space:
            fit = np.flatnonzero(rest[: space + 1])
            if not fit.size:
                break
            v = int(fit[-1])
            lengths.append(v)
            rest[v] -= 1
            space -= v
        n = min(int(left[v]) // lengths.count(v) for v in set(lengths))
        for v in lengths:
            left[v] -= n
        out.append((tuple(lengths), n))
    return out


def runs(patterns: list[tuple[tuple[int, ...], int]], window: int = WINDOW) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, offset), by rank."""
    used = np.zeros(window + 1, np.int64)
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, n in patterns:
        offset = 0
        for v in lengths:
            out.setdefault(v, []).append((int(used[v]), sequence, offset))
            used[v] += n
            offset += v
        sequence += n
    return {v: np.array(rows, np.int64) for v, rows in out.items()}


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of each row of documents, with the rank of each among those of its length in its task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        encoder, end = word_ids(path), np.array([end_id], "<u4")
        for batch in batches:
            for b in T.blocks(batch.column(1), DICTIONARY_BLOCK):
                ids, offsets = encoder.block(b)
                doc_ids = batch.column(0).slice(b.first, b.n).to_pylist()
                out: list[tuple] = []
                for i, doc in enumerate(doc_ids):
                    own = np.concatenate((ids[offsets[i] : offsets[i + 1]], end))
                    for start in range(0, len(own), window):
                        piece = own[start : start + window]
                        out.append((doc, start, len(piece), zlib.crc32(piece), len(own), part, int(seen[len(piece)])))
                        seen[len(piece)] += 1
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])
        encoder.forget()

    return docs.select("doc_id", "text").mapInArrow(rows, PIECES)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id, the end id included, lies in one piece; a null or empty text has its end id alone. Repeated rows are documents
    of their own, as are rows with a null doc_id. Other columns are not read, whatever their names. An empty table gives no rows. A
    very long text is encoded whole, in a block of its own, and cut at every multiple of the window. Pieces of one length are told apart by task and
    rank within the task, so a length that a third of all documents has is not gathered anywhere; to the driver goes the
    histogram only (at most `window` rows), and the plan that comes back is bounded by the window too.
    """
    table = shared.written(pieces(docs, path, window, end_id), "pieces")
    counts = table.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = counts.select("part", "length", before.alias("base"))
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    places = runs(plan(histogram, window), window)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                at = order[i:j]
                table = places[int(length[at[0]])]
                run = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                sequence[at], offset[at] = run[:, 1] + rank[at] - run[:, 0], run[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[c.split()[0] for c in PLACED.split(", ")])

    ranked = table.join(bases, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, PLACED)
