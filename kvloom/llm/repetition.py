"""Quality rules by repetition coverage: how many of a text's characters lie in n-grams and lines that it has said before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kvloom.llm import text as T

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: n-gram length: largest share of word characters in repeats of n-grams said before.
NGRAM_LIMITS = {3: 0.45, 5: 0.35, 8: 0.30, 12: 0.30}
LINE_LIMIT = 0.35
MIN_WORDS = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAM_LIMITS))
SCHEMA = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean"])


def measure(b: T.Block) -> dict[str, np.ndarray]:
    """Counts of each document of a block. Equal hashes (64 bits, salted by document) count as equal n-grams and lines."""
    doc = b.doc()
    salt = T.mix(np.arange(b.n, dtype=np.uint64) + np.uint64(0x5DEECE66D))
    points = (b.buf & 0xC0) != 0x80
    to = np.concatenate(([0], np.cumsum(points, dtype=np.int64)))
    chars = to[b.ends] - to[b.starts]
    out = {"n_words": np.diff(b.words), "word_chars": b.per_doc_words(chars), "n_symbols": b.per_doc(SYMBOLS[b.buf])}

    hashes = b.hashes()
    for n in sorted({3, *NGRAM_LIMITS}):
        keys = T.windows(hashes, n)
        whole = doc[: len(keys)] == doc[n - 1 :] if len(keys) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        both, later = T.repeated(keys[at] ^ salt[doc[at]])
        if n == 3:
            out["n_repeat_words"] = b.per_doc_words(_under(at[both], n, len(hashes)))
        if n in NGRAM_LIMITS:
            out[f"dup_{n}gram_chars"] = b.per_doc_words(np.where(_under(at[later], n, len(hashes)), chars, 0))

    ends_line = b.buf == 10
    cuts = np.unique(np.concatenate((np.flatnonzero(ends_line) + 1, b.offsets)))
    start, end = cuts[:-1], cuts[1:]
    end = end - ends_line[end - 1] if len(end) else end
    words_in = np.searchsorted(b.starts, end) - np.searchsorted(b.starts, start)
    start, end = start[words_in > 0], end[words_in > 0]
    line_doc = np.searchsorted(b.offsets, start, side="right") - 1
    _, later = T.repeated(T.span_hashes(b.buf, start, end) ^ salt[line_doc])
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=b.n)
    first, last = np.searchsorted(b.starts, start[later]), np.searchsorted(b.starts, end[later])
    of_words = np.concatenate(([0], np.cumsum(chars)))
    out["dup_line_chars"] = np.bincount(line_doc[later], weights=of_words[last] - of_words[first], minlength=b.n).astype(np.int64)
    return out


def _under(first: np.ndarray, n: int, total: int) -> np.ndarray:
    if not len(first):
        return np.zeros(total, bool)
    change = np.bincount(first, minlength=total + 1) - np.bincount(first + n, minlength=total + 1)
    return np.cumsum(change[:-1]) > 0


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    chars = np.maximum(m["word_chars"], 1)
    good = m["dup_line_chars"] <= LINE_LIMIT * chars
    for n, limit in NGRAM_LIMITS.items():
        good &= m[f"dup_{n}gram_chars"] <= limit * chars
    return failed, ~failed & good


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for b in T.blocks(batch.column(1)):
            m = measure(b)
            m["base_failed"], m["kept"] = verdict(m)
            yield pa.RecordBatch.from_arrays([ids.slice(b.first, b.n), *[pa.array(m[k], pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k in names[1:]]], names=names)


def repetition(docs: DataFrame) -> DataFrame:
    """One row for each row of documents: counts, coverage and verdict.

    Reads doc_id and text only, whatever other columns there are. A null or empty text has no words: zeros, base_failed true,
    kept false. n-grams and lines of one text are equal if their 64-bit hashes are. Rows are judged one by one, so repeated rows give repeated results and an empty table an empty one.
    A very long text is one block; memory follows the longest text. There is no shuffle.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _rows(batches, names), SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """Rows of documents that the rules keep, with all their columns and in one pass: texts do not move.

    The verdict is a boolean function of the text alone, so rows with a null doc_id are judged like others.
    """
    columns = docs.columns

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        for batch in batches:
            good = [verdict(measure(b))[1] for b in T.blocks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(chosen, docs.schema)
