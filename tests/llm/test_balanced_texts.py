"""Texts of two symbols in balanced order, which polynomial hashes modulo a power of two take for equal."""

import numpy as np
import pytest

from kvloom.llm import minhash, repetition, substrings
from kvloom.llm import text as T

PARITY = [bin(i).count("1") & 1 for i in range(2048)]


@pytest.fixture(scope="module")
def balanced(spark):
    a = " ".join(f"u{i} {'foo' if PARITY[i] else 'bar'}" for i in range(1024))
    b = " ".join(f"u{i} {'bar' if PARITY[i] else 'foo'}" for i in range(1024))
    lines = ["".join("ab"[PARITY[i] ^ k] for i in range(1024)) for k in (0, 1)]
    return spark.createDataFrame([(0, a), (1, b), (2, "\n".join(lines)), (3, "\n".join([*lines, lines[0]]))], "doc_id long, text string")


def test_nothing_is_equal(balanced):
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(balanced).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(balanced).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert {r["doc_id"]: r["n_dup_lines"] for r in repetition.repetition(balanced).collect()} == {0: 0, 1: 0, 2: 0, 3: 1}


def test_hashes_of_sequences():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 2, dtype=np.uint64)
    for n in (256, 1024, 4096):
        parity = np.array([bin(i).count("1") & 1 for i in range(n)])
        both = np.concatenate((base[parity], base[1 - parity]))
        for seed in (0, 1):
            a, b = T.sequence_hashes(both, np.array([0, n, 2 * n]), seed)
            assert a != b and T.sequence_hashes(both[n:], np.array([0, n]), seed)[0] == b
    seen = {bytes(w): h for n in range(1, 40) for w, h in [(bytes(range(1, n + 1)), T.span_hashes(np.arange(1, n + 1, dtype=np.uint8), np.array([0]), np.array([n]))[0])]}
    assert len(set(seen.values())) == 39
    buf = np.frombuffer(b"ab abc abcdefgh abcdefghi ab abcdefghi", np.uint8)
    block = T.cut(buf, np.array([0, len(buf)]))
    h = block.hashes()
    assert h[0] == h[4] and h[3] == h[5] and len(set(h.tolist())) == 4 and not set(h.tolist()) & set(block.hashes(1).tolist())
