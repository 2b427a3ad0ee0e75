"""Flat token files: any bytes, byte ranges, stitching."""

import random

import numpy as np
import pytest

from kvloom.llm import separators
from kvloom.llm.queries import tokenizer


def documents(ids, end):
    """(number, start, n_tokens, ended) by a plain walk."""
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + ([(len(out), start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("width, end", [(2, 49407), (2, 10), (2, 0x0A0A), (4, 9), (4, 0x0A0B0C0D), (2, 0)])
def test_byte_ranges(spark, tmp_path, small_ranges, width, end):
    r = random.Random(width + end)
    files = []
    for f in range(6):
        if f == 0:
            ids = [r.choice([end, 7, 10, 0x0A0A, 2570, 655]) for _ in range(3000)]
        elif f == 1:  # of any bytes, so the end id stands at odd bytes too
            ids = np.frombuffer(bytes(r.choice([0, 10, 11, 12, 13, 192, 255, end & 255, end >> 8 & 255]) for _ in range(width * 20_000)), f"<u{width}").tolist()
        elif f == 2:  # begins like a text with a byte-order mark
            ids = np.frombuffer(b"\xef\xbb\xbf\x0a" + bytes(r.choice([1, 2, end & 255, end >> 8 & 255]) for _ in range(width * 5000)), f"<u{width}").tolist()
        elif f == 3:
            ids = [5] * 30_000  # one document that doesn't end
        elif f == 4:
            ids = [end] * 5000
        else:
            ids = [10] * 4000 + [end]
        files.append(ids)
        odd = b"\x01" if f == 3 else b""  # a byte that is no whole id
        (tmp_path / f"{f}.bin").write_bytes(np.array(ids, f"<u{width}").tobytes() + odd)
    (tmp_path / "empty.bin").write_bytes(b"")
    found = separators.token_counts(spark, str(tmp_path), end, width, 700).collect()
    want = [(f, *d) for f, ids in enumerate(files) for d in documents(ids, end)]
    assert sorted((int(x["file"][-5]), x["number"], x["start"], x["n_tokens"], x["ended"]) for x in found) == sorted(want)


def test_files_hold_ids_and_end_ids_only(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["one two", None, "", "x <|endoftext|> y", "größe 日本\n" * 50]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").coalesce(1)
    order = separators.write_flat(docs, path, 49407, str(tmp_path / "out"), 4)
    (file,) = (tmp_path / "out" / "kind=tokens").rglob("*.txt")
    want = [i for x in texts for i in [*(0xFFFFFFFF if y == 49407 else y for y in t.encode(x or "", add_special_tokens=False).ids), 49407]]
    assert np.frombuffer(file.read_bytes(), "<u4").tolist() == want
    assert sorted((r["number"], r["doc_id"]) for r in order.collect()) == [(i, i) for i in range(5)]


def test_ids_that_do_not_fit(spark, tmp_path):
    for end, width in ((65535, 2), (-1, 2), (5, 3), (0xBBEF, 2), (1 << 33, 4)):
        with pytest.raises(ValueError):
            separators.end_bytes(end, width)
