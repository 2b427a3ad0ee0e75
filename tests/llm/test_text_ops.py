"""Operators on texts against brute force, on fixtures with nulls, empty and long texts, repeated rows, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvloom.llm import licenses, minhash, packing, paragraphs, pieces, repetition, separators, substrings
from kvloom.llm.queries import tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key long, label string"


def made(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["the", "of", "thin", "er", "ánd", "größe", "日本", "x#y", "don't", "OF!!", "|", "a\u00a0b"] + [f"w{i}" for i in range(200)]
    text = lambda k: " ".join(r.choice(vocabulary) + r.choice(["", "", ".", ",", ".\n", "  "]) for _ in range(k))
    passage = text(80)
    out = [text(r.randrange(1, 150)) for _ in range(n)]
    out[3], out[9] = passage + " " + text(30), text(20) + "\n" + passage
    base = text(300)
    out[11:17] = [base, base, base.replace("w5 ", "w6 "), base + " tail", "head " + base, base.upper()]
    out += [None, "", "   \n ", None, "Same line here.\n" * 30, "a", text(20_000), "z" * 5000, "\x00 \x1c ▁ \ufeff", " ".join(base.split()[:200]), " ".join(base.split()[100:])]
    return out


@pytest.fixture(scope="module")
def texts():
    return made()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, ["en", "de", None][i % 3], "s", 1, 2, 3, "q") for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[11], "en", "s", 1, 2, 3, "q"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r for r in df.collect() if r["doc_id"] is not None]


def by_id(df):
    return {r["doc_id"]: r for r in rows_of(df)}


def test_repetition(docs, empty, texts):
    got = by_id(repetition.repetition(docs))
    assert repetition.repetition(docs).count() == docs.count() and repetition.repetition(empty).count() == 0
    for i, t in enumerate(texts):
        w = WORDS.findall(t or "")
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        r = got[i * 3]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["kept"] and r["base_failed"])
        for n in repetition.NGRAM_LIMITS:
            seen, late = set(), set()
            for j in range(len(w) - n + 1):
                g = tuple(w[j : j + n])
                late |= set(range(j, j + n)) if g in seen else set()
                seen.add(g)
            assert r[f"dup_{n}gram_chars"] == sum(len(w[k]) for k in late)
    kept = repetition.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in rows_of(kept)} == {i for i, r in got.items() if r["kept"]}


def test_packing(docs, empty, texts):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    assert packing.pack(empty, path).count() == 0
    sequences, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            ids = np.array([*t.encode(texts[r["doc_id"] // 3] or "", add_special_tokens=False).ids, 1], "<u4")
            assert len(ids) == r["doc_tokens"] and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            seen[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    for doc, parts in seen.items():
        assert sum(p[1] for p in parts) == parts[0][2] * (2 if doc == 15 else 1)  # row 5 stands there twice


def test_plan_uses_the_histogram_up_with_little_padding():
    r = np.random.default_rng(1)
    histogram = np.bincount(np.clip(r.lognormal(5.5, 1.0, 20_000).astype(int), 1, 2048), minlength=2049)
    patterns = packing.plan(histogram)
    used = np.zeros(2049, int)
    for lengths, n in patterns:
        assert sum(lengths) <= 2048
        for v in lengths:
            used[v] += n
    assert (used == histogram).all()
    total = sum(n for _, n in patterns) * 2048
    assert (total - (histogram * np.arange(2049)).sum()) / total < 0.005


def test_fingerprints(spark, docs, empty, texts):
    got = by_id(paragraphs.fingerprints(docs))
    assert paragraphs.fingerprints(empty).count() == 0 and paragraphs.fingerprints(docs).count() == docs.count()
    cut = lambda t: {p for p in re.split(r"(?<=[.!?])[ \t\r]+|\n+", t) if WORDS.search(p)}
    prints = {}
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        r = got[i * 3]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(cut(t), cut(edited))) and r["near_next"] == pytest.approx(like(cut(t), cut(following)))
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert by_id(paragraphs.fingerprints(docs.filter("doc_id = 9")))[9]["near_next"] == 1.0


def test_separators(docs, empty, texts):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = by_id(separators.counts_of_documents(docs, path, 49407))
    assert {i: r["n_tokens"] for i, r in got.items()} == {i * 3: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert separators.counts_of_documents(empty, path, 49407).count() == 0


def test_licenses(spark, empty):
    n = licenses.NOTICES
    long = n["MIT permission"]
    rows = {
        1: ("Words before. Released under the MIT License. And after", "MIT"), 2: ("licensed under cc by-nc 4.0", "CC-BY-NC-4.0"), 3: ("Licensed under CC BY-NC 3.0.", ""),
        4: (f"x {long} y. Licensed under the Apache License, Version 2.0. z", "Apache-2.0,MIT permission"), 5: (long.replace("charge", "cost"), "MIT permission"), 6: (long.replace("use, copy, modify, merge, publish", "read"), ""),
        7: (None, ""), 8: ("", ""), 9: ("a license of no known kind " * 500, ""), 10: ("w " * 3000 + n["GPL-3.0"] + " w" * 3000, "GPL-3.0"), 11: ((n["MIT"] + "\n") * 3, "MIT"), 12: (n["Apache-2.0 header"], "Apache-2.0 header"),
        13: ("Distributed under the MIT licence, they say", "MIT"), 14: ("Released under the BSD License", ""), 15: ("// SPDX-License-Identifier: BSD-3-Clause\nint x;", "BSD-3-Clause identifier"), 16: ("This program is licensed under the GNU General Public License v 3", "GPL-3.0"),
    }
    docs = spark.createDataFrame([(i, t, "s") for i, (t, _) in rows.items()], "doc_id long, text string, licenses string")
    got = by_id(licenses.scan(docs))
    assert {i: r["licenses"] for i, r in got.items()} == {i: want for i, (_, want) in rows.items()}
    assert got[11]["n_found"] == 3 and got[5]["spans"][0]["n_differences"] == 1 and got[1]["spans"][0]["first"] == 2
    assert licenses.scan(empty).count() == 0
    assert all(re.search(licenses.telling(n), t) for t in n.values())
    own = licenses.scan(docs.select("doc_id", F.lit("all rights are kept by Zaphod").alias("text")), {"own": "All rights are kept by Zaphod"}).first()
    assert own["n_found"] == 1


def removed(texts, window):
    first, out = {}, {}
    words = {i: WORDS.findall(t or "") for i, t in enumerate(texts)}
    for i, w in words.items():
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    for i, w in words.items():
        gone = {k for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i for k in range(j, j + window)}
        out[i * 3] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("limit", [512, 1])
def test_substrings(docs, empty, texts, limit, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_LIMIT", limit)  # with 1 all that differ goes by windows
    got = {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in by_id(substrings.remove_repeats(docs)).items()}
    assert got == removed(texts, 50) and sum(v[1] for v in got.values()) > 500
    assert substrings.remove_repeats(empty).count() == 0 and substrings.remove_repeats(docs).count() == docs.count()


def test_strip_keeps_columns_and_other_texts(docs, texts):
    out = substrings.strip_repeats(docs)
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    want = removed(texts, 50)
    for i, r in by_id(out).items():
        assert r["text"] == (want[i][2] if want[i][1] else texts[i // 3])


def test_automaton():
    r = random.Random(1)
    a, parts = substrings.Automaton(), []
    for _ in range(30):
        part = [r.randrange(3) for _ in range(r.randrange(1, 30))]
        query = [r.randrange(3) for _ in range(40)]
        stats = a.statistics(query)
        for end in range(1, 41):
            has = lambda s: any(s == p[i : i + len(s)] for p in parts for i in range(len(p)))
            best = max((k for k in range(1, end + 1) if has(query[end - k : end])), default=0)
            assert stats[end - 1] == best
        a.add(part)
        parts.append(part)


def test_pieces(docs, empty, texts):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(pieces.encode(docs, path))
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_eos=True)
        assert (got[i * 3]["n_tokens"], got[i * 3]["ids"], got[i * 3]["decoded"]) == (len(ids), " ".join(map(str, ids)), lib.decode(ids))
    assert pieces.encode(empty, path).count() == 0
    r, model = random.Random(4), pieces.pieces(path)
    for _ in range(3000):
        t = "".join(r.choice("abcdehinorstuüé日_-.  ▁\n😀") for _ in range(r.randrange(1, 30)))
        assert model.decode(lib.encode(t)) == lib.decode(lib.encode(t))
        assert [i for c in re.findall(r"\n|▁*[^▁\n]+|▁+", "▁" + t.replace(" ", "▁")) for i in map(int, model._payloads([c.replace("▁", " ")])[0].split())] == lib.encode(t)


def classes(texts, similarity):
    sets = {}
    for i, t in enumerate(texts):
        w = WORDS.findall(t or "")
        if w:
            sets[i] = (w, Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or Counter([tuple(w)]))
    top = {i: i for i in range(len(texts))}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (sets[i][0] == sets[j][0] or (sets[i][1] & sets[j][1]).total() >= similarity * (sets[i][1] | sets[j][1]).total() - 1e-9):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i * 3: find(i) * 3 for i in top}


def test_near_duplicates(spark, docs, empty, texts):
    got = by_id(minhash.near_duplicates(docs))
    assert {i: r["class_id"] for i, r in got.items()} == classes(texts, 0.8)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.near_duplicates(docs).count() == docs.count()
    one = minhash.one_of_each(docs)
    assert one.columns == docs.columns and {r["doc_id"] for r in rows_of(one)} == set(classes(texts, 0.8).values())


def test_near_duplicates_of_one_passage(spark):
    r = random.Random(9)
    word = lambda: f"v{r.randrange(10**6)}"
    passage = [word() for _ in range(100)]
    texts = [" ".join(passage + [word() for _ in range(r.choice([8, 15, 40]))]) for _ in range(60)]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {i: x["class_id"] for i, x in by_id(minhash.near_duplicates(docs)).items()} == classes(texts, 0.8)


def test_signatures_agree_by_weighted_similarity():
    r = np.random.default_rng(3)
    universe = minhash.T.series(400, 9)
    a, b = r.integers(0, 4, 400).astype(float), r.integers(0, 4, 400).astype(float)
    b[:250] = a[:250]
    for x, y, weights in ((a, b, True), (a > 0, b > 0, False)):
        elements = np.concatenate((universe[x > 0], universe[y > 0]))
        owner = np.concatenate((np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)))
        w = np.concatenate((x[x > 0], y[y > 0])) if weights else None
        s = minhash.signatures(elements, owner, 2, 4000, w)
        want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
        assert abs((s[0] == s[1]).mean() - want) < 0.03
    assert (minhash.signatures(universe[:1], np.zeros(1, int), 3, 64)[1:] == 0).all()
