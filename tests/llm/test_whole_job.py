"""What the operators must not leave out."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from kvloom.llm import licenses, perplexity, separators
from kvloom.llm.queries import tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts):
    """Interpolated modified Kneser-Ney over characters of running text."""
    n = perplexity.ORDER
    counts = {n: Counter(g for t in texts for g in grams(t))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    info = {}
    for k, c in counts.items():
        t = Counter(c.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0
        d = [max(0.1, min(i - 0.1, i - (i + 1) * y * t[i + 1] / t[i] if t[i] and t[1] else 0.5 * i)) for i in (1, 2, 3)]
        total, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
        for g, x in c.items():
            total[g[:-1]] += x
            kinds[g[:-1]][min(x, 3) - 1] += 1
        info[k] = (c, d, total, kinds)

    def p(g):
        if not g:
            return 1 / perplexity.ALPHABET
        c, d, total, kinds = info[len(g)]
        x, context = c[g], g[:-1]
        if not total[context]:
            return p(g[1:])
        return (max(x - d[min(x, 3) - 1], 0) / total[context] if x else 0) + sum(a * b for a, b in zip(d, kinds[context], strict=True)) / total[context] * p(g[1:])

    return p


def grams(text):
    n, words = perplexity.ORDER, WORDS.findall(text)
    q = perplexity.BEFORE * (n - 1) + " ".join(words) + perplexity.AFTER
    return [q[i : i + n] for i in range(len(q) - n + 1)] if words else []


def test_perplexity_of_running_text(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "größe", "日本", "of", "a"]
    texts = ["".join(r.choice(words) + r.choice([" ", "\n ", "\t"]) for _ in range(r.randrange(0, 60))) for _ in range(30)] + ["", "beta " * 40, "x\u00a0y 日 " * 9]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    trusted = docs.filter("doc_id < 20").select("lang", "text")
    p = plain(texts[:20])
    got = {x["doc_id"]: x for x in perplexity.scores(docs, *perplexity.model(trusted, running=True), running=True).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n"] == len(grams(t)) and got[i]["logp"] == pytest.approx(sum(math.log(p(g)) for g in grams(t)), rel=1e-4)


def test_numbers_of_grams_by_table_and_by_sort(monkeypatch):
    units = ["beta alpha", "größe 日本", "a", "beta beta"]
    for limit in (perplexity.TABLE, 1):
        monkeypatch.setattr(perplexity, "TABLE", limit)
        of, edges, names = perplexity.grams_of(units)
        assert len(set(names)) == len(names)
        for i, u in enumerate(units):
            assert [names[j] for j in of[edges[i] : edges[i + 1]]] == grams(u)


def test_repeated_and_misplaced_words_are_rejected(spark):
    cycle = ["the", "river", "carries", "old", "stones", "down", "from", "high", "mountains"]
    turn = lambda k, n: " ".join(cycle[(k + i) % len(cycle)] for i in range(n))
    good = [turn(k, 60 + k) for k in range(60)]
    bad = ["river " * 80, "the " * 100, " ".join(reversed(turn(0, 90).split()))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["kept"] for x in perplexity.classify(docs, labels).collect()}
    assert [got[i] for i in range(60)] == [True] * 60 and [got[60 + i] for i in range(3)] == [False] * 3


def test_order_of_the_classifier():
    assert perplexity.ORDER >= 5  # four characters saturate: too little of the corpus goes into the model


def test_threshold_is_near_the_quantile(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice(["stone", "river", "of", "old", "the"]) for _ in range(r.randrange(20, 90))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = perplexity.classify(docs, labels).collect()
    assert max(x["perplexity"] for x in got) <= got[0]["threshold"] <= 1.06 * max(x["perplexity"] for x in got)


def every_notice(text):
    """Notices that stand word for word: the longest at any place first, then what is left."""
    words, names = [w for w in map(licenses.normal, text.split()) if w], {n: [w for w in map(licenses.normal, t.split()) if w] for n, t in licenses.NOTICES.items()}
    out = Counter()
    for name, notice in sorted(names.items(), key=lambda x: (-len(x[1]), x[0])):
        for i in range(len(words) - len(notice) + 1):
            if words[i : i + len(notice)] == notice:
                out[name] += 1
                words[i : i + len(notice)] = [""] * len(notice)
    return out


def test_notices_beside_near_misses():
    scanner, r = licenses.Scanner(licenses.NOTICES), random.Random(7)
    filler = lambda n: " ".join(r.choice(["plain", "words", "stand", "here"]) for _ in range(n))
    n = licenses.NOTICES
    miss = [n["LGPL-3.0"].replace("3", "2.1"), n["GPL-3.0"].replace("3", "1"), n["AGPL-3.0"].replace("3", "2"), "Licensed under CC BY-NC 3.0.", "Licensed under CC BY-SA 2.0.", "Licensed under the Apache License, Version 1.1."]
    texts = [f"{miss[0]} {filler(19)} {n['MIT']} {filler(19)}", f"{miss[1]} {filler(19)} {n['MIT']} {filler(19)}", f"{miss[0]} {miss[1]} {miss[2]} {n['CC0-1.0']}"]
    texts += [" ".join(x for _ in range(r.randrange(1, 5)) for x in (r.choice(miss + list(n.values())), filler(r.randrange(0, 25)))) for _ in range(150)]
    for t in texts:
        assert Counter(x[0] for x in scanner.scan(t)[1]) == every_notice(t), t


def test_recall_of_altered_notices():
    """Long notices with as many words changed as may differ are found with that number, and none with twice as many."""
    scanner, r = licenses.Scanner(licenses.NOTICES), random.Random(11)
    filler = lambda n: " ".join(r.choice(["plain", "words", "stand", "here"]) for _ in range(n))
    found = tried = 0
    for name, notice in licenses.NOTICES.items():
        words = notice.split()
        limit = int(licenses.SLACK * len(scanner.words[name]))
        if len(scanner.words[name]) < 20:
            continue
        for _ in range(6):
            for n in {1, limit} - {0}:
                changed = list(words)
                for i in r.sample([i for i, w in enumerate(words) if not any(c.isdigit() for c in w) and licenses.normal(w)], n):
                    changed[i] = "changed"
                hits = scanner.scan(f"{filler(30)} {' '.join(changed)} {filler(30)}")[1]
                tried += 1
                found += any(h[0] == name and h[3] <= 2 * n for h in hits)
            over = list(words)
            for i in r.sample(range(len(words)), 3 * limit + 3):
                over[i] = "changed"
            assert not any(h[0] == name for h in scanner.scan(f"{filler(30)} {' '.join(over)} {filler(30)}")[1])
    assert tried > 60 and found >= 0.95 * tried


def test_end_markers_within_texts(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["a b c", "abc <|endoftext|> def", "one two", "<|endoftext|>", "x<|endoftext|><|endoftext|>y z", "", "the last of them"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {x["doc_id"]: x["n_tokens"] for x in separators.counts_of_documents(docs, path, 49407).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert t.get_vocab_size() <= separators.inner_id(2)
