"""The pipeline's stages against plain recomputations, on a small corpus with nulls, copies, junk and clashing column names."""

import math
import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_text_ops import classes, removed
from test_whole_job import grams, plain

import corpus_pipeline
from kvloom.llm import licenses, minhash, oracles, packing, paragraphs, perplexity, pieces, repetition, separators, shared, substrings
from kvloom.llm.queries import tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside.
CLASHING = "rejected later kept text_ list key key2 gram lang_ shard task number data block file ends band bands label node first last window owner class_id doc c0 n words perplexity threshold host rule one_".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(21)
    syllables = ["the", "of", "and", "er", "ing", "on", "st", "re", "al", "ti"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    text = lambda n: " ".join(word() + r.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))
    passage = text(70)
    texts = [text(r.randrange(55, 200)) for _ in range(90)]
    texts[5] = texts[40]
    texts[6] = texts[41].replace(" the ", " of ", 1)
    texts[50], texts[60] = f"{texts[50]} {passage}", f"{passage} {texts[60]}"
    texts += ["".join(r.choice("qxzj#$%&") + r.choice(" qz") for _ in range(300)) for _ in range(6)]
    texts += ["the river of stones " * 60, "of " * 200, "short text", "", None, text(3000)]
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)]
    rows += [rows[7], (None, texts[8], "en"), (None, None, None)]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHING)
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*x, *[c for c in CLASHING]) for x in rows], schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 80)] + [(i, 0, 0) for i in range(90, 93)] + [(3, 1, 0), (85, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect() if r["doc_id"] is not None)


def judged(rows, trusted_ids):
    """Plain perplexity steps and limits: {row number: (step, limit)}."""
    by_lang = defaultdict(list)
    for n, (i, t, lang) in enumerate(rows):
        by_lang[lang or ""].append((n, i, t or ""))
    out = {}
    for own in by_lang.values():
        p = plain([t for _, i, t in own if i in trusted_ids])
        scored = {n: (sum(math.log(p(g)) for g in grams(t)), len(grams(t))) for n, _, t in own}
        mine = [scored[n] for n, i, t in own if i in trusted_ids and scored[n][1]]
        mean = -sum(s for s, _ in mine) / sum(k for _, k in mine)
        step = lambda s, k: math.floor((-s + perplexity.PRIOR * mean) / (k + perplexity.PRIOR) / perplexity.STEP)
        steps = sorted(step(s, k) for s, k in mine)
        limit = math.floor(steps[math.ceil(perplexity.QUANTILE * len(steps)) - 1] + math.log(perplexity.MARGIN) / perplexity.STEP)
        out |= {n: (step(*scored[n]), limit) for n, _, _ in own}
    return out


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    want = judged(rows, set(range(80)))
    got = {(r["doc_id"], r["lang"]): r for r in perplexity.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r["doc_id"] is not None}
    for n, (i, _, lang) in enumerate(rows):
        if i is not None:
            step, limit = want[n]
            assert abs(math.log(got[i, lang or ""]["perplexity"]) / perplexity.STEP - step) <= 1.01 and abs(math.log(got[i, lang or ""]["threshold"]) / perplexity.STEP - limit) <= 1.01
    one = shared.written(stages["quality classifier"](spark, docs, folder), "stage")
    gone = {i for n, (i, _, _) in enumerate(rows) if i is not None and want[n][0] > want[n][1] + 2}
    near = {i for n, (i, _, _) in enumerate(rows) if i is not None and abs(want[n][0] - want[n][1]) <= 2}
    left = set(ids(one))
    assert one.columns == columns and gone >= set(range(90, 96)) and not left & gone and {i for i, _, _ in rows if i is not None} - gone - near <= left
    assert one.filter("doc_id IS NULL").count() == 2

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r["doc_id"], r["text"]) for r in one.select("doc_id", "text").collect()])
    two = shared.written(stages["quality rules"](spark, one, folder), "stage")
    assert two.columns == columns and ids(two) == sorted(x[0] for x in con.execute(f"SELECT doc_id FROM ({oracles.repetition_sql()}) WHERE kept AND doc_id IS NOT NULL").fetchall())

    texts = {r["doc_id"]: r["text"] for r in two.select("doc_id", "text").collect() if r["doc_id"] is not None}
    order = sorted(texts)
    groups = classes([texts[i] for i in order], minhash.SIMILARITY)
    firsts = {order[g // 3] for g in groups.values()}
    three = shared.written(stages["near duplicates"](spark, two, folder), "stage")
    assert three.columns == columns and set(ids(three)) == firsts and not {40, 41} & firsts and three.filter("doc_id IS NULL").count() == 1

    order = sorted(firsts)
    cut = removed([texts[i] for i in order], 50)
    four = shared.written(stages["repeated passages"](spark, three, folder), "stage")
    assert four.columns == columns and sum(v[1] for v in cut.values()) >= 70
    for r in four.select("doc_id", "text").collect():
        if r["doc_id"] is not None:
            _, n, kept = cut[order.index(r["doc_id"]) * 3]
            assert r["text"] == (kept if n else texts[r["doc_id"]])

    five = stages["packing"](spark, four, folder).collect()
    per_doc = defaultdict(list)
    for r in five:
        per_doc[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    assert set(per_doc) - {None} == firsts
    for i, parts in per_doc.items():
        if i not in (7, None):  # row 7 stands there twice
            at = 0
            for start, length, _ in sorted(parts):
                assert start == at
                at += length
            assert at == parts[0][2]
    run = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in run) == sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in five)


def test_stages_on_an_empty_table(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_operators_on_odd_tables(spark, corpus):
    """Clashing names, null ids and texts, repeated rows: a result for every row; an empty table: none."""
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    words, piece_model = tokenizer("word_bpe_49k.json"), tokenizer("piece_bpe_32k.model")
    operators = [
        repetition.repetition, paragraphs.fingerprints, licenses.scan, substrings.remove_repeats, minhash.near_duplicates,
        lambda d: packing.pack(d, words).filter("start = 0"), lambda d: separators.counts_of_documents(d, words, 49407), lambda d: pieces.encode(d, piece_model),
        lambda d: perplexity.classify(d, spark.read.parquet(f"{folder}/labels.parquet")),
    ]
    for operator in operators:
        assert sorted(str(r["doc_id"]) for r in operator(docs).select("doc_id").collect()) == sorted(str(r[0]) for r in rows)
        assert operator(docs.limit(0)).count() == 0


def test_tables_go_after_use(spark, corpus):
    folder, _ = corpus
    shared_dir = Path(shared.folder(spark).removeprefix("file://"))
    before = {p.name for p in shared_dir.iterdir()}
    minhash.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")).count()
    assert len({p.name for p in shared_dir.iterdir()} - before) == 1  # the classes that the result reads
    corpus_pipeline.run(spark, folder)
    assert sorted(n.partition("-")[0] for n in {p.name for p in shared_dir.iterdir()} - before) == ["classes", "packed"]
