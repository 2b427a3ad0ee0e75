"""Fingerprints: what peeling recovers, from sketches alone and with retries."""

import random

import pytest
from pyspark.sql import functions as F

from kvloom.llm import paragraphs


def shown(k):
    return [f"Paragraph {i} says {i * i}." for i in k]


def test_differing_digests_come_from_two_fingerprints(spark):
    versions = [shown(range(60)), shown([*range(20), 100, *range(21, 60)]), shown([*range(60), 200, 201]), shown(range(500, 900)), [], shown(range(60))]
    docs = spark.createDataFrame([(i, "\n".join(v)) for i, v in enumerate(versions)], "doc_id long, text string")
    prints = paragraphs.fingerprints(docs).select("doc_id", "fingerprint")
    pairs = prints.filter("doc_id = 0").withColumnRenamed("fingerprint", "a").drop("doc_id").join(prints.withColumnRenamed("fingerprint", "b"))
    got = {r["doc_id"]: r["d"] for r in pairs.select("doc_id", paragraphs.differing("a", "b").alias("d")).collect()}
    digest = lambda lines: sorted(r[0] for r in spark.createDataFrame([(x,) for x in lines], "p string").select(F.xxhash64("p")).collect())
    for i in (0, 1, 2, 5):
        alone = [x for x in versions[0] if x not in versions[i]], [x for x in versions[i] if x not in versions[0]]
        assert sorted(got[i]["p"]) == digest(alone[0]) if alone[0] else not got[i]["p"]
        assert sorted(got[i]["m"]) == digest(alone[1]) if alone[1] else not got[i]["m"]
    assert got[3] is None and got[4] is None  # too many differ for a sketch of that size


@pytest.mark.parametrize("common, alone", [(10, 0), (300, 5), (300, 40), (50, 700), (0, 3000)])
def test_larger_sketches_recover_every_difference(spark, common, alone):
    r = random.Random(common + alone)
    keys = [r.randrange(-(1 << 63), 1 << 63) for _ in range(common + 2 * alone)]
    a, b = keys[: common + alone], keys[:common] + keys[common + alone :]
    row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    items, sketches = [paragraphs._items(c) for c in "ab"], [paragraphs.sketch(f"v.{c}") for c in "ab"]
    d = row.select(F.expr(paragraphs.let("v", f"named_struct('a', {items[0]}, 'b', {items[1]})", paragraphs.difference("v", *sketches))).alias("d")).first()["d"]
    assert sorted(d["p"]) == sorted(a[common:]) and sorted(d["m"]) == sorted(b[common:])
    one = row.select(F.expr(paragraphs.peeled(paragraphs.subtracted(paragraphs.sketch(paragraphs._items("a")), paragraphs.sketch(paragraphs._items("b"))))).alias("d")).first()["d"]
    assert alone < 40 or one["left"]  # the first sketch is too small, so retries were made


def test_rows_without_a_following_document(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    docs = spark.createDataFrame([(None, "One. Two."), (None, None), (low, "One. Two."), (high, "\t\t\n \t")], "doc_id long, text string").withColumn("worked", F.lit(1)).withColumn("lead", F.lit("x"))
    got = {(r["doc_id"], r["n_chars"]): (r["near_edited"], r["near_next"]) for r in paragraphs.fingerprints(docs).collect()}
    # "One. " and "One. \t\t\n " have one paragraph of two; white space alone has none
    assert got == {(None, 9): (0.5, 0.0), (None, 0): (1.0, 1.0), (low, 9): (0.5, 0.0), (high, 5): (0.0, 0.0)}
