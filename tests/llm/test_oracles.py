"""Queries that SQL can express, against their SQL."""

import random

import duckdb
import pytest

from kvloom.llm import linkgraph, oracles, repetition, substrings
from kvloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def rows_of(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.column_names)
    return sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))), sorted(map(str, (tuple(r[c] for c in columns) for r in want.to_pylist())))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = rows_of(QUERIES[name](spark, SF), con.execute(ORACLES[name]).to_arrow_table())
    assert got == want


def test_rules_and_walks_on_a_graph_with_links(spark):
    """At the size of the query's own tables: hosts that link across, rules that fit, null urls."""
    r = random.Random(8)
    hosts = [f"h{i}.net" for i in range(60)] + [f"a{i}.org" for i in range(8)] + [f"c{i}.com" for i in range(8)] + ["example.org", "www.example.org"]
    path = lambda: r.choice(["/de/1", "/fr/2", "/es/3", "/en/17", "", "/x?q#f"])
    pages = [(i, f"http://{r.choice(hosts)}{path()}", "".join(f"<a href='https://{r.choice(hosts).upper()}/y'>" for _ in range(r.randrange(3))) + f"&copy; {r.choice(hosts)}") for i in range(250)]
    pages += [(900, None, "<a href='//h1.net/'>"), (901, "no scheme", None), (902, "x://", "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    want = con.execute(oracles.linkgraph_sql()).to_arrow_table().to_pylist()
    got = {x["page_id"]: x for x in linkgraph.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(want) == len(got)
    for w in want:
        g = got[w["page_id"]]
        assert (g["host"], g["path"], g["rule"]) == (w["host"], w["path"], w["rule"])
        assert g["trust"] == pytest.approx(w["trust"], rel=1e-2, abs=1e-5) and g["distrust"] == pytest.approx(w["distrust"], rel=1e-2, abs=1e-5)
        if w["rule"] or abs(w["distrust"] - 2 * w["trust"]) > 0.05 * w["distrust"]:
            assert g["verdict"] == w["verdict"]
    assert len({w["verdict"] for w in want if not w["rule"]}) == 2


def test_texts_in_sql(spark):
    from test_text_ops import made

    texts = made(7)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    texts = [t if t is None else t.replace("\x00", "0") for t in texts]
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, want = rows_of(repetition.repetition(docs), con.execute(oracles.repetition_sql()).to_arrow_table())
    assert got == want
    from pyspark.sql import functions as F

    done = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    got, want = rows_of(done, con.execute(oracles.substrings_sql()).to_arrow_table())
    assert got == want
