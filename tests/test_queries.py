"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

from kvloom.operators import sketches
from kvloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF)
    want = sql.execute(ORACLES[name]).to_arrow_table()
    assert sorted(got.columns) == sorted(want.column_names)
    columns = sorted(got.columns)
    rows = sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect())))
    assert rows == sorted(map(str, (tuple(r[c] for c in columns) for r in want.to_pylist())))


@pytest.mark.parametrize("inline", [True, False])
def test_bloom_filter_of_many_keys(spark, tmp_path, monkeypatch, inline):
    """The filter grows with its keys, tested inside the rows and joined."""
    if not inline:
        monkeypatch.setattr(sketches, "INLINE_BITS", 0)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (event_id + i * 100000 AS event_id, user_id + i * 100000 AS user_id) FROM '{SF}/events.parquet', range(400) t(i)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(ORACLES["q19_bloom_no_false_negative"]).fetchall()
    assert want[0][0] > 25_000
    assert list(map(tuple, QUERIES["q19_bloom_no_false_negative"](spark, str(tmp_path)).collect())) == want
