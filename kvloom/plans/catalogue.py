"""Queries over the driver tables, one or more for each operator, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.config import Options
from kvloom.functions.handlers import handler_udf
from kvloom.functions.hooks import Hooks, published
from kvloom.operators import log as L
from kvloom.operators import maintenance, reads, sketches
from kvloom.operators import stats as st
from kvloom.operators.fold import latest
from kvloom.sources import files, rawlog
from kvloom.sources.ship import ship
from kvloom.sources.store import open_store
from kvloom.sources.wal import Wal, wal_offsets
from kvloom.streaming.incremental import fold_available
from kvloom.streaming.pubsub import deliveries, subscribers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Log and state of `events` in DuckDB: l all records, live the last puts.
BASE = """WITH l AS (
  SELECT event_id AS seq, event_type AS bucket, 'u' || user_id AS k, CASE WHEN event_id % 7 = 0 THEN 'del' ELSE 'put' END AS op,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS v FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket, k ORDER BY seq DESC) AS rn FROM l),
live AS (SELECT bucket, k, v, seq FROM r WHERE rn = 1 AND op = 'put'),
len AS (SELECT *, CASE WHEN op = 'put' THEN 9 + strlen(bucket) + 1 + strlen(k) + strlen(coalesce(v, '')) ELSE 8 + strlen(bucket) + 1 + strlen(k) END AS n FROM l)
"""


def query(sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (BASE if base else "") + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(events: DataFrame) -> DataFrame:
    """kvlog over events: bucket event_type, key u<user_id>, every seventh event a delete."""
    key = F.encode(F.concat(F.lit("u"), F.col("user_id").cast("string")), "utf-8")
    op = F.when(F.col("event_id") % 7 == 0, "del").otherwise("put")
    return L.make_log(events, F.col("event_id"), F.col("event_type"), key, op, F.encode("props", "utf-8"))


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(table(spark, sf_dir, "events"))


def text(c: str, name: str | None = None):
    return F.decode(c, "utf-8").alias(name or c)


def shown(live: DataFrame) -> DataFrame:
    return live.select("bucket", text("user_key", "k"), text("value", "v"))


def key(bucket: str, k: str) -> bytes:
    return reads.qualify(bucket, k.encode())


def split_key(df: DataFrame, *cols: str) -> DataFrame:
    """bucket and k from a full key of a plain bucket."""
    s = F.decode("full_key", "utf-8")
    return df.select(F.substring_index(s, "\0", 1).alias("bucket"), F.substring_index(s, "\0", -1).alias("k"), *cols)


@query("SELECT bucket, k, v FROM live")
def q01_live_state(spark, d):
    return shown(latest(log_of(spark, d)))


@query("SELECT k, v FROM live WHERE bucket = 'view'")
def q02_scan_bucket(spark, d):
    return reads.scan(log_of(spark, d), "view").select(text("key", "k"), text("value", "v"))


@query("SELECT k, v FROM live WHERE bucket = 'click' AND k = 'u1'")
def q03_get(spark, d):
    return split_key(reads.get(log_of(spark, d), "click", b"u1"), "value").select("k", text("value", "v"))


@query("SELECT CAST(count(*) AS BIGINT) AS num_keys FROM live")
def q04_num_keys(spark, d):
    return st.num_keys(log_of(spark, d))


PROBES = ", ".join(f"('u{i}')" for i in range(1, 60))


def probes(spark: SparkSession, bucket: str) -> DataFrame:
    return spark.range(1, 60).select(L.full_key(F.lit(bucket), F.encode(F.concat(F.lit("u"), F.col("id").cast("string")), "utf-8")).alias("full_key"))


@query(f"SELECT p.k, v FROM (VALUES {PROBES}) p(k) LEFT JOIN live ON live.k = p.k AND bucket = 'click'")
def q05_multi_get(spark, d):
    return split_key(reads.multi_get(probes(spark, "click"), log_of(spark, d)), "value").select("k", text("value", "v"))


@query(f"SELECT p.k FROM (VALUES {PROBES}) p(k) WHERE EXISTS (SELECT 1 FROM live WHERE live.k = p.k AND bucket = 'view')")
def q06_has(spark, d):
    return split_key(reads.has(probes(spark, "view"), log_of(spark, d))).select("k")


@query(f"SELECT p.k FROM (VALUES {PROBES}) p(k) WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.k = p.k AND bucket = 'view')")
def q06_missing(spark, d):
    return split_key(reads.missing(probes(spark, "view"), log_of(spark, d))).select("k")


@query("SELECT hex(encode(bucket)) || '00' || hex(encode(k)) AS raw_key, v FROM live")
def q07_cross_bucket_scan(spark, d):
    return reads.scan(log_of(spark, d), "").select(F.hex("key").alias("raw_key"), text("value", "v"))


@query("SELECT k, v FROM live WHERE bucket = 'view' ORDER BY k LIMIT 5")
def q08_early_stop_scan(spark, d):
    return reads.scan_first(log_of(spark, d), "view", 5).select(text("key", "k"), text("value", "v"))


@query("SELECT bucket, count(*) AS n FROM l WHERE op = 'del' GROUP BY bucket")
def q09_tombstones(spark, d):
    return L.tombstones(log_of(spark, d))


@query('SELECT seq, n AS len, CAST(sum(n) OVER (ORDER BY seq) - n AS BIGINT) AS "offset" FROM len')
def q10_record_offsets(spark, d):
    return L.running_start(log_of(spark, d).withColumn("len", L.record_length()), "seq", "len", "offset").select("seq", "len", "offset")


@query("SELECT CAST(sum(n) AS BIGINT) AS logical_offset FROM len")
def q11_logical_offset(spark, d):
    return L.logical_size(log_of(spark, d))


@query("""SELECT CAST(sum(len.n) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN live.k IS NOT NULL THEN len.n END) AS BIGINT) AS live_bytes,
  round(1 - sum(CASE WHEN live.k IS NOT NULL THEN len.n END) / sum(len.n), 6) AS fragmentation FROM len LEFT JOIN live USING (bucket, k, seq)""")
def q12_fragmentation(spark, d):
    return st.fragmentation(log_of(spark, d)).withColumn("fragmentation", F.round("fragmentation", 6))


@query("SELECT bucket, k, count(*) AS n FROM l WHERE op = 'put' GROUP BY ALL")
def q13_key_frequency(spark, d):
    return split_key(sketches.key_frequency(log_of(spark, d)), "n")


@query("SELECT bucket, k, count(*) AS n, TRUE AS never_under, TRUE AS near FROM l WHERE op = 'put' GROUP BY ALL")
def q14_cms_never_under(spark, d):
    """near: an estimate is above the count by no more than e / width of all puts (at seven rows one key in 1000 may be)."""
    log = sketches.puts(log_of(spark, d))
    exact = sketches.key_frequency(log)
    over = F.col("estimate") - F.col("n")
    most = math.e / sketches.cms_width(0.01)
    met = exact.join(sketches.cms_estimate(exact, sketches.cms(log)), "full_key").join(F.broadcast(log.agg(F.count("*").alias("every"))))  # one row
    return split_key(met.withColumn("never_under", over >= 0).withColumn("near", over <= most * F.col("every")), "n", "never_under", "near")


@query("SELECT CAST(i AS INT) AS row, (SELECT count(*) FROM l WHERE op = 'put') AS n, 0 AS cells_that_differ FROM range(7) t(i)")
def q15_cms_merge(spark, d):
    log = sketches.puts(log_of(spark, d))
    halves = sketches.cms_merge(sketches.cms(log.filter("seq % 2 = 0")), sketches.cms(log.filter("seq % 2 = 1")))
    whole = sketches.cms(log).withColumnRenamed("n", "m")
    both = halves.join(whole, ["row", "cell"], "full")
    return both.groupBy("row").agg(F.sum("n").alias("n"), F.count_if(~F.col("n").eqNullSafe(F.col("m"))).cast("int").alias("cells_that_differ"))


@query("SELECT bucket, count(DISTINCT k) AS n_keys FROM l WHERE op = 'put' GROUP BY bucket")
def q16_cardinality_exact(spark, d):
    return sketches.exact_keys_by_bucket(log_of(spark, d))


def _within(estimate: DataFrame, exact: DataFrame) -> DataFrame:
    e, x = F.col("estimated_keys"), F.col("exact")
    return estimate.crossJoin(F.broadcast(exact)).select("exact", (F.abs(e - x) <= 5 * 1.04 / 128 * x + 1).alias("within"))  # one row each


@query("SELECT count(DISTINCT (bucket, k)) AS exact, TRUE AS within FROM l WHERE op = 'put'")
def q17_hll_within_bound(spark, d):
    log = log_of(spark, d)
    return _within(sketches.estimated_keys(log), sketches.puts(log).agg(F.countDistinct("full_key").alias("exact")))


@query("SELECT count(DISTINCT (bucket, k)) AS exact, TRUE AS within FROM l WHERE op = 'put'")
def q18_hll_merge(spark, d):
    log = log_of(spark, d)
    return _within(sketches.hll_merged(log), sketches.puts(log).agg(F.countDistinct("full_key").alias("exact")))


@query("SELECT bucket, count(DISTINCT k) AS n_keys, TRUE AS within FROM l WHERE op = 'put' GROUP BY bucket")
def q18_hll_by_bucket(spark, d):
    log = log_of(spark, d)
    both = sketches.estimated_keys_by_bucket(log).join(sketches.exact_keys_by_bucket(log), "bucket")
    return both.select("bucket", "n_keys", (F.abs(F.col("estimated_keys") - F.col("n_keys")) <= 5 * 1.04 / 128 * F.col("n_keys") + 1).alias("within"))


@query("SELECT count(DISTINCT (bucket, k)) AS n, 0 AS false_negatives, TRUE AS few_false_positives FROM l WHERE op = 'put'")
def q19_bloom_no_false_negative(spark, d):
    """The filter is sized by the keys it takes, which are counted first: one of a fixed size is full at some number of keys and says maybe to any probe."""
    keys = sketches.puts(log_of(spark, d)).select("full_key").distinct()
    items = max(10_000, keys.count())
    bits = sketches.bloom_bits(keys, items)
    both = F.array(F.struct(F.col("full_key"), F.lit(True).alias("own")), F.struct(F.concat("full_key", F.lit(b"?")).alias("full_key"), F.lit(False).alias("own")))
    hits = sketches.bloom_test(keys.select(F.inline(both)), bits, items, keep=("own",))
    wrong = F.count_if(F.col("maybe") & ~F.col("own"))
    return hits.agg(F.count_if("own").alias("n"), F.count_if(F.col("own") & ~F.col("maybe")).cast("int").alias("false_negatives"), (wrong <= 0.05 * F.count("*")).alias("few_false_positives"))


@query("""SELECT CAST(2 * count_if(op = 'put') AS BIGINT) AS bloom_insertions,
  round(pow(1 - exp(-7.0::DOUBLE * (2 * count_if(op = 'put')) / 9585059.0::DOUBLE), 7.0) * 1e12, 3) AS bloom_fpr_e12 FROM l""")
def q20_bloom_stats(spark, d):
    return st.bloom_stats(log_of(spark, d)).select("bloom_insertions", F.round(F.col("bloom_fpr") * 1e12, 3).alias("bloom_fpr_e12"))


@query("""SELECT (SELECT count(*) FROM live) AS num_keys, (SELECT CAST(sum(n) AS BIGINT) FROM len) AS logical_offset, 2 * i AS bloom_insertions,
  round(pow(1 - exp(-7.0::DOUBLE * (2 * i) / 9585059.0::DOUBLE), 7.0) * 1e12, 3) AS bloom_fpr_e12, x AS keys_ever, TRUE AS within
  FROM (SELECT count(*) AS i, count(DISTINCT (bucket, k)) AS x FROM l WHERE op = 'put')""")
def q21_stats(spark, d):
    within = (F.abs(F.col("estimated_keys") - F.col("keys_ever")) <= 5 * 1.04 / 128 * F.col("keys_ever") + 1).alias("within")
    return st.stats(log_of(spark, d)).select("num_keys", "logical_offset", "bloom_insertions", F.round(F.col("bloom_fpr") * 1e12, 3).alias("bloom_fpr_e12"), "keys_ever", within)


@query("SELECT bucket, count(*) AS n FROM live GROUP BY bucket")
def q22_wal_replay(spark, d):
    log = log_of(spark, d)
    return maintenance.replay(log.filter("seq < 8000"), log.filter("seq >= 7000")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT seq, CAST(sum(m) OVER (ORDER BY seq) - m AS BIGINT) AS wal_offset FROM (SELECT seq, 8 + strlen(bucket) + 1 + strlen(k) + strlen(coalesce(v, '')) AS m FROM l)")
def q23_wal_offsets(spark, d):
    return wal_offsets(log_of(spark, d)).select("seq", "wal_offset")


@query("SELECT bucket, k, v FROM live")
def q24_compaction_equivalence(spark, d):
    log = log_of(spark, d)
    return shown(latest(maintenance.with_tail(maintenance.compacted(log.filter("seq < 6000")), log.filter("seq >= 6000"))))


@query("SELECT doc_id, strlen(text) AS n_bytes, strlen(text) >= 4096 AS eligible FROM documents", base=False)
def q25_compressible_values(spark, d):
    return L.compressible(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "n_bytes", "eligible")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1", base=False)
def q26_batch_set_last_wins(spark, d):
    o = table(spark, d, "orders")
    value = F.encode(F.col("o_totalprice").cast("string"), "utf-8")
    log = L.make_log(o, F.col("o_orderkey"), F.lit("cust"), F.encode(F.col("o_custkey").cast("string"), "utf-8"), F.lit("put"), value)
    return latest(log).select(F.decode("user_key", "utf-8").cast("long").alias("o_custkey"), F.col("seq").alias("o_orderkey"), F.decode("value", "utf-8").cast("double").alias("o_totalprice"))


@query("SELECT count(*) AS n, count(DISTINCT (bucket, k)) AS n_keys, TRUE AS in_range, TRUE AS even FROM l")
def q27_shard_balance(spark, d):
    """Shards of all keys; even: none has more than twice its share of keys, and a few."""
    by = log_of(spark, d).groupBy(L.shard(60).alias("shard")).agg(F.count("*").alias("n"), F.countDistinct("full_key").alias("keys"))
    even = (F.max("keys") <= 2 * F.sum("keys") / 64 + 20).alias("even")
    return by.agg(F.sum("n").alias("n"), F.sum("keys").alias("n_keys"), ((F.max("shard") < 64) & (F.min("shard") >= 0)).alias("in_range"), even)


def publications(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("turn").alias("seq"), F.col("conv_id").cast("string").alias("chan_key"), F.encode("text", "utf-8").alias("payload"))


def subscriptions(spark, d):
    """One for each conversation but every fifth, and one for a channel that nobody writes to; every fourth never ends."""
    ids = table(spark, d, "conversations").select("conv_id").distinct().filter("conv_id % 5 <> 0").unionByName(spark.range(1).select(F.lit(-7).cast("long").alias("conv_id")))
    return ids.select(F.col("conv_id").alias("sub_id"), F.col("conv_id").cast("string").alias("chan_key"), (F.col("conv_id") % 3).alias("from_seq"), F.when(F.col("conv_id") % 4 != 0, F.col("conv_id") % 3 + 2).alias("to_seq"))


@query("SELECT conv_id AS sub_id, CAST(conv_id AS VARCHAR) AS chan_key, turn AS seq, text AS payload FROM conversations WHERE conv_id % 5 <> 0 AND turn >= conv_id % 3 AND (conv_id % 4 = 0 OR turn < conv_id % 3 + 2)", base=False)
def q28_deliveries(spark, d):
    return deliveries(publications(spark, d), subscriptions(spark, d)).withColumn("payload", F.decode("payload", "utf-8"))


@query("SELECT role AS chan_key, count(*) AS n, string_agg(CAST(sub_id AS VARCHAR), ',' ORDER BY sub_id) AS ids FROM (SELECT DISTINCT role, conv_id AS sub_id FROM conversations) GROUP BY role", base=False)
def q29_subscribers(spark, d):
    subs = table(spark, d, "conversations").select(F.col("role").alias("chan_key"), F.col("conv_id").alias("sub_id")).distinct()
    return subscribers(subs).withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query("SELECT bucket, k, upper(v) AS reply FROM live")
def q30_handler_udf(spark, d):
    upper = handler_udf(lambda v: v.upper())
    return latest(log_of(spark, d)).select("bucket", text("user_key", "k"), F.decode(upper("value"), "utf-8").alias("reply"))


@query("SELECT seq, 'hooked:' || v AS payload FROM l WHERE op = 'put' AND NOT v LIKE '%1%'")
def q31_publish_hook(spark, d):
    pubs = sketches.puts(log_of(spark, d)).select("seq", F.col("full_key").alias("chan_key"), text("value", "payload"))
    return published(pubs, Hooks(on_publish=lambda p: F.concat(F.lit("hooked:"), p), veto=lambda p: p.contains("1"))).select("seq", "payload")


@query("SELECT bucket, k, v FROM live")
def q32_streaming_fold(spark, d):
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return shown(fold_available(event_log(events), f"{files.shared_folder(spark)}/fold-{uuid.uuid4().hex}"))


@query("""SELECT bucket, k, v FROM (SELECT *, row_number() OVER (PARTITION BY bucket, k ORDER BY seq DESC) AS last FROM l WHERE op = 'del' OR strlen(v) > 0)
  WHERE last = 1 AND op = 'put'""")
def q33_raw_round_trip(spark, d):
    """Every record that the binary layout can hold (it has no empty values) encoded and decoded again, then folded."""
    log = log_of(spark, d).filter("op = 'del' OR octet_length(value) > 0")
    raw = rawlog.to_raw(log, threshold=64)

    def back(batches):
        import pandas as pd

        for b in batches:
            rows = [(s, *next(rawlog.decode(bytes(r)))[1:]) for s, r in zip(b["seq"], b["record"], strict=True)]
            yield pd.DataFrame(rows, columns=["offset", "full_key", "op", "value"])

    return shown(latest(rawlog.as_log(raw.mapInPandas(back, rawlog.RAW))))


@query("""SELECT seq, k FROM (SELECT seq, k, n, sum(n) OVER (ORDER BY seq) AS e FROM len) WHERE e <= 100000""")
def q34_truncate(spark, d):
    return split_key(L.truncate(log_of(spark, d), 100_000), "seq").select("seq", "k")


@query("SELECT seq, k FROM (SELECT seq, k, sum(n) OVER (ORDER BY seq) - n AS s FROM len) WHERE s = (SELECT min(n) FROM (SELECT n FROM len ORDER BY seq LIMIT 1))")
def q35_record_at(spark, d):
    """The second record, which starts where the first ends."""
    log = log_of(spark, d)
    first = log.agg(F.min_by(L.record_length(), "seq").alias("n"))
    return split_key(L.record_at(log, first), "seq").select("seq", "k")


@query("SELECT k, v FROM live WHERE bucket = 'view'")
def q36_store_scan(spark, d):
    """The log appended to a store in one batch, compacted, and a bucket scanned from its part of the files."""
    store = filled_store(spark, d)
    store.compact()
    return store.bucket("view").frame().select(text("key", "k"), text("value", "v"))


def filled_store(spark, d, where: str = "true"):
    """A new store in the shared folder with the events that `where` chooses, in one bulk append."""
    folder = files.shared_folder(spark)
    files.make_folder(spark, folder)
    store = open_store(spark, f"{folder}/store-{uuid.uuid4().hex}", Options().with_maintenance(False))
    log = log_of(spark, d).filter(where)
    store.append(log.select("bucket", "user_key", "op", "value", F.col("seq").alias("position")))
    return store


@query("SELECT bucket, k, count(*) AS n FROM l WHERE op = 'put' GROUP BY ALL")
def q37_batch_frequency(spark, d):
    """Every record of a bulk append is logged, so duplicates in a batch count."""
    return split_key(sketches.key_frequency(filled_store(spark, d).log()), "n")


@query("SELECT bucket, k, v FROM live")
def q38_recovered_store(spark, d):
    """The events up to one of them appended to a store, the later ones left in its write-ahead log, and the store opened again."""
    store = filled_store(spark, d, "seq < 500")
    Wal(spark, f"{store.root}/{store.version}/wal").append(log_of(spark, d).filter("seq >= 500").withColumn("seq", F.col("seq") + 1_000_000))
    return shown(open_store(spark, store.root, Options().with_maintenance(False)).latest())


@query("SELECT seq, k FROM (SELECT seq, k, sum(m) OVER (ORDER BY seq) - m AS s FROM (SELECT seq, k, 8 + strlen(bucket) + 1 + strlen(k) + strlen(coalesce(v, '')) AS m FROM l)) WHERE s >= 50000 AND s < 90000")
def q39_wal_between(spark, d):
    """Records of a write-ahead log that start in a range of bytes."""
    placed = wal_offsets(log_of(spark, d))
    return split_key(placed.filter((F.col("wal_offset") >= 50_000) & (F.col("wal_offset") < 90_000)), "seq").select("seq", "k")


@query("SELECT bucket, k, count(*) AS n, TRUE AS never_under FROM l WHERE op = 'put' GROUP BY ALL")
def q40_cms_of_one_row(spark, d):
    """The count-min sketch as the engine configures it: one row of 512 cells."""
    log = sketches.puts(log_of(spark, d))
    exact = sketches.key_frequency(log)
    est = sketches.cms_estimate(exact, sketches.cms(log, 0.01, 1), 0.01, 1)
    return split_key(exact.join(est, "full_key").withColumn("never_under", F.col("estimate") >= F.col("n")), "n", "never_under")


@query("SELECT bucket, k, CASE WHEN bucket = 'view' THEN hex(encode(k)) ELSE hex(encode(bucket)) || '00' || hex(encode(k)) END AS raw_key FROM (SELECT DISTINCT bucket, k FROM l)")
def q41_keys_of_buckets(spark, d):
    """Full keys and channel keys: the bucket, NUL, the key; here 'view' stands for the bucket without a name."""
    rows = log_of(spark, d).select("bucket", "user_key").distinct()
    return rows.select("bucket", text("user_key", "k"), F.hex(L.full_key(F.when(F.col("bucket") == "view", "").otherwise(F.col("bucket")), F.col("user_key"))).alias("raw_key"))


@query("SELECT FALSE AS whole, TRUE AS none, CAST(count(*) AS BIGINT) AS n FROM l")
def q42_is_empty(spark, d):
    log = log_of(spark, d)
    count = lambda df, name: df.agg((F.count("*") == 0).alias(name))
    return count(log, "whole").crossJoin(count(log.filter("seq < 0"), "none")).crossJoin(log.agg(F.count("*").alias("n")))  # one row each


__all__ = ["ORACLES", "QUERIES", "event_log", "table"]
