"""The queries of this subpackage, as registered with the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm import licenses, linkgraph, minhash, packing, paragraphs, perplexity, pieces, repetition, separators, substrings
from kvloom.llm.oracles import ORACLES
from kvloom.sources.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: Bytes of an Arrow batch between an executor and its workers; the default of 10,000 rows is as large as the rows are.
BATCH_BYTES = 6 << 20


def ready(spark: SparkSession) -> None:
    """The package on all executors, and batches of bounded bytes unless the session has a bound."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(documents(spark, sf_dir))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


@query
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


@query
def op4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.fingerprints(documents(spark, sf_dir))


@query
def op5_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.counts_of_documents(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), 49407)


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query
def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op10_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"))


__all__ = ["ORACLES", "QUERIES", "documents", "ready", "table", "tokenizer"]
