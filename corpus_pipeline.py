"""A training-data pipeline over documents: classify, filter by rules, drop near duplicates, cut repeated passages, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever other
columns there are and whatever their names. Stages have a result for every row: null and empty texts are texts without words,
rows with a null doc_id are documents of their own, repeated rows are judged alike, an empty table gives an empty one, and very
long texts are read whole. What each stage does with them is said there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kvloom.llm import minhash, packing, perplexity, queries, repetition, shared, substrings


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents above their language's perplexity limit go. The model is trained on the trusted ones among docs.

    Texts without words stay, as do rows with a null doc_id and languages without trusted documents. Of rows with one doc_id all
    go if one does. A null lang is a language of its own."""
    queries.ready(spark)
    return perplexity.keep(docs, queries.table(spark, sf_dir, "labels"))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the repetition rules reject go. Null, empty and short texts (under 50 words) go; each row is judged by its text alone."""
    queries.ready(spark)
    return repetition.keep(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each class of near duplicates the document with the least doc_id stays.

    Texts without words and rows with a null doc_id stay; rows that share a doc_id are one document and stay or go together."""
    queries.ready(spark)
    return minhash.one_of_each(docs)


def stripped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: passages of 50 words or more that an earlier document has are cut from the text.

    A text that loses nothing stays as it is, null included; one that loses all its words stays as an empty text. Rows with a null
    doc_id lose nothing; rows that share one don't count as earlier than each other."""
    queries.ready(spark)
    return substrings.strip_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: pieces of the remaining texts with their places in sequences of 2048 ids. Null and empty texts have their end id alone; repeated rows are packed each."""
    queries.ready(spark)
    return packing.pack(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("near duplicates", deduplicated),
    ("repeated passages", stripped),
    ("packing", packed),
]
#: Training, signatures, automata and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it. Only the last one's table stays."""
    docs = queries.documents(spark, sf_dir)
    with shared.scratch():
        for name, stage in STAGES[:-1]:
            docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return shared.written(STAGES[-1][1](spark, docs, sf_dir), "packed", keep=True)
