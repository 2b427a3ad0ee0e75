"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm import shared

ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """(node, label) from links (a, b): the label is the least node that links lead to. Nodes without links don't come up.

    Each round hangs the neighbours of a node under the least of them; the number of rounds grows with the logarithm of the
    longest path. Minima are combined before they are shuffled, and a node with many neighbours is joined in parts where the
    session lets joins split. Each round is written to the shared folder.
    """
    with shared.scratch():
        edges = shared.written(_stars(links), "stars", keep=True)
    return edges.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())


def _met(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows (v, u) with m of least (v, m), one row a v. The join is on another value than the one that least was grouped by, so both
    sides are dealt out for it, and the session can split the rows of a node that a third of all links lead to."""
    key = F.bitwise_not("v").alias("k")
    return rows.select("v", "u", key).join(least.select(key, "m"), "k").drop("k")


def _stars(links: DataFrame) -> DataFrame:
    """(v, u): each node but the least of its component under the least."""
    edges = shared.written(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    state = None
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        # every larger neighbour goes under the least one around
        large = _met(both, least).filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        # and of what a node then hangs under, all go under the least
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = _met(large, low).select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*")
        edges = shared.written(small.filter("v <> u").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges
