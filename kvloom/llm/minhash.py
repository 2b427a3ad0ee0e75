"""Near duplicates by DartMinHash signatures of five-word shingles, weighted by how often a text says them.

Darts fall on the plane weight x rank of each element, one a unit of area on average, at places that a hash of the element fixes.
An element of weight w is hit by the darts below w. Each dart belongs to one of SIZE coordinates, and a coordinate keeps the
earliest (lowest-ranked) dart that hits. Two sets agree on a coordinate with the probability of their weighted Jaccard similarity,
and only about SIZE * log(SIZE) darts have to be looked at, however many elements there are.

Signatures are cut into bands; texts that agree on a band are candidates. Candidates are checked exactly on their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.llm import filters, shared
from kvloom.llm import text as T
from kvloom.llm.graphs import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5
SIZE = BANDS * ROWS
RANK_BITS, FRACTION = 44, 33
#: Darts that are looked at together, about.
DARTS = 500_000
U = np.uint64
SIGNED = "doc_id long, n_words long, key long, key2 long, bands array<long>"


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0**-53


#: Poisson(1): chances of at most 0, 1, 2, ... darts in a unit of area.
_AT_MOST = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def signatures(elements: np.ndarray, owner: np.ndarray, n: int, size: int = SIZE, weights: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """n x size signatures (64-bit values) of weighted sets: elements (hashes) of owners 0 to n - 1. A set without elements gets zeros.

    The ranks looked at reach as far as size * (log size + 4) darts are expected to fall, and twice as far again for sets
    that leave a coordinate empty. Without weights each distinct element weighs 1.
    """
    out = np.zeros((n, size), U)
    if not len(elements):
        return out
    mass = np.bincount(owner, weights=weights, minlength=n)
    reach = np.zeros(n)
    todo = np.flatnonzero(mass > 0)
    reach[todo] = size * (math.log(size) + 4) / mass[todo]
    salted = T.mix(elements ^ T.series(1, 77 + seed)[0])
    per_round = max(1, min((1 << (64 - RANK_BITS)) // size - 1, DARTS // (size * 9)))
    while len(todo):
        empty = []
        for at in range(0, len(todo), per_round):
            part = todo[at : at + per_round]
            local = np.full(n, -1)
            local[part] = np.arange(len(part))
            chosen = np.flatnonzero(local[owner] >= 0)
            found = _earliest(salted[chosen], local[owner[chosen]], reach[part], size, None if weights is None else weights[chosen], len(part))
            full = (found != U(0xFFFFFFFFFFFFFFFF)).all(axis=1)
            out[part[full]] = found[full]
            empty.append(part[~full])
        todo = np.concatenate(empty)
        reach[todo] *= 2
    return out


def _earliest(elements: np.ndarray, owner: np.ndarray, reach: np.ndarray, size: int, weights: np.ndarray | None, n: int) -> np.ndarray:
    best = np.full(n * size, 0xFFFFFFFFFFFFFFFF, U)
    top = 1.0 if weights is None else float(weights.max())
    level = 0
    while 2.0**level - 1 < top:
        low, width = 2.0**level - 1, 2.0**level
        own = np.arange(len(elements)) if weights is None else np.flatnonzero(weights > low)
        # rows of unit area: `width` wide in weight, 1 / width high in rank
        rows = np.ceil(reach[owner[own]] * width).astype(np.int64)
        which = np.repeat(own, rows)
        row = np.arange(int(rows.sum())) - np.repeat(np.cumsum(rows) - rows, rows)
        cell = T.mix(elements[which] + T.series(1, 1000 + level)[0] * (row.astype(U) + U(1)))
        count = np.searchsorted(_AT_MOST, _unit(cell), side="right")
        dart = np.repeat(np.arange(len(cell)), count)
        number = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
        h = T.mix(cell[dart] + BASE_DART * (number.astype(U) + U(1)))
        rank = (row[dart] + _unit(h)) / width
        who = which[dart]
        hit = rank < reach[owner[who]]
        if weights is not None:
            hit &= low + _unit(T.mix(h ^ BASE_DART)) * width < weights[who]
        h, rank, who = h[hit], rank[hit], who[hit]
        slot = owner[who].astype(U) * U(size) + T.mix(h + U(0x632BE59BD9B4E019)) % U(size)
        packed = np.sort((slot << U(RANK_BITS)) | np.minimum(rank * 2.0**FRACTION, 2.0**RANK_BITS - 1).astype(U))
        slots = packed >> U(RANK_BITS)
        first = np.flatnonzero(np.diff(slots, prepend=U(0xFFFFFFFFFFFFFFFF)) != 0)
        at = slots[first].astype(np.int64)
        best[at] = np.minimum(best[at], packed[first] & U((1 << RANK_BITS) - 1))
        level += 1
    return best.reshape(n, size)


BASE_DART = U(0xE7037ED1A0B428DB)
AGAIN = U(0x8EBC6AF09C88C6E3)


def bands(signature: np.ndarray, count: int, rows: int) -> np.ndarray:
    """n x count hashes of `rows` consecutive coordinates, salted by their place."""
    out = np.zeros((len(signature), count), U)
    for i in range(count):
        h = np.full(len(signature), T.series(1, 5000 + i)[0])
        for j in range(rows):
            h = T.mix(h ^ signature[:, i * rows + j]) * T.BASE
        out[:, i] = T.mix(h)
    return out.view(np.int64)


def shingles(b: T.Block, hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of all shingles of a block. A text of fewer words has one, of all its words; one without words has none."""
    doc = b.doc()
    found = T.windows(hashes, size)
    whole = doc[: len(found)] == doc[size - 1 :] if len(found) else np.zeros(0, bool)
    counts = np.diff(b.words)
    short = np.flatnonzero((counts > 0) & (counts < size))
    key = T.sequence_hashes(hashes, b.words)
    return np.concatenate((found[whole], key[short])), np.concatenate((doc[: len(found)][whole], short))


def weighted(elements: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (element, owner), by owner and element, and how often each occurs."""
    order = np.lexsort((elements, owner))
    elements, owner = elements[order], owner[order]
    new = np.ones(len(elements), bool)
    new[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return elements[first], owner[first], np.diff(np.append(first, len(elements)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in T.blocks(batch.column(1)):
            hashes = b.hashes()
            key, key2 = b.keys(hashes)
            elements, owner, times = weighted(*shingles(b, hashes))
            found = bands(signatures(elements, owner, b.n, weights=times.astype(np.float64)), BANDS, ROWS)
            lists = pa.ListArray.from_arrays(np.arange(b.n + 1, dtype=np.int32) * BANDS, found.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n).cast(pa.int64()), pa.array(np.diff(b.words)), pa.array(key), pa.array(key2), lists], names=["doc_id", "n_words", "key", "key2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sets as plain ones: the second, third, ... time that a text says a shingle are elements of their own, so common elements of two sets are sums of least weights."""
    for batch in batches:
        for b in T.blocks(batch.column(1)):
            elements, owner, times = weighted(*shingles(b, b.hashes()))
            again = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            every, owner = np.repeat(elements, times), np.repeat(owner, times)
            every = np.where(again > 0, T.mix(every + AGAIN * again.astype(U)), every)
            edges = np.searchsorted(owner, np.arange(b.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n).cast(pa.int64()), pa.ListArray.from_arrays(edges, every.view(np.int64))], names=["doc_id", "shingles"])


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(shingle, doc_id, size, rest): of each set the rarest shingles, as many as two sets of that similarity can't both lack in common; rest counts it and those after it.

    Sets that share only what is frequent, such as one passage that many texts hold, have rarer shingles of their own and don't meet.
    """
    rows = sets.select("doc_id", F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    ranked = rows.join(often, "shingle").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("s"))
    size = F.size("s")
    count = size - F.ceil(similarity * size - 1e-9) + 1
    first = ranked.select("doc_id", size.alias("size"), F.posexplode(F.slice("s", F.lit(1), count.cast("int"))).alias("at", "x"))
    return first.filter("x.often > 1").select("x.shingle", "doc_id", "size", (F.col("size") - F.col("at")).alias("rest"))


def _labelled(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """Marks with classes, of shingles that more than one class has."""
    own = marks.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("shingle", "doc_id", "size", "rest", F.coalesce("label", "doc_id").alias("label"))
    several = own.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("shingle")
    return own.join(several, "shingle", "left_semi")


def first_of_others(marks: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Each text with the first text that has the same mark, where that is of another class: linear in the marks."""
    own = _labelled(marks, labels)
    first = own.groupBy("shingle").agg(F.min(F.struct("doc_id", "label", "size", "rest")).alias("f"))
    met = own.join(first, "shingle").filter((F.col("label") != F.col("f.label")) & _may("size", "rest", "f.size", "f.rest", similarity))
    return met.select(F.col("doc_id").alias("a"), F.col("f.doc_id").alias("b")).distinct()


def all_of_others(marks: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """All pairs of texts that share a mark and are still in different classes."""
    own = _labelled(marks, labels)
    other = own.toDF("shingle", "other", "size2", "rest2", "label2")
    fits = (own["doc_id"] > other["other"]) & (own["label"] != other["label2"]) & _may("size", "rest", "size2", "rest2", similarity)
    met = own.join(other, (own["shingle"] == other["shingle"]) & fits)
    return met.select(F.col("doc_id").alias("a"), F.col("other").alias("b")).distinct()


def _may(size: str, rest: str, size2: str, rest2: str, similarity: float) -> Column:
    """Whether two sets whose first common shingle this is can be similar: no more than what follows it in both is common."""
    need = similarity / (1 + similarity) * (F.col(size) + F.col(size2)) - 1e-9
    return F.least(F.col(rest), F.col(rest2)) >= need


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least `similarity`. Joins are of two tables each, so the session can split that of a hub."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    sizes = F.size("x") + F.size("y")
    possible = F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y")) - 1e-9
    return both.filter(possible).filter(common >= similarity * (sizes - common) - 1e-9).select("a", "b")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of documents: doc_id, class_id.

    Texts are linked if they have the same words in the same order or if a band joins them and their sets of five-word shingles,
    weighted by how often a text says each, have a Jaccard similarity (sum of least weights over sum of greatest) of at least
    `similarity`; a class is what links connect, named by its least doc_id. A pair at 0.8 shares a band with a chance of 0.99996.
    Texts without words (null, empty, white space) are classes of their own, as are rows with a null doc_id, whose class_id is
    null. Rows that share a doc_id are one document. Other columns are not read, whatever their names. An empty table gives no
    rows. A very long text is read whole, in a block of its own.

    Copies are set to their first document before anything else. In each band every text is compared with the band's first.
    Texts of bands that are then still of several classes are joined on their rarest shingles, of which two similar texts
    must share one; pairs of different classes are compared. No link is lost in that step, and texts that one common passage joins don't meet.
    """
    docs = docs.select("doc_id", "text")
    with shared.scratch():
        by_doc = shared.written(_classes(docs.filter(F.col("doc_id").isNotNull()), similarity), "classes", keep=True)
    return docs.select("doc_id").join(by_doc, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _classes(known: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, class_id) of documents (doc_id, text) with words."""
    signed = shared.written(known.mapInArrow(_sign, SIGNED), "signatures").filter("n_words > 0")
    owners = shared.written(signed.groupBy("key", "key2").agg(F.min("doc_id").alias("owner")), "owners")
    texts = shared.written(signed.select("doc_id", "key", "key2").distinct().join(owners, ["key", "key2"]).select("doc_id", "owner"), "texts")
    firsts = texts.filter("doc_id = owner").select("doc_id").distinct()

    rows = signed.join(firsts, "doc_id", "left_semi").select(F.explode("bands").alias("band"), "doc_id").distinct()
    rows = shared.written(rows, "bands")
    meet = shared.written(rows.groupBy("band").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("band", "first"), "meeting")
    rows = shared.written(filters.passes(rows, "band", filters.of(meet, "band")).join(meet, "band"), "candidates")
    members = shared.written(rows.select("doc_id").distinct(), "members")
    chosen = filters.passes(known, "doc_id", filters.of(members, "doc_id")).join(members, "doc_id", "left_semi")
    sets = shared.written(chosen.mapInArrow(_sets, "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]), "shingles")

    stars = rows.filter("doc_id > first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    links = shared.written(verified(stars, sets, similarity), "links")
    labels = components(links)

    with_label = rows.select("band", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    several = with_label.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("band")
    apart = shared.written(with_label.join(several, "band", "left_semi").select("doc_id").distinct(), "apart")
    marks = shared.written(prefixes(sets.join(apart, "doc_id", "left_semi"), similarity), "marks")
    for pairs_of in (first_of_others, all_of_others):
        pairs = shared.written(pairs_of(marks, labels, similarity), "pairs")
        more = shared.written(verified(pairs, sets, similarity), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)

    first_of = texts.join(labels, texts["owner"] == labels["node"], "left").select("doc_id", F.coalesce("label", "owner").alias("class_id"))
    return first_of.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose document is the first of its class, with all their columns, whatever their names. Rows with a null doc_id stay."""
    later = shared.fresh(docs.columns, "later")
    classes = near_duplicates(docs, similarity).filter(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(later)).distinct()
    return docs.join(classes, docs["doc_id"] == classes[later], "left_anti")
