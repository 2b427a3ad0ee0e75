"""Removal of long repeated passages with suffix automata of reference shards.

A window is 50 words. Every window holds the least hash of its 24-word runs, its anchor; two texts that share a window share the anchor in it.
Texts that share an anchor meet: the 50 - 24 words on both sides of it, its context, hold every window that the anchor stands for.

* A context that an earlier document has word for word is removed as it stands; so is a whole text that an earlier one equals.
* Contexts that share an anchor and differ go to the shard of the anchor. A shard's contexts are taken by rising document: each is
  streamed through the suffix automaton of those before it, and spans with matching statistics of 50 words or more are removed; then the automaton takes it in.
* An anchor with more than SHARD_LIMIT different contexts would make one shard grow without end. Its windows are compared by hash in a grouped join instead, to the same result.

Sending the automaton of every shard to every document would cost shards x documents; anchors say beforehand which shards a text can match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm import filters, shared
from kvloom.llm import text as T

WINDOW = 50
RUN = 24
SHARD_CONTEXTS = 2000
SHARD_LIMIT = 512
FIRST = "doc_id long, n_words long, key long, key2 long, anchors binary, places binary"


def anchor_places(hashes: np.ndarray, words: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions in a block of the least run hash of every window that lies in one document, and these hashes."""
    grams = T.windows(hashes, run)
    width = window - run + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(words) - 1), np.diff(words))
    starts = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    least = np.lib.stride_tricks.sliding_window_view(grams, width)[starts].argmin(axis=1) if len(starts) < 1000 else _argmin(grams, width)[starts]
    places = np.unique(starts + least)
    return places, grams[places]


def _argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost least value of each window, as the distance from its start; doubling keeps it in a few passes."""
    at = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        done += step
    return at - np.arange(len(at))


def contexts(words: int, places: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(places - (window - run), 0), np.minimum(places + window, words)


class Automaton:
    """Suffix automaton of a growing text of hashable symbols."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, symbols: list) -> None:
        """Appends symbols, after a separator that is equal to nothing else."""
        nxt, link, length = self.next, self.link, self.length
        last = self.last
        for c in (object(), *symbols):
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.last = last

    def statistics(self, symbols: list) -> list[int]:
        """For each position the length of the longest stretch that ends there and occurs in the text."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for c in symbols:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            out.append(size)
        return out

    def spans(self, symbols: list, window: int) -> list[tuple[int, int]]:
        """Maximal spans under matches of at least `window` symbols."""
        out: list[list[int]] = []
        for end, size in enumerate(self.statistics(symbols), 1):
            if size >= window:
                if out and out[-1][1] >= end - size:
                    out[-1][1] = end
                    out[-1][0] = min(out[-1][0], end - size)
                else:
                    out.append([end - size, end])
        return [tuple(s) for s in out]


# --- stages ------------------------------------------------------------------


def _first(batches: Iterator[pa.RecordBatch], window: int, run: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in T.blocks(batch.column(1)):
            hashes = b.hashes()
            key, key2 = b.keys(hashes)
            places, found = anchor_places(hashes, b.words, window, run)
            of = np.searchsorted(places, b.words)
            inside = (places - np.repeat(b.words[:-1], np.diff(of))).astype("<u4")
            anchors = [found[i:j].tobytes() for i, j in zip(of[:-1], of[1:], strict=True)]
            spots = [inside[i:j].tobytes() for i, j in zip(of[:-1], of[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(b.first, b.n).cast(pa.int64()), pa.array(np.diff(b.words)), pa.array(key), pa.array(key2), pa.array(anchors, pa.binary()), pa.array(spots, pa.binary())],
                names=[c.split()[0] for c in FIRST.split(", ")],
            )


ANCHOR_ROWS = "anchor long, doc_id long, key long, place int"


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of anchors from rows of documents."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sizes = np.array([len(x) // 8 for x in part.column("anchors").to_pylist()], np.int64)
            found = np.frombuffer(b"".join(part.column("anchors").to_pylist()), "<i8")
            spots = np.frombuffer(b"".join(part.column("places").to_pylist()), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.repeat(part.column("doc_id").to_numpy(), sizes)), pa.array(np.repeat(part.column("key").to_numpy(), sizes)), pa.array(spots)], names=["anchor", "doc_id", "key", "place"]
            )


OCCURRENCES = "anchor long, context long, context2 long, doc_id long, key long, first int, last int"


def _occurrences(window: int, run: int):
    """Of each document with shared anchors (doc_id, text, list) the context of each: anchor, two digests, extent."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, hashes, hashes2, own in _matching(batch):
                places = np.array([s["place"] for s in own], np.int64)
                first, last = contexts(len(hashes), places, window, run)
                n = len(places)
                columns = [
                    pa.array([s["anchor"] for s in own], pa.int64()), pa.array(_digests(hashes, first, last, 0)), pa.array(_digests(hashes2, first, last, 1)),
                    pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OCCURRENCES.split(", ")])

    return rows


def _digests(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the stretches hashes[first:last], which may overlap and are not empty."""
    lens = last - first
    inside = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    summed = np.add.reduceat(T.placed(hashes[inside + np.repeat(first, lens)], inside, seed), np.cumsum(lens) - lens) if len(lens) else np.zeros(0, np.uint64)
    return T.mix(summed + T.mix(lens.astype(np.uint64))).view(np.int64)


def _matching(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(doc_id, key, word hashes, second word hashes, entries) of rows (doc_id, text, list, ...), for the entries of the list whose key is the text's."""
    for b in T.blocks(batch.column("text")):
        hashes, hashes2 = b.hashes(), b.hashes(1)
        keys = T.sequence_hashes(hashes, b.words).view(np.int64)
        ids = batch.column("doc_id").slice(b.first, b.n).to_pylist()
        lists = batch.column("list").slice(b.first, b.n).to_pylist()
        for i in range(b.n):
            own = [s for s in lists[i] or () if s["key"] == keys[i]]
            if own:
                yield ids[i], int(keys[i]), hashes[b.words[i] : b.words[i + 1]], hashes2[b.words[i] : b.words[i + 1]], own


WORDS = "shard long, doc_id long, key long, first int, words binary, words2 binary"


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of the contexts that a shard asks for; the second ones only where windows are compared by hash."""
    for batch in batches:
        for doc, key, hashes, hashes2, own in _matching(batch):
            n = len(own)
            columns = [
                pa.array([s["shard"] for s in own], pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array([s["first"] for s in own], pa.int32()),
                pa.array([hashes[s["first"] : s["last"]].tobytes() for s in own], pa.binary()), pa.array([hashes2[s["first"] : s["last"]].tobytes() if s["shard"] < 0 else b"" for s in own], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WORDS.split(", ")])


def _match(window: int):
    def shard(rows: pa.Table) -> pa.Table:
        """Spans of a shard's contexts that an earlier document holds."""
        out: list[tuple[int, int, int, int]] = []
        automaton = Automaton()
        rows = rows.sort_by([("doc_id", "ascending"), ("key", "ascending"), ("first", "ascending")])
        docs = rows.column("doc_id").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(docs)) + 1).tolist(), len(docs)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            own = rows.slice(i, j - i)
            texts = [np.frombuffer(w, "<i8").tolist() for w in own.column("words").to_pylist()]
            for key, first, words in zip(own.column("key").to_pylist(), own.column("first").to_pylist(), texts, strict=True):
                out += [(int(docs[i]), key, first + a, first + b) for a, b in automaton.spans(words, window)]
            for words in {tuple(w) for w in texts} if len(texts) > 1 else [tuple(texts[0])]:
                automaton.add(list(words))
        columns = zip(*out, strict=True) if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.table({n.split()[0]: pa.array(list(c), k) for n, c, k in zip(RANGES.split(", "), columns, kinds, strict=True)})

    return shard


WINDOWS = "window long, window2 long, doc_id long, key long, first int"


def _windows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, first, *words in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "first", "words", "words2")), strict=True):
                found, found2 = (T.windows(np.frombuffer(w, np.uint64), window).view(np.int64) for w in words)
                n = len(found)
                columns = [pa.array(found), pa.array(found2), pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(first + np.arange(n, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WINDOWS.split(", ")])

    return rows


RANGES = "doc_id long, key long, first int, last int"


def repeated_ranges(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc_id, key, first, last): word ranges of a text, named by doc_id and key, that lie under windows of a smaller doc_id. They may overlap.

    Texts, contexts and windows are equal if two independent 64-bit hashes of their words are. Least ids are tables of their own
    before rows are joined to them, so that the session can split the join of a key that many rows have.
    """
    with shared.scratch():
        return shared.written(_ranges(docs.select("doc_id", "text"), window, run), "ranges", keep=True)


def _ranges(docs: DataFrame, window: int, run: int) -> DataFrame:
    known = docs.filter(F.col("doc_id").isNotNull())
    first = shared.written(known.mapInArrow(lambda batches: _first(batches, window, run), FIRST), "anchors")
    long = first.filter(F.col("n_words") >= window)
    owners = long.groupBy("key", "key2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last_owner"))
    owners = shared.written(owners.filter("owner < last_owner").drop("last_owner"), "owners")
    copies = long.select("doc_id", "key", "key2", "n_words").join(owners, ["key", "key2"]).filter(F.col("doc_id") > F.col("owner"))
    copies = shared.written(copies.select("doc_id", "key", F.lit(0).alias("first"), F.col("n_words").cast("int").alias("last")), "copies")

    anchors = long.join(copies, ["doc_id", "key"], "left_anti").select("doc_id", "key", "anchors", "places").dropDuplicates(["doc_id", "key"]).mapInArrow(_explode, ANCHOR_ROWS)
    anchors = shared.written(anchors, "anchor-rows")
    meet = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    meet = shared.written(meet, "meeting")
    near = filters.passes(anchors, "anchor", filters.of(meet, "anchor")).join(meet, "anchor", "left_semi")
    by_doc = shared.written(near.groupBy("doc_id").agg(F.collect_list(F.struct("key", "anchor", "place")).alias("list")), "near")
    chosen = filters.passes(known, "doc_id", filters.of(by_doc, "doc_id")).join(by_doc, "doc_id")
    chosen = shared.written(chosen.select("doc_id", "text", "list"), "near-texts")

    seen = shared.written(chosen.mapInArrow(_occurrences(window, run), OCCURRENCES).dropDuplicates(), "contexts")
    kinds = shared.written(seen.groupBy("anchor", "context", "context2").agg(F.min("doc_id").alias("owner")), "kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    of_owner = seen.join(kinds, ["anchor", "context", "context2"])
    copied = of_owner.filter((F.col("doc_id") > F.col("owner")) & (F.col("last") - F.col("first") >= window)).select("doc_id", "key", "first", "last")

    n_shards = max(1, kinds.count() // SHARD_CONTEXTS)
    shard = F.when(F.col("n") <= SHARD_LIMIT, F.pmod(F.xxhash64("anchor"), F.lit(n_shards))).otherwise(-1)
    # one row for each context that differs from another with its anchor: the first place in its first document
    to_match = of_owner.filter(F.col("doc_id") == F.col("owner")).join(several, "anchor").withColumn("shard", shard.cast("long"))
    wanted = to_match.groupBy("doc_id").agg(F.collect_set(F.struct("key", "shard", "first", "last")).alias("list"))
    words = chosen.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(_wanted, WORDS)
    words = shared.written(words, "words")

    matched = words.filter("shard >= 0").select("shard", "doc_id", "key", "first", "words").groupBy("shard").applyInArrow(_match(window), RANGES)
    wide = shared.written(words.filter("shard < 0").select("doc_id", "key", "first", "words", "words2").mapInArrow(_windows(window), WINDOWS).dropDuplicates(), "windows")
    earliest = wide.groupBy("window", "window2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last_owner"))
    earliest = shared.written(earliest.filter("owner < last_owner").drop("last_owner"), "earliest")
    hot = wide.join(earliest, ["window", "window2"]).filter(F.col("owner") < F.col("doc_id")).select("doc_id", "key", "first", (F.col("first") + window).alias("last"))
    return copies.unionByName(copied).unionByName(matched).unionByName(hot)


def _without(batches: Iterator[pa.RecordBatch], others: list[str], rejoin: bool) -> Iterator[pa.RecordBatch]:
    """Rows (text, list, others...) to (others..., n_words, n_removed, kept)."""
    for batch in batches:
        for b in T.blocks(batch.column("text")):
            keys = T.sequence_hashes(b.hashes(), b.words).view(np.int64)
            gone = np.zeros(len(b.starts) + 1, np.int64)
            for i, ranges in enumerate(batch.column("list").slice(b.first, b.n).to_pylist()):
                for r in ranges or ():
                    if r["key"] == keys[i]:
                        gone[b.words[i] + r["first"]] += 1
                        gone[b.words[i] + r["last"]] -= 1
            removed = np.cumsum(gone[:-1]) > 0
            kept = joined(b, ~removed)
            if not rejoin:
                own = batch.column("text").slice(b.first, b.n)
                same = pa.array(b.per_doc_words(removed) == 0)
                kept = pc.if_else(same, own.cast(pa.large_string()), kept)
            part = [batch.column(c).slice(b.first, b.n) for c in others]
            yield pa.RecordBatch.from_arrays([*part, pa.array(np.diff(b.words)), pa.array(b.per_doc_words(removed)), kept.cast(pa.string())], names=[*others, "n_words", "n_removed", "kept"])


def joined(b: T.Block, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    starts, lens = b.starts[keep], (b.ends - b.starts)[keep] + 1
    total = np.concatenate(([0], np.cumsum(lens)))
    take = np.arange(total[-1]) - np.repeat(total[:-1] - starts, lens)
    buf = np.append(b.buf, np.uint8(32))[take] if len(take) else np.zeros(0, np.uint8)
    buf[total[1:] - 1] = 32
    counts = np.concatenate(([0], np.cumsum(keep)))[b.words]
    edges = total[counts]
    data = memoryview(buf)
    return pa.array([bytes(data[i : max(i, j - 1)]) for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.large_binary()).cast(pa.large_string())


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each row's text without the words under windows that also start in a smaller doc_id.

    kept holds the other words joined by one space. Windows are judged on the input. A null text has no words; a text of fewer
    than `window` words loses none; a row with a null doc_id loses nothing and takes nothing from others. Rows that share a
    doc_id don't count as earlier than each other. Other columns are not read, whatever their names. An empty
    table gives no rows. A very long text is read whole, in a block of its own.
    """
    ranges = repeated_ranges(docs, window, run).groupBy("doc_id").agg(F.collect_set(F.struct("key", "first", "last")).alias("list"))
    rows = docs.select("doc_id", "text").join(ranges, "doc_id", "left").select("doc_id", "text", "list")
    return rows.mapInArrow(lambda batches: _without(batches, ["doc_id"], True), "doc_id long, n_words long, n_removed long, kept string")


def strip_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """The rows of docs with all their columns, texts without repeated passages; a text that loses nothing stays as it is.

    Rows are as in remove_repeats(). A text that loses all its words stays as an empty text.
    """
    from pyspark.sql import types as ty

    ranges = repeated_ranges(docs, window, run).groupBy("doc_id").agg(F.collect_set(F.struct("key", "first", "last")).alias("list"))
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    doc, text = f"c{columns.index('doc_id')}", f"c{columns.index('text')}"
    rows = plain.withColumnRenamed(text, "text").join(ranges.withColumnRenamed("doc_id", "of"), F.col(doc) == F.col("of"), "left").drop("of")
    others = [c for c in plain.columns if c != text]
    fields = [ty.StructField(c, plain.schema[c].dataType) for c in others]
    schema = ty.StructType([*fields, ty.StructField("n_words", ty.LongType()), ty.StructField("n_removed", ty.LongType()), ty.StructField("kept", ty.StringType())])
    done = rows.mapInArrow(lambda batches: _without(batches, others, False), schema)
    return done.select(*[F.col("kept" if f"c{i}" == text else f"c{i}").alias(c) for i, c in enumerate(columns)])
