"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is one of characters in running text, for each language: ORDER-grams of a text's words with a space between, with marks before
the text and after it, so the order of words and their repetition count. (Words on their own can be modelled as well.) Counts
come from all trusted documents. They and all that follows from them (continuation counts, discounts, back-off weights, probabilities)
are tables keyed by language and n-gram, which are never gathered: what documents need of them is joined in.

Documents are read in blocks. A task asks for each n-gram of a language once, in pieces dealt by n-gram; a piece's n-grams are
joined to the model's tables once for all tasks that ask, and answers go back in the order of the questions. The texts themselves
don't move: they wait in a table bucketed by task, which meets its answers without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kvloom.llm import filters, shared
from kvloom.llm import text as T
from kvloom.llm.tokens import spans

ORDER = 5
BEFORE, AFTER = "\x02", "\x03"
#: Characters that an n-gram never seen is spread over.
ALPHABET = 65536
#: Share of a language's trusted documents that must pass, and how far above that point the limit stands. A short text is drawn to its language's mean by PRIOR characters.
QUANTILE = 0.999
MARGIN = 1.05
PRIOR = 100
#: Perplexities fall into steps of this in their logarithm, for exact quantiles from bounded histograms.
STEP = 0.001
STEPS = 20_000
#: Up to so many trusted ids (8 bytes each) go to the executors; more are joined in a shuffle, to the same result.
BROADCAST_IDS = 1_000_000
KEY = ["lang", "gram"]
#: Places of a table that numbers n-grams; beyond that they are sorted.
TABLE = 1 << 22
#: n-grams that one task compares, of all that ask: pieces are as many as this takes.
PIECE = 300_000
#: Bytes of one language that make a block, and bytes of all languages that a task holds back until they do. A longer document is a block of its own.
BLOCK, HELD = 3 << 20, 12 << 20


def grams_of(units: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As numbered(), with the distinct n-grams as texts."""
    of, edges, codes = numbered(units)
    return of, edges, names(codes)


def names(codes: np.ndarray) -> list[str]:
    """Texts of rows of ORDER code points."""
    text = codes.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + ORDER] for i in range(0, len(text), ORDER)]


def codes_of(grams: list[str]) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(-1, ORDER)


def numbered(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, edges, distinct): of each unit's n-grams the number among the distinct ones, which are rows of code points in rising order; edges say where each unit's begin."""
    padded = [BEFORE * (ORDER - 1) + w + AFTER for w in units]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4")
    lens = np.array([len(p) for p in padded], np.int64)
    del padded
    first = np.cumsum(lens) - lens
    n = lens - ORDER + 1
    edges = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(edges[-1], dtype=np.int32)
    at += np.repeat((first - edges[:-1]).astype(np.int32), n)
    place = np.zeros(0x110000, np.int32)
    place[codes] = 1
    letters = np.flatnonzero(place)
    place[letters] = np.arange(len(letters))
    letter = place[codes]
    of, count = letter[at], len(letters)
    for j in range(1, ORDER):  # from numbers of shorter n-grams those of longer ones
        key = of.astype(np.int64) * len(letters) + letter[at + j]
        if count * len(letters) <= TABLE:
            number = np.zeros(count * len(letters), np.int32)
            number[key] = 1
            found = np.flatnonzero(number)
            number[found] = np.arange(len(found))
            of, count = number[key], len(found)
            del number
        else:
            found, of = np.unique(key, return_inverse=True)
            of, count = of.ravel().astype(np.int32), len(found)
        del key, found
    where = np.empty(count, np.int32)
    where[of] = at
    return of, edges, codes[where[:, None] + np.arange(ORDER, dtype=np.int32)]


def _packed_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of code points (21 bits each) as two integers, in the same order."""
    high, low = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    for j in range(ORDER):
        part = high if j < 3 else low
        part <<= 21
        part |= codes[:, j]
    return high, low


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows in rising order, of each row its number among them)."""
    high, low = _packed_codes(codes)
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return codes[order[new]], number


def _shard(codes: np.ndarray, count: int) -> np.ndarray:
    high, low = _packed_codes(codes)
    return (T.mix(high.astype(np.uint64) ^ T.mix(low.astype(np.uint64) + np.uint64(1))) % np.uint64(count)).astype(np.int64)


def _shut(codes: np.ndarray) -> bytes:
    """n-grams in rising order as a few bytes each."""
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress(codes.astype("<u4").tobytes().decode("utf-32-le").encode())


def _open(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data).decode().encode("utf-32-le"), "<u4").reshape(-1, ORDER)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows of one language at a time, gathered over batches."""
    held: dict[str, list[pa.RecordBatch]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        langs = np.array(["" if x is None else x for x in batch.column("lang").to_pylist()], object)
        for lang in sorted(set(langs)):
            part = batch.take(pa.array(np.flatnonzero(langs == lang)))
            held.setdefault(lang, []).append(part)
            size[lang] = size.get(lang, 0) + part.nbytes
        for lang in sorted(size, key=lambda x: (-size[x], x)):
            if size[lang] < BLOCK and sum(size.values()) <= HELD:
                break
            size.pop(lang)
            yield lang, pa.concat_batches(held.pop(lang))
    for lang in sorted(held):
        yield lang, pa.concat_batches(held[lang])


def _vocabulary(b: T.Block) -> tuple[np.ndarray, list[str]]:
    """Of each word its number, and the distinct words, the most frequent first."""
    buf = b.buf.copy()
    buf[T.IS_SPACE[buf]] = 32
    found = spans(buf, b.starts)
    del buf
    numbers, ends = np.asarray(found.indices), found.dictionary.to_pylist()
    del found
    # words before a run of spaces or the end of a text are the same words
    distinct: dict[str, int] = {}
    same = np.array([distinct.setdefault(w.strip(" "), len(distinct)) for w in ends], np.int32)
    del ends
    numbers = same[numbers]
    order = np.argsort(-np.bincount(numbers, minlength=len(distinct)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    names = list(distinct)
    return rank[numbers], [names[i] for i in order]


def _units(b: T.Block, running: bool) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of each unit its number, the distinct units, and how many each document has: its words, or all of them in turn with a space between as one unit."""
    if not running:
        numbers, words = _vocabulary(b) if len(b.starts) else (np.zeros(0, np.int32), [])
        return numbers, words, np.diff(b.words)
    distinct: dict[bytes, int] = {}
    numbers, has = [], np.diff(b.words) > 0
    data = b.buf.tobytes()
    for i in np.flatnonzero(has):
        numbers.append(distinct.setdefault(b" ".join(data[b.offsets[i] : b.offsets[i + 1]].split()), len(distinct)))
    return np.array(numbers, np.int32), [t.decode() for t in distinct], has.astype(np.int64)


def _counted(running: bool):
    """n-gram counts of blocks of trusted text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in _by_language(batches):
            for b in T.blocks(own.column("text"), BLOCK):
                if not len(b.starts):
                    continue
                numbers, units, _ = _units(b, running)
                of, edges, grams = grams_of(units)
                weight = np.repeat(np.bincount(numbers, minlength=len(units)), np.diff(edges))
                n = np.bincount(of, weights=weight, minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    return rows


def model(trusted: DataFrame, running: bool = False) -> tuple[DataFrame, DataFrame]:
    """((lang, gram, p), (lang, gram, weight)) from rows (lang, text): probabilities of all n-grams of 1 to ORDER characters, and back-off weights of contexts.

    With running, n-grams are those of whole texts, across the ends of words; without, of each word on its own."""
    with shared.scratch():
        return _model(trusted, running)


def _model(trusted: DataFrame, running: bool) -> tuple[DataFrame, DataFrame]:
    counts = trusted.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(_counted(running), "lang string, gram string, n long").groupBy(*KEY).agg(F.sum("n").alias("n"))
    orders = {ORDER: shared.written(counts, "grams")}
    for k in range(ORDER - 1, 0, -1):  # how many different characters stand before it
        orders[k] = shared.written(orders[k + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), "grams")
    tables, weights = [], []
    lower = None
    for k in range(1, ORDER + 1):
        grams = orders[k].withColumn("context", F.expr("left(gram, length(gram) - 1)"))
        ones = grams.groupBy("lang").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)])
        y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))

        def discount(i: int, y=y):
            value = F.when((F.col(f"t{i}") > 0) & (F.col("t1") > 0), i - (i + 1) * y * F.col(f"t{i + 1}") / F.when(F.col(f"t{i}") > 0, F.col(f"t{i}")))
            return F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), F.coalesce(value, F.lit(0.5 * i)))).alias(f"d{i}")

        discounts = ones.select("lang", discount(1), discount(2), discount(3))
        seen = [F.count_if(F.col("n") == 1).alias("s1"), F.count_if(F.col("n") == 2).alias("s2"), F.count_if(F.col("n") > 2).alias("s3")]
        contexts = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), *seen).join(F.broadcast(discounts), "lang")  # one row a language
        contexts = contexts.withColumn("weight", (F.col("d1") * F.col("s1") + F.col("d2") * F.col("s2") + F.col("d3") * F.col("s3")) / F.col("total"))
        own = grams.join(contexts, ["lang", "context"])
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        share = F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")
        if lower is None:
            probable = own.select("lang", "gram", (share + F.col("weight") / ALPHABET).alias("p"))
        else:
            below = lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("q"))
            probable = own.withColumn("rest", F.expr("substring(gram, 2)")).join(below, ["lang", "rest"]).select("lang", "gram", (share + F.col("weight") * F.col("q")).alias("p"))
        lower = shared.written(probable, "probabilities", keep=True)
        tables.append(lower)
        weights.append(contexts.select("lang", F.col("context").alias("gram"), "weight"))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    back = weights[0]
    for w in weights[1:]:
        back = back.unionByName(w)
    return every, shared.written(back, "weights", keep=True)


ASKED = ["lang", "shard", "gram"]


def answers(asked: DataFrame, probabilities: DataFrame, weights: DataFrame) -> DataFrame:
    """asked (lang, shard, gram) of ORDER characters, each once, with logp: of its longest ending that was seen, times the back-off weights on the way there."""
    direct = asked.join(probabilities, KEY, "left")
    known = direct.filter("p IS NOT NULL").select(*ASKED, F.log("p").alias("logp"))
    new = direct.filter("p IS NULL").select(*ASKED)
    tails = new.select("lang", "shard", F.col("gram").alias("asked"), F.explode(F.sequence(F.lit(1), F.lit(ORDER))).alias("k"))
    ending = F.expr(f"substring(asked, {ORDER + 1} - k)")
    tails = tails.withColumn("gram", ending).withColumn("context", F.expr("left(gram, length(gram) - 1)"))
    found = tails.join(probabilities, KEY, "left").join(weights.withColumnRenamed("gram", "context"), ["lang", "context"], "left")
    steps = found.groupBy("lang", "shard", "asked").agg(F.sort_array(F.collect_list(F.struct("k", "p", "weight")), False).alias("s"))
    # from the longest down: weights add up until a probability is there; a context never seen weighs 1
    fold = """aggregate(s, named_struct('l', 0D, 'done', false), (a, x) -> if(a.done, a, if(x.p IS NOT NULL, named_struct('l', a.l + ln(x.p), 'done', true),
        named_struct('l', a.l + if(x.weight IS NULL, 0D, ln(x.weight)), 'done', false))))"""
    folded = steps.select("lang", "shard", F.col("asked").alias("gram"), F.expr(fold).alias("r"))
    logp = F.when(F.col("r.done"), F.col("r.l")).otherwise(F.col("r.l") - math.log(ALPHABET))
    return known.unionByName(folded.select(*ASKED, logp.alias("logp")))


#: Rows of a task: of each language the n-grams that it asks for (number ASKS, n of them), and blocks of documents.
BAGS = "task long, lang string, number int, n long, data binary"
ASKS = -1


def _row(task: int, lang: str, number: int, n: int, data: bytes) -> pa.RecordBatch:
    columns = [pa.array([task], pa.int64()), pa.array([lang]), pa.array([number], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["task", "lang", "number", "n", "data"])


def _bags(running: bool):
    """Blocks of documents as bags of units, and the distinct n-grams of each language."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        asked: dict[str, np.ndarray] = {}
        for lang, own in _by_language(batches):
            for b in T.blocks(own.column("text"), BLOCK):
                numbers, units, has = _units(b, running)
                if units:
                    codes = numbered(units)[2]
                    asked[lang] = _distinct(np.concatenate((asked[lang], codes)))[0] if lang in asked else codes
                # each document's units by number, as steps from one to the next
                numbers = np.sort((np.repeat(np.arange(b.n), has) << 32) | numbers)
                first = np.flatnonzero(np.diff(numbers >> 32, prepend=-1))
                numbers = (numbers & 0xFFFFFFFF).astype(np.int32)
                step = np.diff(numbers, prepend=np.int32(0))
                step[first] = numbers[first]
                ids = own.column("doc_id").slice(b.first, b.n)
                yield _row(task, lang, number, b.n, _packed(units, step, has, ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()))
                number += 1
        for lang, codes in asked.items():
            yield _row(task, lang, ASKS, len(codes), _shut(codes))

    return rows


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task asks for (task, lang, data, shards), dealt to shards."""
    for batch in batches:
        for task, lang, data, shards in zip(*(batch.column(c).to_pylist() for c in ("task", "lang", "data", "shards")), strict=True):
            codes = _open(data)
            of = _shard(codes, shards)
            order = np.argsort(of, kind="stable")
            edges = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
            found = [int(of[order[i]]) for i in edges[:-1]]
            parts = [_shut(codes[order[i:j]]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(found, pa.int64()), pa.array([task] * n, pa.int64()), pa.array(parts, pa.binary())], names=["lang", "shard", "task", "data"])


def _once(pieces: pa.Table) -> pa.Table:
    """The distinct n-grams of a shard."""
    codes = _distinct(np.concatenate([_open(d) for d in pieces.column("data").to_pylist()]))[0]
    n, grams = len(codes), names(codes)
    return pa.table({"lang": pa.array([pieces.column("lang")[0].as_py()] * n, pa.string()), "shard": pa.array([pieces.column("shard")[0].as_py()] * n, pa.int64()), "gram": pa.array(grams, pa.string())})


REPLIES = "task long, lang string, shard long, logs binary"


def _replies(pieces: pa.Table, answered: pa.Table) -> pa.Table:
    """Answers to the pieces of a shard, in the order of their n-grams."""
    asked = [_open(d) for d in pieces.column("data").to_pylist()]
    known = codes_of(answered.column("gram").to_pylist())
    number = _distinct(np.concatenate([known, *asked]))[1]
    logp = np.full(int(number.max()) + 1, np.nan, np.float32)
    logp[number[: len(known)]] = answered.column("logp").to_numpy()
    edges = len(known) + np.concatenate(([0], np.cumsum([len(a) for a in asked])))
    logs = [logp[number[i:j]].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"task": pieces.column("task"), "lang": pieces.column("lang"), "shard": pieces.column("shard"), "logs": pa.array(logs, pa.binary())})


def _packed(units: list[str], *arrays: np.ndarray) -> bytes:
    """Units as text, whose n-grams are numbered anew where they are scored, and arrays, the last of 8 bytes."""
    import zstandard

    texts = [u.encode() for u in units]
    arrays = (np.array([len(t) for t in texts], np.int64), *arrays)
    parts = [np.array([len(a) for a in arrays], "<i8").tobytes()]
    for i, a in enumerate(arrays):
        width = 8 if i == 4 else 4
        parts.append(a.astype(f"<i{width}").view(np.uint8).reshape(len(a), width).T.tobytes())  # bytes of one weight together
    return zstandard.ZstdCompressor(level=6).compress(b"".join(parts + texts))


def _unpacked(data: bytes) -> tuple[list[str], list[np.ndarray]]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes, at, out = raw[:40].view("<i8"), 40, []
    for i, n in enumerate(sizes):
        width = 8 if i == 4 else 4
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(f"<i{width}").ravel().astype(np.int64))
        at += n * width
    ends = at + np.cumsum(out[0])
    text = raw.tobytes()
    return [text[e - n : e].decode() for e, n in zip(ends.tolist(), out[0].tolist(), strict=True)], out[1:]


SCORES = "doc_id long, lang string, logp double, n long"


def _scored(bags: pa.Table, replies: pa.Table) -> pa.Table:
    """Log probability and n-grams of each document of a task."""
    out: dict[str, list[pa.Array]] = {"doc_id": [], "lang": [], "logp": [], "n": []}
    every = bags.select(["lang", "number", "data"]).to_pylist()
    asked = {r["lang"]: _open(r["data"]) for r in every if r["number"] == ASKS}
    answers_of: dict[str, list[tuple[int, bytes]]] = {}
    for r in replies.select(["lang", "shard", "logs"]).to_pylist():
        answers_of.setdefault(r["lang"], []).append((r["shard"], r["logs"]))
    known: dict[str, np.ndarray] = {}
    shards = dict(zip(replies.column("lang").to_pylist(), replies.column("shards").to_pylist(), strict=True))
    for lang, codes in asked.items():
        order = np.argsort(_shard(codes, shards.get(lang, 1)), kind="stable")
        logs = np.frombuffer(b"".join(x for _, x in sorted(answers_of.get(lang, []))), "<f4")
        if len(logs) != len(codes) or np.isnan(logs).any():
            raise RuntimeError("a task lacks answers")
        known[lang] = np.empty(len(codes))
        known[lang][order] = logs
    for r in sorted((r for r in every if r["number"] != ASKS), key=lambda r: r["number"]):
        lang = r["lang"]
        units, (step, units_in, missing, ids) = _unpacked(r["data"])
        total, grams_in = np.zeros(1), np.zeros(0, np.int64)
        if units:
            of, edges, codes = numbered(units)
            number = _distinct(np.concatenate((asked[lang], codes)))[1]
            total = np.concatenate(([0.0], np.cumsum(known[lang][number[len(asked[lang]) :]][of])))
            total, grams_in = total[edges[1:]] - total[edges[:-1]], np.diff(edges)
        first = np.concatenate(([0], np.cumsum(units_in)))
        run = np.concatenate(([0], np.cumsum(step)))
        doc = np.repeat(np.arange(len(ids)), units_in)
        numbers = run[1:] - run[first[:-1]][doc] if len(doc) else np.zeros(0, np.int64)
        out["doc_id"].append(pa.array(ids, pa.int64(), mask=missing.astype(bool)))
        out["lang"].append(pa.array([lang] * len(ids), pa.string()))
        out["logp"].append(pa.array(np.bincount(doc, weights=total[numbers], minlength=len(ids)).astype(np.float64)))
        out["n"].append(pa.array(np.bincount(doc, weights=grams_in[numbers], minlength=len(ids)).astype(np.int64)))
    kinds = {"doc_id": pa.int64(), "lang": pa.string(), "logp": pa.float64(), "n": pa.int64()}
    return pa.table({c: pa.chunked_array(out[c], kinds[c]) for c in out})


def scores(docs: DataFrame, probabilities: DataFrame, weights: DataFrame, running: bool = False) -> DataFrame:
    """doc_id, lang, logp, n of each row of documents: log probability of its words, or of its running text, and n-grams in it; running as the model was made."""
    with shared.scratch():
        return shared.written(_scores(docs, probabilities, weights, running), "scores", keep=True)


def _scores(docs: DataFrame, probabilities: DataFrame, weights: DataFrame, running: bool) -> DataFrame:
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    bags = shared.bucketed(texts.mapInArrow(_bags(running), BAGS), "bags", "task")
    asks = bags.filter(F.col("number") == ASKS)
    shards = asks.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / PIECE)).cast("long").alias("shards"))
    shards = shared.written(shards, "shards")  # one row a language
    dealt = asks.join(F.broadcast(shards), "lang").select("task", "lang", "data", "shards")
    pieces = shared.written(dealt.mapInArrow(_pieces, "lang string, shard long, task long, data binary"), "pieces")
    asked = shared.written(pieces.groupBy("lang", "shard").applyInArrow(_once, "lang string, shard long, gram string"), "asked")
    answered = shared.written(answers(asked, probabilities, weights), "answers")
    left, right = pieces.groupBy("lang", "shard"), answered.groupBy("lang", "shard")
    replies = shared.written(left.cogroup(right).applyInArrow(_replies, REPLIES).join(F.broadcast(shards), "lang"), "replies")
    return bags.groupBy("task").cogroup(replies.groupBy("task")).applyInArrow(_scored, SCORES)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, prior: int = PRIOR) -> DataFrame:
    """One row for each row of documents: doc_id, lang, n_grams, perplexity, threshold, kept.

    Trusted documents are those that labels calls of quality 1 and not toxic; all of them train the model of their language.
    perplexity is exp of the mean of minus log p over the characters of a document's running text and `prior` more at its language's
    mean over trusted documents. A document is kept if it is not above its language's threshold: the exact `quantile` of trusted
    documents (in steps of 0.1 %) times `margin`. A text without words has its language's mean and is kept; a language without
    trusted documents has no threshold and keeps all. A null lang is a language of its own, shown as ''. Rows with a null doc_id
    are judged but never trusted. Repeated rows are judged each; labels may repeat. Other columns are not read, whatever their names.
    A very long text is read whole, in a block of its own. An empty table gives no rows; without trusted documents all are kept.
    """
    good = labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = shared.written(good, "trusted")
    known = docs.select("doc_id", "lang", "text").filter("doc_id IS NOT NULL")
    if good.count() <= BROADCAST_IDS:
        trusted = known.join(F.broadcast(good), "doc_id", "left_semi")
    else:
        trusted = filters.passes(known, "doc_id", filters.of(good, "doc_id")).join(good, "doc_id", "left_semi")
    with shared.scratch():
        done = shared.written(_scores(docs, *model(trusted, running=True), running=True), "scores", keep=True)
    mine = done.join(good, "doc_id", "left_semi").filter("n > 0")
    means = mine.groupBy("lang").agg((-F.sum("logp") / F.sum("n")).alias("mean"))

    def stepped(df: DataFrame) -> DataFrame:
        """With the step of each text's mean loss, drawn to its language's."""
        known = df.join(F.broadcast(means), "lang", "left")  # one row a language
        drawn = F.when(F.col("mean").isNull(), 0).otherwise(prior)
        loss = (-F.col("logp") + drawn * F.coalesce("mean", F.lit(0.0))) / F.greatest(F.col("n") + drawn, F.lit(1))
        return known.withColumn("step", F.floor(loss / STEP).cast("int"))

    histogram = stepped(mine).groupBy("lang", F.least("step", F.lit(STEPS)).alias("step")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy("lang").orderBy("step"))
    cumulated = histogram.withColumn("upto", upto).withColumn("all", F.sum("c").over(W.partitionBy("lang")))
    limits = cumulated.filter(F.col("upto") >= F.ceil(quantile * F.col("all"))).groupBy("lang").agg(F.min("step").alias("limit"))
    limits = limits.select("lang", F.floor(F.col("limit") + math.log(margin) / STEP).cast("int").alias("limit"))
    judged = stepped(done).join(F.broadcast(limits), "lang", "left")  # one row a language
    kept = F.coalesce(F.col("step") <= F.col("limit"), F.lit(True))
    perplexity, threshold = F.exp(F.col("step") * STEP), F.exp(F.col("limit") * STEP)
    return judged.select("doc_id", "lang", F.col("n").alias("n_grams"), perplexity.alias("perplexity"), threshold.alias("threshold"), kept.alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns, whatever their names. Of rows that share a doc_id all go if one does; rows with a null doc_id stay."""
    rejected = shared.fresh(docs.columns, "rejected")
    bad = classify(docs, labels).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(rejected)).distinct()
    return docs.join(bad, docs["doc_id"] == bad[rejected], "left_anti")
