"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, with DataFrame and SQL functions only.

A paragraph here is what stands between line ends and ends of sentences; a text is the set of the 64-bit digests of its paragraphs.
A sketch has CELLS cells of (count, xor of digests, xor of checks); a digest goes to one cell in each of ROWS rows. The fingerprint
is that sketch of the whole text. The sketch of one version minus that of another holds just what differs, and peeling recovers it:
a cell with count 1 or -1 whose check fits its digest gives a digest, which is taken from its cells, until nothing is left.

If cells are left, the sketch was too small, and a larger one is made of both versions: digests are dealt by their bits to parts
with a sketch each, as many as the sets could call for, which are subtracted and peeled in turn. Only parts that fail again are
split further, so the work follows the size of the difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kvloom.llm import shared

#: Rows, and bits of a cell's place in its row: in a fingerprint, and in the parts of larger sketches.
ROWS, PLACE_BITS, PART_BITS = 3, 2, 3
CELLS = ROWS << PLACE_BITS
#: Digests of both versions that a part is meant for, the most parts that one is split to, and tries; parts multiply from try to try.
PART_ITEMS, SPLIT_BITS, TRIES = 10, 6, 10
SPLIT = 1 << SPLIT_BITS
#: Seeds of checks, places and parts.
CHECK, PLACES, PARTS = 99, 101, 7
#: Where one paragraph ends and the next begins, and what a paragraph must hold.
BREAK = r"(?<=[.!?])[ \t\r]+|\n+"
HOLDS = r"[^\x20\x09-\x0D]"


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text that hold more than white space."""
    parts = F.filter(F.split(text, BREAK), lambda p: p.rlike(HOLDS))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def let(name: str, value: str, body: str) -> str:
    """SQL of body, in which the name stands for the value, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _items(keys: str) -> str:
    """Digests with their checks, places and parts."""
    return f"transform({keys}, k -> named_struct('k', k, 'c', xxhash64(k, {CHECK}), 'h', xxhash64(k, {PLACES}), 'g', xxhash64(k, {PARTS})))"


def _place(h: str, level: str, row: int, bits: int) -> str:
    return f"cast(shiftrightunsigned({h}, {ROWS * bits} * ({level} % 7) + {bits * row}) & {(1 << bits) - 1} as int)"


def sketch(items: str, level: str = "0", bits: int = PLACE_BITS) -> str:
    """Cells (n, k, c) of items, row after row; each level (SQL of a number) has places of its own."""
    places = ", ".join(f"'{name}', {_place('x.h', level, row, bits)}" for row, name in enumerate("xyz"))
    rows = [
        f"transform(sequence(0, {(1 << bits) - 1}), i -> aggregate(filter(o, x -> x.{name} = i), "
        "named_struct('n', 0, 'k', 0L, 'c', 0L), (a, x) -> named_struct('n', a.n + 1, 'k', a.k ^ x.k, 'c', a.c ^ x.c)))"
        for name in "xyz"
    ]
    return let("o", f"transform({items}, x -> named_struct('k', x.k, 'c', x.c, {places}))", f"concat({', '.join(rows)})")


def subtracted(first: str, second: str) -> str:
    """Cells of one sketch minus those of another, with their places; empty cells are left out."""
    minus = f"zip_with({first}, {second}, (u, v) -> named_struct('n', u.n - v.n, 'k', u.k ^ v.k, 'c', u.c ^ v.c))"
    placed = f"transform({minus}, (c, i) -> named_struct('i', i, 'n', c.n, 'k', c.k, 'c', c.c))"
    return f"filter({placed}, c -> c.n <> 0 OR c.k <> 0L OR c.c <> 0L)"


def peeled(cells: str, level: str = "0", bits: int = PLACE_BITS) -> str:
    """(left, p, m): the cells that stay after peeling, and the digests recovered with count 1 and -1."""
    pure = f"get(filter(a.left, c -> abs(c.n) = 1 AND xxhash64(c.k, {CHECK}) = c.c), 0)"
    places = ", ".join(f"'{name}', {_place(f'xxhash64(q.k, {PLACES})', level, row, bits)} + {row << bits}" for row, name in enumerate("xyz"))
    found = f"transform(array({pure}), q -> if(q IS NULL, NULL, named_struct('n', q.n, 'k', q.k, 'c', q.c, {places})))"
    taken = (
        "filter(transform(a.left, c -> if(c.i = q.x OR c.i = q.y OR c.i = q.z, "
        "named_struct('i', c.i, 'n', c.n - q.n, 'k', c.k ^ q.k, 'c', c.c ^ q.c), c)), c -> c.n <> 0 OR c.k <> 0L OR c.c <> 0L)"
    )
    more = f"named_struct('left', {taken}, 'p', if(q.n > 0, concat(a.p, array(q.k)), a.p), 'm', if(q.n < 0, concat(a.m, array(q.k)), a.m), 'done', false)"
    step = f"get(transform({found}, q -> if(q IS NULL, named_struct('left', a.left, 'p', a.p, 'm', a.m, 'done', true), {more})), 0)"
    none = "cast(array() as array<bigint>)"
    start = f"named_struct('left', z, 'p', {none}, 'm', {none}, 'done', size(z) = 0)"
    return let("z", cells, f"aggregate(sequence(0, size(z)), {start}, (a, t) -> if(a.done, a, {step}))")


def _split(pair: str, level: str) -> str:
    """Pairs of sets (a, b) dealt to parts by the bits of their digests; parts without digests are left out."""
    parts = f"greatest(2, least({SPLIT}, (size({pair}.a) + size({pair}.b)) div {PART_ITEMS}))"
    here = lambda side: f"filter({pair}.{side}, x -> pmod(shiftrightunsigned(x.g, {SPLIT_BITS} * {level}), w) = t)"
    dealt = f"transform(sequence(0, w - 1), t -> named_struct('a', {here('a')}, 'b', {here('b')}))"
    return let("w", parts, f"filter({dealt}, y -> size(y.a) > 0 OR size(y.b) > 0)")


def difference(sets: str, first: str, second: str) -> str:
    """SQL of (p, m), the digests in the first set alone and in the second alone: recovered from the difference of their sketches
    `first` and `second`, and where these are too small from larger ones. `sets` is a struct (a, b) of items."""
    one = peeled(subtracted(sketch("v.a", "level", PART_BITS), sketch("v.b", "level", PART_BITS)), "level", PART_BITS)
    tried = let("r", one, "named_struct('failed', size(r.left) > 0, 'p', r.p, 'm', r.m)")
    again = "filter(zip_with(s.todo, done, (v, u) -> if(u.failed, v, NULL)), v -> v IS NOT NULL)"
    todo = f"flatten(transform({again}, v -> {_split('v', 'level')}))"
    got = lambda side: f"concat(s.{side}, flatten(transform(filter(done, u -> NOT u.failed), u -> u.{side})))"
    step = let("done", f"transform(s.todo, v -> {tried})", f"named_struct('todo', {todo}, 'p', {got('p')}, 'm', {got('m')})")
    none = "cast(array() as array<bigint>)"
    start = f"named_struct('todo', {_split('v0', '0')}, 'p', {none}, 'm', {none})"
    end = "if(size(s.todo) = 0, named_struct('p', s.p, 'm', s.m), raise_error('paragraph digests agree in too many bits'))"
    larger = f"aggregate(sequence(1, {TRIES}), {start}, (s, level) -> if(size(s.todo) = 0, s, {step}), s -> {end})"
    small = let("r0", peeled(subtracted(first, second)), f"if(size(r0.left) = 0, named_struct('p', r0.p, 'm', r0.m), {larger})")
    return let("v0", sets, small)


def printed(cells: str) -> str:
    """Hexadecimal text of a sketch: count, digest and check of each cell."""
    return f"array_join(transform({cells}, c -> concat(lpad(hex(c.n), 8, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.c), 16, '0'))), '')"


def parsed(fingerprint: str) -> str:
    """The cells of a fingerprint."""
    value = lambda at, n, kind: f"cast(conv(substring({fingerprint}, 40 * i + {at}, {n}), 16, -10) as {kind})"
    return f"transform(sequence(0, {CELLS - 1}), i -> named_struct('n', {value(1, 8, 'int')}, 'k', {value(9, 16, 'bigint')}, 'c', {value(25, 16, 'bigint')}))"


def differing(first: str, second: str) -> Column:
    """(p, m) of two fingerprint columns: the digests that one text alone has and that the other alone has, from the fingerprints
    and nothing else. Null if they differ by more than a sketch of that size can tell."""
    both = peeled(subtracted(parsed(first), parsed(second)))
    return F.expr(let("r", both, "if(size(r.left) = 0, named_struct('p', r.p, 'm', r.m), NULL)"))


def compare(versions: DataFrame, first: str, second: str, third: str) -> DataFrame:
    """versions with three columns of arrays of digests replaced by: fingerprint, edited_fingerprint (sketches of the first and the
    second), near_edited and near_next (likeness of the first to the second and to the third). Rows are worked on where they are."""
    kept = [c for c in versions.columns if c not in (first, second, third)]
    v, s, d, n = (shared.fresh(versions.columns, name) for name in ("items_", "sketches_", "edited_", "next_"))
    struct = lambda fields: "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"
    items = versions.select(*kept, F.expr(struct({"a": _items(f"`{first}`"), "b": _items(f"`{second}`"), "c": _items(f"`{third}`")})).alias(v))
    sketched = items.select(*kept, v, F.expr(struct({side: sketch(f"{v}.{side}") for side in "abc"})).alias(s))
    only = lambda other: F.expr(difference(f"named_struct('a', {v}.a, 'b', {v}.{other})", f"{s}.a", f"{s}.{other}"))
    apart = sketched.select(*kept, s, only("b").alias(d), only("c").alias(n))
    total = lambda side: f"aggregate(slice({s}.{side}, 1, {1 << PLACE_BITS}), 0, (x, c) -> x + c.n)"  # noqa: E731  each row of a sketch counts every digest
    # common digests as a share of all; 1 where neither text has any
    share = lambda side, alone: F.expr(let("e", f"{total(side)} + size({alone}.p)", f"if(e = 0, 1D, ({total('a')} - size({alone}.p)) / e)"))
    return apart.select(
        *kept, F.expr(printed(f"{s}.a")).alias("fingerprint"), F.expr(printed(f"{s}.b")).alias("edited_fingerprint"),
        share("b", d).alias("near_edited"), share("c", n).alias("near_next"),
    )


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) for distinct ids that are not null: the next larger one, after the last the first.

    Ids are dealt to ranges; only the least id of each range meets in one place (the driver, a number a partition).
    """
    ranged = shared.written(ids.repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("block")), "ranges")
    least = sorted((r["block"], r["least"]) for r in ranged.groupBy("block").agg(F.min("doc_id").alias("least")).collect())
    after = {b: least[(i + 1) % len(least)][1] for i, (b, _) in enumerate(least)}
    beyond = F.create_map(*[F.lit(x) for b, n in after.items() for x in (b, n)]) if after else F.create_map(F.lit(0), F.lit(0))
    inside = F.lead("doc_id").over(W.partitionBy("block").orderBy("doc_id"))
    return ranged.select("doc_id", F.coalesce(inside, beyond[F.col("block")]).cast("long").alias("next_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many, or all, of the next document by
    doc_id, after the last by those of the first. near_* is the share of common paragraphs, as peeling the difference of two
    sketches finds it. A null text is an empty one, with a fingerprint of zeros; two texts without paragraphs are alike (1).
    Rows that share a doc_id have the same next document; where that has several rows, the greatest text counts. A row with a
    null doc_id has nothing after it: its edited text ends in nothing, and it is compared with an empty text. Other columns are
    not read, whatever their names. Equal texts have equal fingerprints. An empty table gives no rows. A very long text is one
    row throughout, with work in proportion to its paragraphs.
    """
    # both uses of the texts read the same columns in the same way, so they share one shuffle
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    need = F.floor(F.char_length("text") / 2)
    sizes = texts.groupBy("doc_id").agg(F.max(need).alias("need"))
    order = following(sizes.select("doc_id")).join(sizes, "doc_id").select(F.col("doc_id").alias("before"), "next_id", "need")
    given = texts.join(order, texts["doc_id"] == order["next_id"]).select("before", F.expr("left(text, cast(need as int))").alias("lead"), digests(F.col("text")).alias("third"))
    given = given.groupBy("before").agg(F.max(F.struct("lead", "third")).alias("g")).select("before", "g.*")
    both = texts.join(given, texts["doc_id"] == given["before"], "left").drop("before")
    nowhere = docs.filter(F.col("doc_id").isNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = both.unionByName(nowhere, allowMissingColumns=True)
    half = "cast(floor(char_length(text) / 2) as int)"
    edited = F.expr(f"concat(left(text, char_length(text) - {half}), left(coalesce(lead, ''), {half}))")
    versions = both.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"), "third").select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("first"), digests(F.col("edited")).alias("second"), F.coalesce("third", F.array().cast("array<long>")).alias("third"),
    )
    return compare(versions, "first", "second", "third")
