"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A sketch has three tables of cells; each digest is added to one cell of each table: a count, the XOR of the digests and
the XOR of their check hashes. Sketches of two versions subtract cell by cell, what both hold cancels, and peeling
recovers the digests that differ: a cell with one digest gives it away, which is then taken out of its other cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A paragraph: a line with its end, cut after every 240 code points.
PARAGRAPH = r"[^\n]{0,240}+\n++|[^\n]{1,240}+"
#: Cells of each of the three tables (powers of two): of a fingerprint, and of the tries after it.
CELLS, LARGER = 8, (8, 16, 64)
#: Digests that a block of both versions has on average, where the whole fingerprint can't be peeled.
BLOCK = 10
ROUNDS = 8
#: Documents of a bucket of neighbours, on average, and the most buckets that are broadcast (16 bytes each).
BUCKET, MOST_BROADCAST = 4096, 500_000


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column) -> Column:
    """The different 64-bit digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda s: F.xxhash64(s)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(0xFFFFFFFF))


def _entries(values: Column, n: int, cells: int) -> Column:
    """What each digest adds to its cells: n, x, c; and the cell's number in each of the three tables."""
    place = lambda d, j: F.call_function("shiftrightunsigned", d, F.lit(16 + 16 * j)).bitwiseAND(F.lit(cells - 1))
    return F.transform(values, lambda d: F.struct(F.lit(n).cast("long").alias("n"), d.alias("x"), _check(d).alias("c"), *(place(d, j).alias(f"i{j}") for j in range(3))))


def _cell(n: Column, x: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), x.alias("x"), c.alias("c"))


def _filled(entries: Column, cells: int) -> Column:
    zero = F.lit(0).cast("long")
    added = lambda a, e: _cell(a.n + e.n, a.x.bitwiseXOR(e.x), a.c.bitwiseXOR(e.c))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))
    table = lambda f: F.transform(numbers, lambda i: F.aggregate(F.filter(entries, lambda e: e[f] == i), _cell(zero, zero, zero), added))
    return F.concat(table("i0"), table("i1"), table("i2"))


def sketch(values: Column, cells: int = CELLS) -> Column:
    """The cells of the three tables, one after the other."""
    return _let(_entries(values, 1, cells), lambda e: _filled(e, cells))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: _cell(p.n - q.n, p.x.bitwiseXOR(q.x), p.c.bitwiseXOR(q.c)))


def difference_sketch(a: Column, b: Column, cells: int) -> Column:
    """subtract(sketch(a), sketch(b)): sketches are sums, so both versions' digests can be added at once, b's negatively."""
    return _let(F.concat(_entries(a, 1, cells), _entries(b, -1, cells)), lambda e: _filled(e, cells))


def peel(difference: Column, cells: int = CELLS) -> Column:
    """The digests (x) that differ, with n = 1 for the first version's and -1 for the second's; null if some can't be recovered."""

    def pure(state: Column) -> Column:
        alone = F.array_distinct(F.filter(state.cells, lambda c: (F.abs(c.n) == 1) & (_check(c.x) == c.c)))
        place = lambda c, j: F.call_function("shiftrightunsigned", c.x, F.lit(16 + 16 * j)).bitwiseAND(F.lit(cells - 1))
        return F.transform(alone, lambda c: F.struct(c.n.alias("n"), c.x.alias("x"), c.c.alias("c"), *((place(c, j) + j * cells).alias(f"i{j}") for j in range(3))))

    def without(state: Column, found: Column) -> Column:
        taken = lambda a, p: _cell(a.n - p.n, a.x.bitwiseXOR(p.x), a.c.bitwiseXOR(p.c))
        left = F.transform(state.cells, lambda c, i: F.aggregate(F.filter(found, lambda p: (p.i0 == i) | (p.i1 == i) | (p.i2 == i)), c, taken))
        return F.struct(left.alias("cells"), F.concat(state.found, F.transform(found, lambda p: F.struct(p.x.alias("x"), p.n.alias("n")))).alias("found"))

    def step(state: Column, _: Column) -> Column:
        return _let(pure(state), lambda found: F.when(F.size(found) == 0, state).otherwise(without(state, found)))

    none = F.expr("cast(array() as array<struct<x: bigint, n: bigint>>)")
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(difference.alias("cells"), none.alias("found")), step)
    return _let(end, lambda e: F.when(~F.exists(e.cells, lambda c: (c.n != 0) | (c.x != 0)), e.found))


def _split(values: Column, log_parts: Column) -> Column:
    """Blocks of the digests by their lowest bits, in two steps of at most 64 and the rest."""
    low = F.least(log_parts, F.lit(6))
    ways = lambda bits: F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), bits.cast("int")) - 1)
    mask = lambda bits: F.call_function("shiftleft", F.lit(1), bits.cast("int")).cast("long") - 1
    first = F.transform(ways(low), lambda b: F.filter(values, lambda d: d.bitwiseAND(mask(low)) == b))
    rest = lambda d: F.call_function("shiftrightunsigned", d, low.cast("int")).bitwiseAND(mask(log_parts - low))
    second = lambda part: F.transform(ways(log_parts - low), lambda b: F.filter(part, lambda d: rest(d) == b))
    return F.when(log_parts <= 6, first).otherwise(F.flatten(F.transform(first, second)))


def _block_changes(block: Column) -> Column:
    """Of one block: tries with more and more cells; at last the digests themselves."""
    tries = [peel(difference_sketch(block.a, block.b, m), m) for m in LARGER]
    plain = lambda have, other, n: F.transform(F.array_except(have, other), lambda d: F.struct(d.alias("x"), F.lit(n).cast("long").alias("n")))
    return F.coalesce(*tries, F.concat(plain(block.a, block.b, 1), plain(block.b, block.a, -1)))


def changes(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """The digests that only one version has. First from the two fingerprints; if these hold too many differences, from
    larger sketches of blocks of the digests, each tried again with more cells if it fails."""
    log_parts = F.least(F.greatest(F.ceil(F.log2((F.size(a) + F.size(b)) / BLOCK)), F.lit(0)), F.lit(15)).cast("int")
    blocks = _let(log_parts, lambda p: F.zip_with(_split(a, p), _split(b, p), lambda x, y: F.struct(x.alias("a"), y.alias("b"))))
    return F.coalesce(peel(subtract(sketch_a, sketch_b)), F.flatten(F.transform(blocks, _block_changes)))


def likeness(size_a: Column, size_b: Column, differing: Column) -> Column:
    """Shared paragraphs over all different ones of both; 1 for two texts without any."""
    both = size_a + size_b
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differing) / (both + differing))


def as_string(cells: Column, text: Column) -> Column:
    """The cells in base64 after a digest of the whole text, which tells apart texts with the same set of paragraphs."""
    hex_ = lambda v, n: F.lpad(F.hex(v), n, "0")
    body = F.array_join(F.transform(cells, lambda c: F.concat(hex_(c.n, 8), hex_(c.x, 16), hex_(c.c, 8))), "")
    return F.concat(hex_(F.xxhash64(text), 16), F.lit(":"), F.base64(F.unhex(body)))


def with_next(docs: DataFrame, value: str) -> DataFrame:
    """docs (doc_id and others) with `next`: the value of the next row in descending doc_id; the first row's after the last.

    Null doc_ids come last; rows with the same doc_id are ordered by a hash of the value. Rows are dealt to buckets of
    neighbouring ids; the first rows of each bucket are copied to the end of the bucket before it."""
    rank = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", [i / 64 for i in range(65)]).alias("at")).first()
    at = sorted(set(stats["at"] or [0]))
    inner = max(1, -(-stats["n"] // (BUCKET * 64)))
    lows, widths = F.array(*(F.lit(x).cast("long") for x in at)), F.array(*(F.lit(max(1, b - a)).cast("long") for a, b in zip(at, [*at[1:], at[-1] + 1])))
    coarse = F.greatest(F.size(F.filter(lows, lambda x: x <= rank)), F.lit(1))
    fine = F.least(F.greatest(F.floor((rank.cast("double") - F.element_at(lows, F.col("coarse"))) / F.element_at(widths, F.col("coarse")) * inner), F.lit(0)), F.lit(inner - 1))
    dealt = docs.withColumn("coarse", coarse).withColumn("bucket", F.col("coarse") * inner + fine).withColumn("rank", rank).drop("coarse")
    firsts = dealt.groupBy("bucket").agg(F.max("rank").alias("rank"))
    down = Window.orderBy(F.desc("bucket"))
    before = firsts.select(F.col("rank").alias("first"), F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(Window.partitionBy())).alias("before"))
    if stats["n"] <= MOST_BROADCAST * BUCKET:
        before = F.broadcast(before)
    marked = dealt.join(before, F.col("rank") == F.col("first"), "left")
    places = F.when(F.col("first").isNull(), F.array(F.struct(F.col("bucket"), F.lit(0).alias("ghost")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(0).alias("ghost")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("ghost"))))
    placed = marked.withColumn("place", F.explode(places)).drop("bucket", "first", "before").select("*", "place.bucket", "place.ghost").drop("place")
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc("rank"), "tie")
    return placed.withColumn("tie", F.xxhash64(F.col(value))).withColumn("next", F.lead(value).over(order)).filter("ghost = 0").drop("bucket", "ghost", "rank", "tie")


def versions(docs: DataFrame) -> DataFrame:
    """Fingerprints every text and its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_paragraphs, n_changed (paragraphs that only the text or only the edited text has).

    Null texts count as empty. A text without paragraphs has an empty sketch, like any other such. Likeness compares sets
    of paragraphs: repeats within a text count once. Repeated rows get a row each; ties and null doc_ids as in
    with_next. Only doc_id and text are read. An empty table gives no rows."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    both = with_next(texts.select("doc_id", F.struct("text", digests(F.col("text")).alias("d")).alias("own")), "own")
    n = F.length("own.text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("own.text", F.lit(1), n - cut), F.substring("next.text", F.lit(1), cut))
    t = both.select("doc_id", "own", F.col("next.d").alias("next"), n.cast("long").alias("n_chars"), edited.alias("edited"))
    t = t.withColumn("new", digests(F.col("edited")))
    t = t.withColumns({"s": sketch(F.col("own.d")), "s_new": sketch(F.col("new")), "s_next": sketch(F.col("next"))})
    t = t.withColumns({"to_edited": F.size(changes(F.col("own.d"), F.col("new"), F.col("s"), F.col("s_new"))), "to_next": F.size(changes(F.col("own.d"), F.col("next"), F.col("s"), F.col("s_next")))})
    return t.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("s"), F.col("own.text")).alias("fingerprint"),
        as_string(F.col("s_new"), F.col("edited")).alias("edited_fingerprint"),
        likeness(F.size("own.d"), F.size("new"), F.col("to_edited")).alias("near_edited"),
        likeness(F.size("own.d"), F.size("next"), F.col("to_next")).alias("near_next"),
        F.size("own.d").alias("n_paragraphs"),
        F.col("to_edited").alias("n_changed"),
    )


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(common.table(spark, sf_dir, "documents"))
