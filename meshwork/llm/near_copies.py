"""SimHash near-dedup of word shingles, for corpora in which a pair may share as little as 0.8 of its five-word shingles.

Candidates are found in two ways, and each is verified by counting the shingles that both have. The SimHash operator
joins fingerprints of the shingle sets by their pivot distance tables, which finds the copies that differ least. But at a
similarity of 0.8 some ten of the 64 bits differ, and no distance table tells such pairs from any others: so documents
that share one of their rarest shingles meet as well (a prefix-filter join), which no pair of that similarity escapes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import links, majority_bits, shingle_hashes

#: Bytes of text of a block, and shingles of a hash range, on average.
BLOCK_BYTES, RANGE_SHINGLES = 4 << 20, 1 << 20


def _sets(texts, size: int) -> list[np.ndarray]:
    """The different shingle hashes of each text, in order."""
    return [np.unique(shingle_hashes((t or "").encode("utf-8", "surrogatepass").lower().split(), size)) for t in texts]


def _slices(batches, rows: int = 512):
    """Arrow batches of at most so many rows, whose sets are in memory at once."""
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))


def _digests(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, digest of the set of shingles, fp (the set's SimHash)."""

    def make(batches):
        import hashlib

        import pyarrow as pa

        common.release()
        for b in _slices(batches):
            sets = _sets(b.column("text").to_pylist(), size)
            fp = np.frombuffer(b"".join(map(majority_bits, sets)), dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array(fp)], names=["doc_id", "digest", "fp"])

    return docs.mapInArrow(make, "doc_id long, digest binary, fp long")


def rare_shingles(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """key (a shingle's hash), doc_id, n, place, alone, short: each document's rarest shingles that another has as well.

    Shingles are ordered by the number of documents that have them. Of two documents with a similarity high enough, the
    larger has one of the other's first n - ceil(2s / (1 + s) n) + 1 (short) among its first n - ceil(s n) + 1, whatever
    the order is. place is the shingle's in that order; alone is how many of the document's no other has.

    Blocks send their different hashes, four bytes each, to ranges; a range tells the blocks which of theirs are met
    again, and how often. A shingle that all documents have is sent once for each block."""
    import zstandard

    blocks = common.text_blocks(docs, "near_blocks", BLOCK_BYTES)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    power = max(0, math.ceil(math.log2(max(1, total / (6 * RANGE_SHINGLES)))))
    cut = np.uint64(32 - power)
    pack = lambda x: zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, dtype=np.uint32).tobytes())
    unpack = lambda x: np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=np.uint32)
    names = ["range", "block", "hashes", "times"]

    def send(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                common.release()
                block, payload = b.column("block")[i].as_py(), b.column("payload")[i].as_py()
                every = np.concatenate([np.empty(0, np.uint64), *_sets(common.unpack_table(payload).column("text").to_pylist(), size)])
                every, times = np.unique(every >> cut, return_counts=True)
                at = np.searchsorted(every, np.arange(1, 1 << power, dtype=np.uint64) << np.uint64(32))
                parts = [(r, x, k) for r, (x, k) in enumerate(zip(np.split(every, at), np.split(times, at))) if len(x)]
                del every, times
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array([pack(x & np.uint64(0xFFFFFFFF)) for _, x, _ in parts], pa.binary()), pa.array([pack(k) for _, _, k in parts], pa.binary())], names=names)
            common.release()

    def meet(t):
        import pyarrow as pa

        lists, times = ([unpack(x.as_py()) for x in t.column(c)] for c in ("hashes", "times"))
        every, back = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.bincount(back, np.concatenate(times), len(every))
        out, at = [], 0
        for block, x in zip(t.column("block").to_pylist(), lists):
            own = sums[back[at : at + len(x)]]
            at += len(x)
            again = own > 1
            if again.any():
                out.append((t.column("range")[0].as_py(), block, pack(x[again]), pack(np.minimum(own[again], 0xFFFFFFFF))))
        del lists, times, every, back, sums
        common.release()
        return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=names)

    def choose(t, met):
        import pyarrow as pa

        common.release()
        met = met.sort_by("range")
        known = np.concatenate([np.empty(0, np.uint64), *((np.uint64(r) << np.uint64(32)) | unpack(x).astype(np.uint64) for r, x in zip(met.column("range").to_pylist(), met.column("hashes").to_pylist()))])
        often = np.concatenate([np.empty(0, np.uint32), *(unpack(x) for x in met.column("times").to_pylist())])
        out = []
        for payload in t.column("payload").to_pylist():
            rows = common.unpack_table(payload)
            sets = _sets(rows.column("text").to_pylist(), size)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            every, of = np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(len(n)), n)
            count = np.ones(len(every), dtype=np.uint32)
            if len(known):
                at = np.minimum(np.searchsorted(known, every >> cut), len(known) - 1)
                count = np.where(known[at] == every >> cut, often[at], count)
            order = np.lexsort((every, count, of))
            place = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n)
            alone = np.bincount(of, count == 1, len(n)).astype(np.int64)
            first = lambda share: n - np.ceil(share * n - 1e-9).astype(np.int64) + 1
            every, of, count = every[order], of[order], count[order]
            use = (count > 1) & (place < first(similarity)[of])
            every, of, place = every[use], of[use], place[use]
            ids = rows.column("doc_id").combine_chunks().take(pa.array(of))
            short = place < first(2 * similarity / (1 + similarity))[of]
            out.append(pa.table([pa.array(every.view(np.int64)), ids, *(pa.array(x.astype(np.int32)) for x in (n[of], place, alone[of])), pa.array(short)], names=["key", "doc_id", "n", "place", "alone", "short"]))
        common.release()
        return pa.concat_tables(out) if out else pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())], names=["key", "doc_id", "n", "place", "alone", "short"])

    schema = "range long, block long, hashes binary, times binary"
    met = blocks.mapInArrow(send, schema).groupBy("range").applyInArrow(meet, schema)
    return blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(choose, "key long, doc_id long, n int, place int, alone int, short boolean")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are alike enough, counted."""

    def make(batches):
        import pyarrow as pa

        common.release()
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.tobytes() for s in _sets(b.column("text").to_pylist(), size)], pa.binary())], names=["doc_id", "shingles"])

    def verify(batches):
        import pyarrow as pa

        common.release()
        for t in _slices(batches):
            sure, held = [], (None, None)
            for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist()):
                if held[0] != x:
                    held = x, np.frombuffer(x, dtype=np.uint64)
                x, y = held[1], np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sure.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(sure, pa.bool_()))

    pairs = common.written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = common.written(docs.join(ends, "doc_id", "left_semi").mapInArrow(make, "doc_id long, shingles binary"), "shingles")
    side = lambda c, s: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(s))
    both = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _simhash_pairs(firsts: DataFrame) -> DataFrame:
    """a, b: candidates among firsts (first, fp): each with the first of its fingerprint, and the firsts of fingerprints within two bits."""
    of = common.written(firsts.groupBy("fp").agg(F.min("first").alias("low"), F.count(F.lit(1)).alias("n")), "fingerprints")
    same = firsts.join(of.filter("n > 1"), "fp").filter("first <> low").select(F.col("first").alias("a"), F.col("low").alias("b"))
    end = lambda c: of.select(F.col("fp").alias(c), F.col("low").alias(f"doc_{c}"))
    near = links(of.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    return same.union(near)


def near_links(own: DataFrame, size: int, similarity: float) -> DataFrame:
    """a, b: links between rows of own (doc_id: different and not null, text) that connect what all pairs of a high enough
    Jaccard similarity would.

    Equal sets are linked to the first of them, which stands for all. Then every document meets the neighbours of its
    fingerprint and, for each of its rare shingles, the most central document that has it; at last those that are not
    connected yet and share a rare shingle meet each other, unless their sizes or the shingle's places show that they
    can't be alike enough. So a group of copies costs a pair for each member and shingle, not one for each two members,
    and no pair is left out."""
    digests = common.written(_digests(own, size), "digests")
    firsts = common.written(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp")), "firsts")
    equal = common.written(digests.join(firsts.select("digest", "first"), "digest").filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "equal_links")
    members = rare_shingles(own, size, similarity).join(firsts.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    members = common.written(members.withColumn("rank", F.struct((F.col("alone") * 1000 / F.col("n")).cast("int").alias("share"), F.xxhash64("doc_id").alias("hash"), "doc_id", "n")), "rare_shingles")
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sized = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9
    hubs = members.groupBy("key").agg(F.min("rank").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = common.written(members.drop("rank").join(hubs, "key"), "shared_shingles")
    to_hub = members.filter("doc_id <> hub.doc_id").filter(sized(F.col("n"), F.col("hub.n"))).select(F.col("doc_id").alias("a"), F.col("hub.doc_id").alias("b"))
    found = common.written(_verified(ordered(to_hub.union(_simhash_pairs(firsts))), own, size, similarity), "hub_links").union(equal)
    label = components(found).withColumnRenamed("node", "doc_id")
    open_ = members.join(label, "doc_id", "left").select("key", "doc_id", "n", "place", "short", F.coalesce("component", "doc_id").alias("label"))
    left = open_.filter("short").select("key", F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), F.col("label").alias("label_a"))
    right = open_.select("key", F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("label").alias("label_b"))
    # those before the first shared shingle can't be shared, so no more than the shorter rest is
    enough = (1 + similarity) * F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= similarity * (F.col("n_a") + F.col("n_b")) - 1e-6
    met = left.join(right, "key").filter("(n_a < n_b OR n_a = n_b AND a < b) AND label_a <> label_b").filter(sized(F.col("n_a"), F.col("n_b"))).filter(enough)
    return found.union(_verified(ordered(met), own, size, similarity))


def _rows(docs: DataFrame) -> DataFrame:
    """common.boxed(docs) with key: the doc_id where just one row has it; where several have it, or it is null, a hash of it
    and the text, so that repeated rows have one key."""
    rows = common.boxed(docs)
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = common.written(ids.filter("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("again")), "repeated_ids")
    own = F.when(F.col("doc_id").isNotNull() & F.col("again").isNull(), F.col("doc_id")).otherwise(F.xxhash64(F.lit("row"), "doc_id", "text"))
    return rows.join(repeated, F.col("doc_id") == F.col("again"), "left").withColumn("alone", F.col("doc_id").isNotNull() & F.col("again").isNull()).withColumn("key", own).drop("again")


def _groups(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """key, first (the key of the group's smallest doc_id; rows without one come last), group_id (that doc_id) of the rows that are linked to another."""
    different = rows.filter("alone").select("key", "doc_id", "text").union(rows.filter("NOT alone").select("key", "doc_id", "text").dropDuplicates(["key"]))
    reached = common.written(components(near_links(different.select(F.col("key").alias("doc_id"), "text"), size, similarity)), "reached")
    ids = different.select("key", "doc_id").join(reached.withColumnRenamed("node", "key"), "key")
    ids = common.written(ids, "linked")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    return ids.join(ids.groupBy("component").agg(least.alias("least")), "component").select("key", F.col("least.key").alias("first"), F.col("least.doc_id").alias("group_id"))


def near_copy_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, group_id (the smallest doc_id reachable over links) of the rows that are linked to another.

    Texts without words are linked to each other; a text of fewer words than a shingle is one shingle. Rows with the same
    doc_id and text are one row here; those with the same doc_id and other texts, and those without one, are rows of their
    own. An empty table gives no rows."""
    rows = _rows(docs)
    return _groups(rows, size, similarity).join(rows.select("key", "doc_id"), "key").select("doc_id", "group_id").distinct()


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, with one row of each group: that of the smallest doc_id (rows without one lose to all others; of
    several rows with it, one). Of repeated rows one stays. Columns may have any name."""
    rows = _rows(docs)
    gone = _groups(rows, size, similarity).filter("key <> first").select("key")
    kept = rows.join(gone, "key", "left_anti")
    return common.unboxed(kept.filter("alone").select("row").union(kept.filter("NOT alone").dropDuplicates(["key"]).select("row")))
