"""Substring dedup: rolling (Rabin-Karp) hashes of every window of 20 words; repeated windows merge into removal intervals.

Documents are packed into blocks. Each block sends the first bits of its different window hashes, sorted and compressed,
to hash ranges, where they are counted: most windows are met by no other block and are done. Of the rest each block sends
128 bits of hash with the window's first place, and is told which of them are the first of the corpus. Answers are one bit
for each hash sent, in its order. So a window costs two or three bytes of shuffle, a repeated one some twenty for each
block that has it, however often it is repeated, and no task holds more than a block or a range."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 20
#: Bytes of text of a block, and windows of a hash range, on average.
BLOCK_BYTES, RANGE_WINDOWS = 4 << 20, 1 << 20
#: Bits sent first beyond those that number the windows: one window in 2^SPARE meets another's bits by chance.
SPARE = 6
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The two halves of each word's 128-bit XXH3."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype="<u8").reshape(-1, 2)


def window_hashes(h: np.ndarray, half: int, starts: np.ndarray | None = None, size: int = WINDOW) -> np.ndarray:
    """64 bits for each run of size words (or those at starts), h having one half of each word's hash: their polynomial modulo 2^64, then mixed."""
    n = max(0, len(h) - size + 1) if starts is None else len(starts)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size if n else 0):
        out *= np.uint64(_BASES[half])
        out += h[i : i + n] if starts is None else h[starts + i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of n words the windows at starts cover: overlapping windows merge into maximal intervals."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.subtract.at(change, starts + size, 1)
    return np.cumsum(change[:n]) > 0


def _pack_bits(flags: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.packbits(flags).tobytes())


def _unpack_bits(data: bytes, n: int) -> np.ndarray:
    import zstandard

    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8), count=n).astype(bool)


class _Block:
    """The rows of a block by doc_id (null last) and their windows' hashes; made anew wherever it is needed."""

    def __init__(self, payloads: list[bytes], window: int, bits: int, ranges: int):
        import pyarrow as pa

        common.release()
        rows = pa.concat_tables([common.unpack_table(x) for x in payloads])
        self.rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.window, self.ranges, self.power = window, ranges, ranges.bit_length() - 1
        self.cut = np.uint64(bits - self.power)
        first, halves, n = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], []
        for x in self.rows.column("text"):
            h = word_hashes(_words(x.as_py()))
            n.append(len(h))
            first.append(window_hashes(np.ascontiguousarray(h[:, 0]), 0, size=window))
            halves.append(np.ascontiguousarray(h[:, 1]))
        self.lengths, self.n = np.array(n, dtype=np.int64), np.array([len(x) for x in first[1:]], dtype=np.int64)
        self.first, self.half = np.concatenate(first), np.concatenate(halves)
        del first, halves
        self.key = self.first >> np.uint64(64 - bits)
        ordered = np.sort(self.key)
        ends = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True)) if len(ordered) else np.empty(0, np.int64)
        self.keys, self.times = ordered[ends], np.diff(ends, prepend=-1)

    def row_and_start(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each window, and the word in it where the window starts."""
        ends = np.cumsum(self.n)
        row = np.searchsorted(ends, at, side="right")
        return row, at - (ends - self.n)[row]

    def by_range(self, sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
        """range, from, to of sorted keys."""
        ends = np.searchsorted(sorted_keys >> self.cut, np.arange(self.ranges + 1, dtype=np.uint64))
        return [(r, a, z) for r, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if z > a]

    def told(self, answers, sorted_keys: np.ndarray) -> np.ndarray:
        """The answers' bits for sorted keys."""
        own = dict(zip(answers.column("range").to_pylist(), answers.column("bits").to_pylist()))
        return np.concatenate([np.empty(0, bool), *(_unpack_bits(own[r], z - a) for r, a, z in self.by_range(sorted_keys))])

    def repeated(self, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows whose key is met elsewhere (met) or again here: their places, and their number among the
        different full hashes; of each full hash the first of these places, and whether its key is met elsewhere."""
        place = lambda w: np.searchsorted(self.keys, self.key[w])
        some = self.keys[met | (self.times > 1)]
        at = np.flatnonzero(some[np.minimum(np.searchsorted(some, self.key), len(some) - 1)] == self.key) if len(some) else np.empty(0, np.int64)
        row, start = self.row_and_start(at)
        full = np.empty(len(at), dtype=[("a", np.uint64), ("b", np.uint64)])
        full["a"], full["b"] = self.first[at], window_hashes(self.half, 1, (np.cumsum(self.lengths) - self.lengths)[row] + start, self.window)
        order = np.lexsort((at, full["b"], full["a"]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = full[order][1:] != full[order][:-1]
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        first = at[order[new]]
        self.full = full[order[new]]
        return at, number, first, met[place(first)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Removes each word that is covered by a window whose words also start earlier: in a smaller doc_id, or before in
    the same document. doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space); with texts, docs'
    own columns instead, where documents that lost words get the kept ones as text (and n_chars, if there is one).

    Null texts have no words. Rows with the same doc_id follow each other in some order; null doc_ids come last. Fewer
    words than a window are never removed. Windows are equal if 128 bits of hash are: among 10^13 windows two different
    ones are taken for equal with a chance of some 10^-13. The words of one text are in memory at once, some 100 bytes each. Other
    columns may have any name. An empty table gives no rows."""
    own = (docs if texts else docs.select("doc_id", "text")).withColumn("doc_id", F.col("doc_id").cast("long"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows = max(2, size // 6)
    ranges = 1 << max(0, math.ceil(math.log2(windows / RANGE_WINDOWS)))
    bits = min(64, max(math.ceil(math.log2(windows)) + SPARE, 16, ranges.bit_length()))
    blocks = common.text_blocks(own, "repeat_blocks", BLOCK_BYTES)
    none = np.uint64((1 << (bits - ranges.bit_length() + 1)) - 1)
    block_of = lambda payloads: _Block(payloads, window, bits, ranges)

    def send(batches):
        import pyarrow as pa

        for t in batches:
            for i in range(t.num_rows):
                block, b = t.column("block")[i].as_py(), block_of([t.column("payload")[i].as_py()])
                parts = [(r, common.pack_sorted(b.keys[x:z] & none)) for r, x, z in b.by_range(b.keys)]
                del b
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())], names=["range", "block", "hashes"])
            common.release()

    def meet(t):
        import pyarrow as pa

        lists = [common.unpack_sorted(x) for x in t.column("hashes").to_pylist()]
        _, back, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        met = np.split(times[back] > 1, np.cumsum([len(x) for x in lists])[:-1])
        del lists, back, times
        common.release()
        return pa.table({"range": t.column("range"), "block": t.column("block"), "bits": pa.array(map(_pack_bits, met), pa.binary())})

    def tell(t, answers):
        import pyarrow as pa

        b = block_of(t.column("payload").to_pylist())
        _, _, first, elsewhere = b.repeated(b.told(answers, b.keys))
        ids = b.rows.column("doc_id").fill_null((1 << 63) - 1).to_numpy()
        first, full = first[elsewhere], b.full[elsewhere]
        row, start = b.row_and_start(first)
        parts = [(r, common.pack_table(pa.table({"a": full["a"][x:z], "b": full["b"][x:z], "doc_id": ids[row[x:z]], "row": row[x:z].astype(np.int32), "start": start[x:z].astype(np.int32)}))) for r, x, z in b.by_range(b.key[first])]
        block = t.column("block")[0].as_py()
        del b
        common.release()
        return pa.table({"range": pa.array([r for r, _ in parts], pa.int64()), "block": pa.array([block] * len(parts), pa.int64()), "windows": pa.array([x for _, x in parts], pa.binary())})

    def decide(t):
        import pyarrow as pa

        blocks_ = t.column("block").to_numpy()
        lists = [common.unpack_table(x) for x in t.column("windows").to_pylist()]
        n = [len(x) for x in lists]
        full = pa.concat_tables(lists)
        a, b, ids, row, start = (full.column(c).to_numpy() for c in ("a", "b", "doc_id", "row", "start"))
        order = np.lexsort((start, row, np.repeat(blocks_, n), ids, b, a))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        is_first = np.empty(len(order), dtype=bool)
        is_first[order] = new
        del lists, full, a, b, ids, row, start, order, new
        common.release()
        return pa.table({"range": t.column("range"), "block": t.column("block"), "bits": pa.array(map(_pack_bits, np.split(is_first, np.cumsum(n)[:-1])), pa.binary())})

    def remove(t, answers):
        import pyarrow as pa
        import pyarrow.compute as pc

        b = block_of(t.column("payload").to_pylist())
        at, number, first, elsewhere = b.repeated(b.told(answers.filter(pc.equal(answers.column("turn"), 1)), b.keys))
        stays = np.ones(len(first), dtype=bool)
        stays[elsewhere] = b.told(answers.filter(pc.equal(answers.column("turn"), 2)), b.key[first[elsewhere]])
        again = np.zeros(len(b.first), dtype=bool)
        again[at] = ~(stays[number] & (first[number] == at))
        rows, lengths, cuts = b.rows, b.lengths, [0, *np.cumsum(b.n).tolist()]
        del b, at, number, first, elsewhere, stays
        common.release()
        removed, result = [], []
        for old, x, z in zip(rows.column("text"), cuts, cuts[1:]):
            words, starts = _words(old.as_py()) if not texts or again[x:z].any() else [], np.flatnonzero(again[x:z])
            gone = covered(starts, len(words), window) if len(starts) else None
            removed.append(0 if gone is None else int(gone.sum()))
            kept = b" ".join(words if gone is None else itertools.compress(words, ~gone))
            result.append((old.as_py() if gone is None else kept.decode("utf-8", "surrogatepass")) if texts else hashlib.sha256(kept).hexdigest())
        if not texts:
            return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(lengths), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(result, pa.string())})
        changed = {"text": pa.array(result, pa.string())}
        if "n_chars" in rows.column_names:
            changed["n_chars"] = pa.array([len(x) if n else old.as_py() for n, x, old in zip(removed, result, rows.column("n_chars"))], rows.schema.field("n_chars").type)
        return pa.table({c: changed.get(c, rows.column(c)) for c in rows.column_names})

    bits_of = "range long, block long, bits binary"
    met = common.written(blocks.mapInArrow(send, "range long, block long, hashes binary").groupBy("range").applyInArrow(meet, bits_of), "met_bits")
    sent = blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(tell, "range long, block long, windows binary")
    told = met.withColumn("turn", F.lit(1)).union(sent.groupBy("range").applyInArrow(decide, bits_of).withColumn("turn", F.lit(2)))
    result = own.schema if texts else "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(remove, result)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; nulls, ties, repeated rows and empty tables as in remove_repeats."""
    return remove_repeats(common.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS turn FROM s),
g AS (SELECT DISTINCT doc_id, i + o AS p FROM k, (SELECT unnest(range(20)) AS o) WHERE turn > 1),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text FROM t ANTI JOIN g USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
