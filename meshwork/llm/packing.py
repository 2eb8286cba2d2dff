"""Packing: first-fit decreasing over a tournament tree of bin capacities, within randomised groups of documents."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 2048
#: Documents of a group, on average: a group is packed by one task and holds some 50 bytes for each piece.
GROUP = 8192
END_ID = 1
#: White-space chunks whose ids a worker remembers at once, some 200 bytes each.
MOST_CHUNKS = 600_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, group long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. The tree's leaves are the bins' free room and each inner node the larger of its two, so that the first bin with room is found by going down."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a > b else b
    return bins, offsets


class Ids:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The tokenizer ignores case and never joins across ASCII white space, nor a letter or digit with the mark after it.
    So each chunk between white space is encoded once and remembered, up to MOST_CHUNKS in a worker; new chunks of
    letters only are encoded as one text and told apart by the tokens that end a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.tokenizer, self.known = path, Tokenizer.from_file(path), {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _each(self, chunks: list[bytes]) -> None:
        for w, e in zip(chunks, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in chunks], add_special_tokens=False)):
            self.known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _letters(self, chunks: list[bytes]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(chunks).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(chunks):
            return self._each(chunks)
        data = ids.tobytes()
        self.known.update(zip(chunks, (data[a:b] for a, b in zip([0, *cuts], cuts))))

    def learn(self, new: set[bytes]) -> None:
        marked = {w for w in new if len(w) > 1 and w[-1:] in b".,;:!?" and w[-2:-1].isalnum()}
        bare = [w for w in {w[:-1] for w in marked} | {w[-1:] for w in marked} | (new - marked) if w not in self.known]
        letters = [w for w in bare if w.isalpha() or w.decode("utf-8", "replace").isalpha()]
        for at in range(0, len(letters), 512):
            self._letters(letters[at : at + 512])
        others = [w for w in bare if w not in self.known]
        for at in range(0, len(others), 4096):
            self._each(others[at : at + 4096])
        self.known.update((w, self.known[w[:-1]] + self.known[w[-1:]]) for w in marked)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        docs = [(d if b"<|" in d else d.lower()).split() for d in data]
        if len(self.known) > MOST_CHUNKS:
            self.known = {}
        known = self.known
        new = {w for d in docs for w in d if w not in known}
        if new:
            self.learn(new)
        return [b"".join([known[w] for w in d]) for d in docs]


def ids_of(path: str) -> Ids:
    """One for each worker process, which goes on over this operator's tasks."""
    if getattr(common.held.get("packing"), "path", None) != path:
        common.held["packing"] = Ids(path)
    return common.held["packing"]


def pieces(docs: DataFrame, tokenizer: str, groups: int, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: whole sequences first, then what is left. The group is a hash of the id."""
    import os

    import pyarrow as pa

    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = ids_of(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                keys, texts, group = (b.column(c).slice(at, 256).to_pylist() for c in ("doc_id", "text", "group"))
                rows: list[tuple] = []
                for k, g, data in zip(keys, group, ids.encode(texts)):
                    data += end
                    n = len(data) // 4
                    rows += [(k, s, min(length, n - s), zlib.crc32(data[4 * s : 4 * (s + length)]), n, g) for s in range(0, n, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "group"])
        common.release("packing")

    group = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id"), F.length("text")), F.lit(groups))
    return docs.select(F.col("doc_id").cast("long"), "text", group.alias("group")).mapInArrow(cut, PIECES)


def _pack(t):
    import pyarrow as pa

    sizes = t.column("length").to_numpy()
    order = np.lexsort((t.column("start").to_numpy(), t.column("doc_id").fill_null(-1).to_numpy()))
    t, sizes = t.take(pa.array(order)), sizes[order]
    bins, offsets = first_fit_decreasing(sizes, LENGTH)
    sequence = (t.column("group").to_numpy() << 32) + bins
    return t.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))


def pack(docs: DataFrame, tokenizer: str, group: int = GROUP) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document longer than a sequence fills whole sequences and leaves one shorter piece; each group's pieces go, longest
    first, to the first sequence with room. The number of groups follows the number of rows; a sequence belongs to one
    group, its id is group * 2^32 + its number there. Empty and null texts are the end id alone. Repeated rows are packed
    each; null doc_ids are packed like others. Only doc_id and text are read. Empty tables give no rows."""
    groups = max(1, round(docs.count() / group))
    return pieces(docs, tokenizer, groups).groupBy("group").applyInArrow(_pack, PACKED)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; nulls, very long texts, repeated rows and empty tables as in pack."""
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
