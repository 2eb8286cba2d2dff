"""SentencePiece encoding and decoding as a relational lattice over the different words of a corpus.

Substrings of each word, as long as the model's longest piece, are exploded and equi-joined to the piece table; the
edges found are grouped by word and folded with a higher-order aggregate. For a unigram model that is Viterbi's best sum
of scores. The public vocabulary is a BPE model, whose segmentation no sum of scores gives (the best sum agrees for some
56 % of the different words). Two folds give the library's own there: Viterbi whose steps are forbidden where merging
would join across the border (`allowed`: one path is left), and merging over the same edges (`merge`), which the
registered query takes since it costs half as much."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
#: Code points of the longest word that is folded (its places are the bits of a long); longer ones are merged with a heap, which gives the same ids.
LONGEST_WORD = 62
#: Bytes of text of a block, and of the corpus for each range of words, on average.
BLOCK_BYTES, RANGE_BYTES = 16 << 20, 4 << 20
#: Bytes of text that are split at once, and rows that a reading task gets at once: what a task holds beside its block.
SLICE_BYTES, BATCH_ROWS = 2 << 20, 512
#: Words whose ids are put in place at once.
SLICE_WORDS = 1 << 18
NEVER = 1e30


def merge_tree(word: str, score: dict[str, float]) -> list[tuple]:
    """BPE of a word of any length with a heap: its segments as (text, left part, right part); parts are None for a single code point."""
    n = len(word)
    left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    node: list[tuple] = [(c, None, None) for c in word]
    heap: list[tuple] = []

    def push(i: int) -> None:
        j = right[i]
        if j < n and (s := score.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (-s, i, j, end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if end[i] == j and j < n and end[j] == e and right[i] == j and left[j] == i:
            node[i] = (word[i:e], node[i], node[j])
            end[i], right[i], end[j] = e, right[j], -1
            if right[i] < n:
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
    out, i = [], 0
    while i < n:
        out.append(node[i])
        i = right[i]
    return out


class Pieces:
    """The piece table of a model file: a bounded one, whatever the corpus."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.size = n
        self.rows = [(p.id_to_piece(i), i, float(p.get_score(i))) for i in range(n) if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i))]
        self.longest = max(len(s) for s, _, _ in self.rows)
        self.bytes_ = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.unknown = p.unk_id()
        self.pairs = frozenset(s[i : i + 2] for s, _, _ in self.rows for i in range(len(s) - 1))
        #: Marks that no piece has after a letter.
        self.ends = frozenset(".,;:!?%&$#*|") - {b for a, b in self.pairs if a.isalpha()}
        self.ids = {s: i for s, i, _ in self.rows}
        self.score = {s: x for s, _, x in self.rows}

    def parts(self, piece: str) -> tuple[list[float], list[float]]:
        """Of the segments that merging forms at the piece's right and left end: at their length - 1 the cost of the merge that takes them in (NEVER for the piece itself); 0 where there is no segment."""
        ends = []
        for side in (2, 1):
            taken, (node,) = [0.0] * len(piece), merge_tree(piece, self.score)
            limit = NEVER
            while node:
                taken[len(node[0]) - 1] = limit
                limit, node = -self.score.get(node[0], 0.0), node[side]
            ends.append(taken)
        return ends[0], ends[1]

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, id, cost (minus the score), right and left (see parts)."""
        return spark.createDataFrame([(p, i, -s, *self.parts(p)) for p, i, s in self.rows], "piece string, id int, cost double, right array<float>, left array<float>")

    def named(self, segments) -> list[int]:
        """The ids of segments: a piece's own, or those of the bytes."""
        out: list[int] = []
        for x in segments:
            i = self.ids.get(x)
            out += [i] if i is not None else [self.bytes_[b] for b in x.encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown]
        return out


def words_of(text: str | None) -> list[str]:
    """The words of a text as the model sees it: spaces shown as marks, one added in front; a word is marks, made of spaces or
    the text's own, and what follows up to the next mark. No piece has a mark after anything else."""
    return re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE)) if text else []


def atoms_of(word: str, pieces: Pieces) -> tuple[str, ...]:
    """The word cut where no piece has the two characters on either side, so that no merge can join them."""
    if word[1:].isalpha():
        return (word,)
    if word[-1] in pieces.ends and word[1:-1].isalpha():
        return word[:-1], word[-1]
    cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pieces.pairs), len(word)]
    return tuple(word[x:y] for x, y in zip(cuts, cuts[1:]))


def edges(words: DataFrame, pieces: DataFrame, least: int, longest: int, fields: list[Column]) -> DataFrame:
    """range, word, ids, edges: of each word without ids the pieces of least code points and more that it contains (and
    with least = 1 each single code point, without a cost if it is no piece), as structs of the fields, sorted. Words must
    be different; each keeps a row."""
    s, e, n, open_ = F.col("s"), F.col("e"), F.length("word"), F.col("ids").isNull() & (F.length("word") >= least)
    starts = words.withColumn("s", F.explode(F.when(open_, F.sequence(F.lit(-1), n - least)).otherwise(F.array(F.lit(-1)))))  # -1 stands for the word itself
    spans = starts.withColumn("e", F.explode(F.when(s < 0, F.array(F.lit(0))).otherwise(F.sequence(s + least, F.least(s + longest, n)))))
    spans = spans.withColumn("piece", F.when(s >= 0, F.substring(F.col("word"), s + 1, e - s)))
    found = spans.join(F.broadcast(pieces), "piece", "left").filter("s < 0 OR cost IS NOT NULL" + (" OR e = s + 1" if least == 1 else ""))
    return found.groupBy("range", "word").agg(F.first("ids").alias("ids"), F.sort_array(F.collect_list(F.when(s >= 0, F.struct(*fields)))).alias("edges"))


def merge_fold(edges_: Column, length: Column) -> Column:
    """BPE: the bits of the borders that are left of a word after merging, from each code point's own segment. edges: cost,
    s, ends (bits of both borders), inner (bits of the places between); best first, then leftmost."""
    fits = lambda m, x: (m.bitwiseAND(x.ends) == x.ends) & (F.bit_count(m.bitwiseAND(x.inner)) == 1)

    def step(m: Column, _: Column) -> Column:
        inner = F.get(F.filter(edges_, lambda x: fits(m, x)), F.lit(0)).getField("inner")
        return F.coalesce(m.bitwiseAND(F.bitwise_not(inner)), m)

    every = F.call_function("shiftleft", F.lit(2).cast("long"), length.cast("int")) - 1
    return F.when(F.size(edges_) == 0, every).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), every, step))


def _limit(taken: Column, length: Column) -> Column:
    return F.coalesce(F.get(taken, length - 1), F.lit(0.0))


def _borders(edges_: Column, best: Column, length: Column) -> Column:
    """The bits of the borders on the path that ends at the last place; best has the number of each place's last edge."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
    end = F.struct(length.alias("at"), bit(length).alias("bits"))
    back = lambda at: F.get(edges_, F.get(best, at)).s
    step = lambda a, _: F.when(a["at"] > 0, F.struct(back(a["at"]).alias("at"), a["bits"].bitwiseOR(bit(back(a["at"]))).alias("bits"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), length), end, step, lambda a: a["bits"])


def viterbi_fold(edges_: Column, length: Column, missing: float = 1e6) -> Column:
    """Unigram: the bits of the borders on the path of the lowest summed cost; edges: e, s, cost, ..., in order; those without a cost have `missing`."""
    start = F.struct(F.array(F.lit(0.0)).alias("v"), F.array(F.lit(-1)).alias("last"))

    def step(state: Column, i: Column) -> Column:
        x = F.get(edges_, i)
        v = F.get(state.v, x.s) + F.coalesce(x.cost, F.lit(missing))
        put = lambda v, last: F.struct(v.alias("v"), last.alias("last"))
        known = F.size(state.v) > x.e
        return F.when(~known, put(F.concat(state.v, F.array(v)), F.concat(state["last"], F.array(i)))).when(v < F.get(state.v, x.e), put(F.concat(F.slice(state.v, F.lit(1), x.e), F.array(v)), F.concat(F.slice(state["last"], F.lit(1), x.e), F.array(i)))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), F.size(edges_) - 1), start, step, lambda a: _borders(edges_, a["last"], length))


def allowed_fold(edges_: Column, length: Column) -> Column:
    """BPE by Viterbi: the bits of the borders on the path whose every step is allowed; to each place there is just one.

    Two pieces stay apart unless some piece spans their border whose parts both sides form on their way, and whose merge
    comes before either is taken in: on the left strictly (of equal merges the left one is first)."""

    def step(last: Column, i: Column) -> Column:
        x = F.get(edges_, i)
        before = F.get(edges_, F.get(last, x.s))
        joins = F.exists(edges_, lambda m: (m.s < x.s) & (m.e > x.s) & (_limit(x.left, m.e - x.s) >= m.cost) & (_limit(before.right, x.s - m.s) > m.cost))
        return F.when(F.size(last) > x.e, last).when(x.s == 0, F.concat(last, F.array(i))).when(F.coalesce(joins, F.lit(False)), last).otherwise(F.concat(last, F.array(i)))

    return F.aggregate(F.sequence(F.lit(0), F.size(edges_) - 1), F.array(F.lit(-1)), step, lambda last: _borders(edges_, last, length))


def encoded_words(words: DataFrame, pieces: Pieces, parts: int, fold: str = "merge") -> DataFrame:
    """range, word, ids of words (word, range, ids; each word once and not empty), dealt to so many parts by range; words
    that have ids keep them. fold: `merge` or `allowed` for a BPE model (both give the library's ids), `unigram`."""
    import pyarrow as pa

    dealt, table, n = words.repartition(parts, "range"), pieces.table(words.sparkSession), F.length("word").cast("int")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
    s, e, cost = F.col("s"), F.col("e"), F.col("cost")
    if fold == "merge":
        lattice = edges(dealt, table.select("piece", "cost"), 2, pieces.longest, [cost, s, bit(s).bitwiseOR(bit(e)).alias("ends"), (bit(e) - bit(s + 1)).alias("inner")])
        borders = merge_fold(F.col("edges"), n)
    elif fold == "allowed":
        lattice = edges(dealt, table, 1, pieces.longest, [e, s, cost, F.col("right"), F.col("left")])
        borders = allowed_fold(F.col("edges"), n)
    else:
        lattice = edges(dealt, table.select("piece", "cost"), 1, pieces.longest, [e, s, cost])
        borders = viterbi_fold(F.col("edges"), n)

    def name(batches):
        for b in batches:
            found = []
            for w, m, ids in zip(*(b.column(c).to_pylist() for c in ("word", "borders", "ids"))):
                if ids is None:
                    at = [i for i in range(len(w) + 1) if m >> i & 1]
                    ids = pieces.named(w[x:y] for x, y in zip(at, at[1:]))
                found.append(ids)
            yield pa.RecordBatch.from_arrays([b.column("range"), b.column("word"), pa.array(found, pa.list_(pa.int32()))], names=["range", "word", "ids"])

    return lattice.select("range", "word", "ids", F.when(F.col("ids").isNull(), borders).alias("borders")).mapInArrow(name, "range long, word string, ids array<int>")


def _pack(array: np.ndarray) -> bytes:
    """zstd over the byte planes."""
    import zstandard

    planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_words(words: list[str]) -> bytes:
    """Words have no space, so one ends each of them."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress("".join([w + " " for w in words]).encode("utf-8", "surrogatepass"))


def _unpack_words(data: bytes) -> list[str]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass").split(" ")[:-1]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(lengths)
    out = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    full = np.flatnonzero(lengths)
    if len(full):
        first = ends[full] - lengths[full]
        out[first] = starts[full]
        out[first[1:]] -= starts[full[:-1]] + lengths[full[:-1]] - 1
    return np.cumsum(out)


def _numbered(texts) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """How many words each text has, the number of each word, and the different words. SLICE_BYTES of text are split at a time,
    and their words become Python's only after the slices' dictionaries have become one."""
    import pyarrow as pa

    counts, slices = [np.empty(0, np.int64)], []
    for held in common.sized(pa.table({"text": texts}).to_batches(), SLICE_BYTES):
        n, own = _numbered_slice(pa.Table.from_batches(held).column("text"))
        counts.append(n)
        slices.append(own)
    if not slices:
        return counts[0], np.empty(0, np.uint32), []
    slices = pa.chunked_array(slices).unify_dictionaries().chunks
    ids = np.concatenate([x.indices.to_numpy(zero_copy_only=False).astype(np.uint32) for x in slices])
    words = slices[-1].dictionary.to_pylist()
    del slices
    pa.default_memory_pool().release_unused()
    return np.concatenate(counts), ids, words


def _numbered_slice(texts):
    """How many words each text has, and the words, as an Arrow array with a dictionary."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.large_string())
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.or_(pc.ends_with(texts, " "), pc.equal(texts, "")), pc.match_substring(texts, SPACE)))
    parts = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    counts = np.where(odd.to_numpy(zero_copy_only=False), 0, pc.list_value_length(parts).to_numpy(zero_copy_only=False)).astype(np.int64)
    enc = parts.flatten().dictionary_encode()
    words = pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), enc.dictionary, pa.scalar("", pa.large_string()))
    ids = enc.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    strange = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(strange):
        keep = np.repeat(~odd.to_numpy(zero_copy_only=False), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        ids = ids[keep]
        place = {w: i for i, w in enumerate(words.to_pylist())}
        more, cuts = [], []
        for i in strange.tolist():
            found = [place.setdefault(w, len(place)) for w in words_of(texts[i].as_py())]
            counts[i] = len(found)
            more.append(np.array(found, dtype=np.int32))
            cuts.append(i)
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int32)
        is_odd = np.zeros(len(out), dtype=bool)
        is_odd[_ragged(starts[cuts], counts[cuts])] = True
        out[is_odd], out[~is_odd] = np.concatenate(more), ids
        ids, words = out, pa.array(list(place), pa.large_string())
    return counts, pa.DictionaryArray.from_arrays(pa.array(ids, pa.int32()), words)


def _atoms(words: list[str], pieces: Pieces) -> tuple[array, array, list[str]]:
    """How many atoms each word has, the number of each of them, and the different atoms."""
    place: dict[str, int] = {}
    many, used = array("I"), array("I")
    for w in words:
        cut = atoms_of(w, pieces)
        many.append(len(cut))
        used.extend([place.setdefault(x, len(place)) for x in cut])
    return many, used, list(place)


def _dealt(atoms: list[str], ranges: int) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """Each range with the packed list of its atoms, sorted, and the place of each atom in the lists one after the other."""
    of: dict[int, list[int]] = {}
    for i, x in enumerate(atoms):
        of.setdefault(zlib.crc32(x.encode("utf-8", "surrogatepass")) % ranges, []).append(i)
    number, lists, first = np.empty(len(atoms), dtype=np.uint32), [], 0
    for r in sorted(of):
        own = sorted(of.pop(r), key=atoms.__getitem__)
        number[own] = np.arange(first, first + len(own))
        lists.append((r, _pack_words([atoms[i] for i in own])))
        first += len(own)
    return lists, number


def encode(docs: DataFrame, model: str, fold: str = "merge") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), ids of each row, as the library encodes its text.

    Null and empty texts have no ids. Special pieces' names in a text are ordinary text; characters without a piece are
    their bytes'. Repeated rows get a row each. Only doc_id and text are read. An empty table gives no rows.

    Documents become blocks of word numbers. A block sends each range of words the different parts of its words that no
    piece joins (a packed list), and gets their ids back in the same order; the lattice sees each of them once."""
    pieces = Pieces(model)
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    kind = "<u2" if pieces.size <= 1 << 16 else "<u4"
    names = ["block", "range", "data"]

    def read(batches):
        """A row for each block (range -1) and one for each list of a block's word parts."""
        import pyarrow as pa
        from pyspark import TaskContext

        def rows(held):
            t = pa.Table.from_batches(held)
            counts, ids, words = _numbered(t.column("text"))
            many, used, atoms = _atoms(words, pieces)
            del words
            lists, number = _dealt(atoms, ranges)
            del atoms
            wide = max(many, default=0) >= 65536
            parts = [_pack(np.array(many, dtype=np.uint32 if wide else np.uint16)), _pack(number[np.array(used, dtype=np.uint32)]), _pack(counts), _pack(ids)]
            body = common.pack_table(pa.table({"doc_id": t.column("doc_id")}))
            data = pa.table({"ids": pa.array([body], pa.binary()), "wide": pa.array([wide]), **{f"p{i}": pa.array([x], pa.binary()) for i, x in enumerate(parts)}})
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([-1], pa.int64()), pa.array([common.pack_table(data)], pa.binary())], names=names)
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(lists), pa.int64()), pa.array([r for r, _ in lists], pa.int64()), pa.array([x for _, x in lists], pa.binary())], names=names)
            common.release()

        at = TaskContext.get().partitionId() << 24
        for held in common.sized(batches, BLOCK_BYTES):
            yield from rows(held)
            at += 1

    with common.batches_of(spark, BATCH_ROWS):
        table = common.bucketed(own.mapInArrow(read, "block long, range long, data binary"), "piece_blocks", "block", int(spark.conf.get("spark.sql.shuffle.partitions")), ["kind"], F.col("range") < 0)
    blocks, asked = table.filter("kind").select("block", "data"), table.filter("NOT kind").select("block", "range", "data")

    def different(t):
        import pyarrow as pa

        words: set[str] = set()
        for x in t.column("data"):
            words.update(_unpack_words(x.as_py()))
        words_ = sorted(words)
        long_ = [pieces.named(x for x, _, _ in merge_tree(w, pieces.score)) if len(w) > LONGEST_WORD else None for w in words_]
        return pa.table({"word": pa.array(words_, pa.string()), "range": pa.array([t.column("range")[0].as_py()] * len(words), pa.int64()), "ids": pa.array(long_, pa.list_(pa.int32()))})

    words = asked.groupBy("range").applyInArrow(different, "word string, range long, ids array<int>")

    def answer(t, w):
        import pyarrow as pa

        found = w.column("ids").combine_chunks() if w.num_rows else pa.array([], pa.list_(pa.int32()))
        flat, at = found.flatten().to_numpy().astype(kind), np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        place = {x: i for i, x in enumerate(w.column("word").to_pylist())}
        out = []
        for x in t.column("data"):
            of = np.array([place[y] for y in _unpack_words(x.as_py())], dtype=np.int64)
            lengths = (at[of + 1] - at[of]).astype(np.uint32)
            out.append(common.pack_table(pa.table({"n": pa.array([_pack(lengths)], pa.binary()), "ids": pa.array([_pack(flat[_ragged(at[of], lengths.astype(np.int64))])], pa.binary())})))
        return pa.table({"block": t.column("block"), "range": t.column("range"), "told": pa.array(out, pa.binary())})

    told = asked.groupBy("range").cogroup(encoded_words(words, pieces, ranges, fold).groupBy("range")).applyInArrow(answer, "block long, range long, told binary")

    def gather(t, answers):
        import pyarrow as pa

        lengths, flat = [np.empty(0, np.int64)], [np.empty(0, kind)]
        for x in answers.sort_by("range").column("told").to_pylist():
            a = common.unpack_table(x)
            lengths.append(_unpack(a.column("n")[0].as_py(), np.uint32).astype(np.int64))
            flat.append(_unpack(a.column("ids")[0].as_py(), kind))
        n_atom, ids_atom = np.concatenate(lengths), np.concatenate(flat)
        at_atom = np.cumsum(n_atom) - n_atom
        out = []
        for payload in t.column("data").to_pylist():
            p = common.unpack_table(payload)
            of_word = _unpack(p.column("p0")[0].as_py(), np.uint32 if p.column("wide")[0].as_py() else np.uint16).astype(np.int64)
            atoms = _unpack(p.column("p1")[0].as_py(), np.uint32)
            counts, numbers = _unpack(p.column("p2")[0].as_py(), np.int64), _unpack(p.column("p3")[0].as_py(), np.uint32)
            ids_word = ids_atom[_ragged(at_atom[atoms], n_atom[atoms])]
            ends = np.concatenate([[0], np.cumsum(n_atom[atoms])])
            first = np.cumsum(of_word) - of_word
            at_word, n_word = ends[first], ends[first + of_word] - ends[first]
            last = np.concatenate([[0], np.cumsum(n_word[numbers])])
            tokens = np.empty(last[-1], dtype="<i4")
            for a in range(0, len(numbers), SLICE_WORDS):
                part = numbers[a : a + SLICE_WORDS]
                tokens[last[a] : last[a + len(part)]] = ids_word[_ragged(at_word[part], n_word[part])]
            cuts = last[np.concatenate([[0], np.cumsum(counts)])]
            crc = [zlib.crc32(tokens[a:z]) for a, z in zip(cuts.tolist(), cuts[1:].tolist())]
            out.append(pa.table({"doc_id": common.unpack_table(p.column("ids")[0].as_py()).column("doc_id"), "n_tokens": pa.array(np.diff(cuts)), "ids_crc32": pa.array(crc, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(tokens))}))
            del numbers, tokens, ids_word
        common.release()
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "ids_crc32": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(gather, "doc_id long, n_tokens long, ids_crc32 long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with text in place of ids: the pieces of ids, bytes joined to characters, marks shown as spaces, the one in front taken off. Null ids give null."""
    pieces = Pieces(model)
    data = {i: p.replace(SPACE, " ").encode() for p, i, _ in pieces.rows} | {i: bytes([b]) for b, i in pieces.bytes_.items()}
    table = [data.get(i, b"") for i in range(pieces.size)]
    rest = [c for c in encoded.columns if c != "ids"]

    def join(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [None if x.values is None else b"".join([table[i] for i in x.values.to_numpy().tolist()]).removeprefix(b" ").decode("utf-8", "replace") for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, "text"])

    schema = encoded.select(*rest, F.lit("").alias("text")).schema
    return encoded.select(*rest, "ids").mapInArrow(join, schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes the ids again: doc_id, n_tokens, ids_crc32, decoded_sha256; null texts count as empty."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = encode(common.table(spark, sf_dir, "documents"), model)
    return decode(ids, model).select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))
