"""LM scoring by online logistic context mixing.

A text is its lower-cased tokens, a space after each, and an end. Its bytes are predicted bit by bit from hashed contexts
that run on across words: the last 2 to 5 bytes, and the word so far. Each has a table that counts the zeros and ones of
all training text; their stretched probabilities are summed with weights that a gate selects and online gradient steps
have learned, and a last table refines the result from what came true at like predictions. Along a text the weights go on
learning: what has been read of it moves them for what comes.

A prediction depends on the context and the byte, so the tables are filled, and the weights learned, from the different
(context, byte) keys of the corpus with how often each occurs; a text's own steps are taken over all its bytes."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of context before the predicted byte (0 stands for the word so far), and cells of each context's hashed table (8 bytes each).
ORDERS, CELLS = (2, 3, 4, 5, 0), 1 << 21
SLICES = 64
#: What is added to a cell's zeros and ones.
PRIOR = np.float32(0.05)
#: Gates: the bit's place, by how often the word so far and the last five bytes have been seen, by how many bytes of the last five are the word's.
SEEN = np.array([1, 2, 4, 16, 128])
GATES = 8 * 6 * (len(SEEN) + 1) ** 2
RATE, BATCH, BUCKETS = 0.1, 1024, 33
#: Along a text: the rate, and the bytes of the first stretch after which its weights move (later ones grow with what has been read).
OWN_RATE, STRETCH = 0.1, 32
END = b"\n"
#: Bytes of text whose keys are made at once (some 80 bytes each are held meanwhile), and keys that are held before they are merged.
CHUNK_BYTES, MOST_KEYS = 1 << 20, 1 << 20
_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def _spelling(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A key for each byte of each text (tokens with one space between), the space after its last token and the end: from
    the top 16 bits of a hash of the word so far, five bytes of context, and the byte itself; and how many keys each text has."""
    texts = [t + b" \n" if t else END for t in texts]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"".join([b"\0\0\0\0 " + t for t in texts]), dtype=np.uint8)
    wide, n = data.astype(np.uint64), len(data)
    with np.errstate(over="ignore"):
        powers = np.full(n, _ODD, dtype=np.uint64)
        powers[:1] = 1
        np.cumprod(powers, out=powers)
        powers *= wide + np.uint64(1)
        before = np.cumsum(powers)
        before -= powers
        first = np.zeros(n, dtype=np.int64)  # where the word starts that a byte belongs to
        first[1:] = np.where(data[:-1] == 32, np.arange(1, n), 0)
        np.maximum.accumulate(first, out=first)
        powers[:] = pow(_ODD, -1, 1 << 64)
        powers[:1] = 1
        word = before - before[first]
        word *= np.cumprod(powers, out=powers)[first]
        del powers, before, first
        word = ((word ^ (word >> np.uint64(29))) * _GOLD) >> np.uint64(48)
    keys = wide | (word << np.uint64(48))
    for k in range(1, 6):
        keys[k:] |= wide[:-k] << np.uint64(8 * k)
    kept = np.ones(n, dtype=bool)
    starts = np.cumsum(lengths + 5) - lengths
    kept[(starts[:, None] - np.arange(1, 6)).ravel()] = False
    return keys[kept], lengths


def _inside(keys: np.ndarray) -> np.ndarray:
    """How many of each key's five bytes of context belong to the word."""
    inside, going = np.zeros(len(keys), dtype=np.uint64), np.ones(len(keys), dtype=bool)
    for i in range(1, 6):
        going &= (keys >> np.uint64(8 * i)) & np.uint64(255) != 32
        inside += going
    return inside


def _contexts(keys: np.ndarray) -> list[np.ndarray]:
    """A hash of each order's context of each key."""
    before, out = keys >> np.uint64(8), []
    for k in ORDERS:
        if k:
            c = before & np.uint64((1 << (8 * k)) - 1)
        else:
            inside = _inside(keys)
            c = before & ~(((np.uint64(1) << (np.uint64(8) * (np.uint64(5) - inside))) - np.uint64(1)) << (np.uint64(8) * inside))
        out.append((c * np.uint64(256) + np.uint64(k)) * _GOLD)
    return out


def _cells(keys: np.ndarray, bit: int, contexts: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The cell in each order's table for a bit of each key's last byte, and the bit."""
    byte = (keys & np.uint64(255)).astype(np.int64)
    node = (((1 << bit) | (byte >> (8 - bit))) << 3).astype(np.uint64) * _GOLD
    return [((h + node) >> np.uint64(43)).astype(np.int64) for h in contexts or _contexts(keys)], (byte >> (7 - bit)) & 1


def _chunks(texts: list[bytes], most: int | None = None):
    """Runs of the texts' places with about CHUNK_BYTES each."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= (most or CHUNK_BYTES):
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _merged(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and their summed times."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every, n = every[order], np.concatenate(times)[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
    return every[first], np.add.reduceat(n, first) if len(first) else n


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and the number of each key."""
    import pyarrow as pa

    enc = pa.array(keys).dictionary_encode()
    return enc.dictionary.to_numpy(zero_copy_only=False), enc.indices.to_numpy(zero_copy_only=False)


KEYS = "range long, keys binary, times binary"


def _keys_of(ranges: int):
    """The different keys of each block's training texts and how often they occur, dealt to ranges."""

    def read(batches):
        import pyarrow as pa
        import zstandard

        for b in batches:
            for payload in b.column("payload").to_pylist():
                t = common.unpack_table(payload)
                texts = [b" ".join(_tokens(x.as_py())) for i, x in zip(t.column("doc_id").to_pylist(), t.column("text")) if not is_held_out(i)]
                del t
                found = []
                for a, z in _chunks(texts):
                    keys, at = _counted(_spelling(texts[a:z])[0])
                    found.append((keys, np.bincount(at, minlength=len(keys))))
                    if sum(len(k) for k, _ in found[1:]) > MOST_KEYS:
                        found = [_merged(*zip(*found))]
                del texts
                keys, times = _merged([k for k, _ in found], [n for _, n in found])
                del found
                of = (((keys * _GOLD) >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(ranges + 1))
                pack = zstandard.ZstdCompressor(level=1).compress
                rows = [(r, common.pack_sorted(keys[order[x:y]]), pack(times[order[x:y]].astype("<u4").tobytes())) for r, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if y > x]
                del keys, times, order
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["range", "keys", "times"])
                common.release()

    return read


def _merge(t):
    """One row of keys and summed times of a range."""
    import pyarrow as pa
    import zstandard

    keys, times = _merged(*zip(*_unpacked(t)))
    return pa.table({"range": t.column("range")[:1], "keys": pa.array([common.pack_sorted(keys)], pa.binary()), "times": pa.array([zstandard.ZstdCompressor(level=1).compress(times.astype("<i8").tobytes())], pa.binary())})


def _unpacked(t, kind: str = "<u4"):
    import zstandard

    for k, n in zip(t.column("keys").to_pylist(), t.column("times").to_pylist()):
        yield common.unpack_sorted(k), np.frombuffer(zstandard.ZstdDecompressor().decompress(n), dtype=kind).astype(np.int64)


def _count(batches):
    """Counts of each table in this task, in slices."""
    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    n = np.zeros((len(ORDERS), 2, CELLS), dtype=np.int32)
    for b in batches:
        for keys, times in _unpacked(b, "<i8"):
            _add_keys(n, keys, times)
    task = TaskContext.get().partitionId() % 64
    pack = zstandard.ZstdCompressor(level=1).compress
    kind = pa.schema([("slice", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())])
    for i, part in enumerate(n.reshape(SLICES * len(ORDERS), -1)):
        if part.any():
            yield pa.RecordBatch.from_pydict({"slice": [i], "task": [task], "counts": [pack(part.tobytes())]}, schema=kind)


def _add_keys(n: np.ndarray, keys: np.ndarray, times: np.ndarray) -> None:
    contexts = _contexts(keys)
    for bit in range(8):
        cells, ones = _cells(keys, bit, contexts)
        for k, c in enumerate(cells):
            np.add.at(n[k].reshape(-1), ones * CELLS + c, times.astype(np.int32))


def _add(t):
    import pyarrow as pa
    import zstandard

    total = 0
    for x in t.column("counts"):
        total = total + np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), dtype=np.int32)
    return pa.table({"slice": t.column("slice")[:1], "task": t.column("task")[:1], "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(total.astype(np.int32).tobytes())], pa.binary())})


class Mixer:
    """Tables, gated weights and the refining table. Its size is fixed: 8 bytes for each cell of each order."""

    def __init__(self, counts: np.ndarray):
        self.counts: np.ndarray | None = counts.astype(np.int32, copy=False)
        self.stretched: np.ndarray | None = None
        self.often: np.ndarray | None = None
        self.weights = np.full((GATES, len(ORDERS)), 0.3)
        self.steps = np.full((GATES, len(ORDERS)), 1e-3)
        self.refined = np.zeros((8, BUCKETS, 2))

    def fitted(self) -> Mixer:
        """What scoring takes: each cell's stretched prediction in place of its counts."""
        out = Mixer(np.empty(0))
        out.counts, out.weights, out.refined = None, self.weights, self.refined
        out.stretched = np.empty((len(ORDERS), CELLS), dtype=np.float32)
        for k, (n0, n1) in enumerate(self.counts):
            out.stretched[k] = np.log((n1 + PRIOR) / (n0 + PRIOR))
        out.often = np.stack([np.searchsorted(SEEN, n.sum(axis=0), "right").astype(np.uint8) for n in self.counts[-2:]])
        return out

    def inputs(self, keys: np.ndarray, bit: int, own: int, contexts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretched predictions, gates and bits; own: how often the byte itself is in the counts."""
        cells, ones = _cells(keys, bit, contexts)
        x, often = np.empty((len(keys), len(ORDERS)), dtype=np.float32), []
        for k, c in enumerate(cells):
            last = k - len(ORDERS) + 2  # 0 and 1: the orders that the gates look at
            if self.stretched is not None and not own:
                x[:, k] = self.stretched[k][c]
                if last >= 0:
                    often.append(self.often[last][c])
            else:
                n0, n1 = np.maximum(self.counts[k, 0][c] - own * (1 - ones), 0), np.maximum(self.counts[k, 1][c] - own * ones, 0)
                x[:, k] = np.log((n1 + PRIOR) / (n0 + PRIOR))
                if last >= 0:
                    often.append(np.searchsorted(SEEN, n0 + n1, "right"))
        side = len(SEEN) + 1
        return x, ((bit * 6 + _inside(keys).astype(np.int64)) * side + often[1]) * side + often[0], ones

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -12, 12)

    @staticmethod
    def bucket(s: np.ndarray) -> np.ndarray:
        return np.rint((s + 12) * ((BUCKETS - 1) / 24)).astype(np.int64)

    def learn(self, keys: np.ndarray, times: np.ndarray) -> None:
        """One online step for each bit of a batch, its bytes left out of the counts."""
        contexts = _contexts(keys)
        for bit in range(8):
            x, gate, ones = self.inputs(keys, bit, 1, contexts)
            s = self.mixed(x, gate)
            error = (ones - 1 / (1 + np.exp(-s))) * times
            total = np.bincount(gate, times, GATES) + 1e-9
            step = np.stack([np.bincount(gate, error * x[:, k], GATES) for k in range(len(ORDERS))], axis=1) / total[:, None]
            self.steps += step**2
            self.weights += RATE * step / np.sqrt(self.steps)
            np.add.at(self.refined, (bit, self.bucket(s), ones), times)

    def log10_of(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text (tokens with one space between). Its own weights (of the gates' sum and of the
        two longest contexts, added to it) take a gradient step after each stretch of the text, so that only bytes already read
        move them."""
        keys, lengths = _spelling(texts)
        keys, at = _counted(keys)
        contexts, byte = _contexts(keys), (keys & np.uint64(255)).astype(np.uint8)
        moved = np.empty((3, len(keys), 8), dtype=np.float32)
        for bit in range(8):
            x, gate, _ = self.inputs(keys, bit, 0, contexts)
            moved[0, :, bit] = np.einsum("ij,ij->i", x, self.weights[gate])
            moved[1, :, bit], moved[2, :, bit] = x[:, -2], x[:, -1]
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)
        n, place = self.refined.sum(axis=2) + 20, BUCKETS * np.arange(8)
        told, rest = (self.refined[:, :, 1] / n).ravel().astype(np.float32), (20 / n).ravel().astype(np.float32)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
        own, total = np.zeros((len(texts), len(moved)), dtype=np.float32), np.zeros(len(texts))
        a = 0
        while (live := int(np.searchsorted(-lengths, -a))) > 0:  # texts longer than a
            z = a + max(STRETCH, a // 8)
            each = np.minimum(lengths[:live], z) - a
            first = np.cumsum(each) - each
            of = np.repeat(np.arange(live), each)
            here = at[np.arange(int(each.sum())) + (starts[:live] + a - first)[of]]
            inputs, ones = [y[here] for y in moved], bits[byte[here]]
            t = inputs[0] + sum(y * own[of, k][:, None] for k, y in enumerate(inputs))
            p = 1 / (1 + np.exp(-np.clip(t, -12, 12, out=t)))
            b = self.bucket(t) + place
            q = 0.5 * (p + told[b] + rest[b] * p)
            total[:live] += np.add.reduceat(np.log10(np.prod(1 - ones + (2 * ones - 1) * q, axis=1, dtype=np.float64)), first)
            error = ones - p
            step = np.stack([np.einsum("ij,ij->i", error, y) for y in inputs], axis=1)
            own[:live] += OWN_RATE * np.add.reduceat(step, first, axis=0) / each[:, None].astype(np.float32)
            a = z
        out = np.empty(len(texts))
        out[order] = total
        return out


def fit_mixer(blocks: DataFrame) -> Mixer:
    """Counts, weights and refining table from all bytes of the blocks' training texts. Sums of fixed size reach the driver."""
    import zstandard

    ranges = max(1, blocks.count())
    every = common.written(blocks.mapInArrow(_keys_of(ranges), KEYS).groupBy("range").applyInArrow(_merge, KEYS), "keys")
    schema = "slice int, task int, counts binary"
    rows = every.mapInArrow(_count, schema).groupBy("slice", "task").applyInArrow(_add, schema).groupBy("slice").applyInArrow(_add, schema)
    counts = np.zeros((SLICES * len(ORDERS), 2 * CELLS // SLICES), dtype=np.int32)
    for r in rows.toLocalIterator():
        counts[r["slice"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"])), dtype=np.int32)
    mixer = Mixer(counts.reshape(len(ORDERS), 2, CELLS))
    shared = blocks.sparkSession.sparkContext.broadcast(mixer)

    def learn(batches):
        import pyarrow as pa

        own, n = Mixer(shared.value.counts), 0
        for b in batches:
            for keys, times in _unpacked(b, "<i8"):
                order = np.random.default_rng(len(keys)).permutation(len(keys))
                for at in range(0, len(keys), BATCH):
                    own.learn(keys[order[at : at + BATCH]], times[order[at : at + BATCH]])
                n += int(times.sum())
        place = list(range(own.weights.size + own.refined.size))
        yield pa.RecordBatch.from_pydict({"place": place, "n": [float(n)] * len(place), "v": np.concatenate([own.weights.ravel() * n, own.refined.ravel()])})

    sums = every.mapInArrow(learn, "place long, n double, v double").groupBy("place").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    shared.unpersist()
    for r in sums:
        if r.place < mixer.weights.size:
            mixer.weights.ravel()[r.place] = r.v / r.n if r.n else mixer.weights.ravel()[r.place]
        else:
            mixer.refined.ravel()[r.place - mixer.weights.size] = r.v
    return mixer.fitted()


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _vocabulary(batches):
    """The different words of each block, and how often its training documents have them."""
    import pyarrow as pa

    for b in batches:
        for block, payload in zip(b.column("block").to_pylist(), b.column("payload").to_pylist()):
            t = common.unpack_table(payload)
            n: Counter = Counter()
            words: dict[bytes, None] = {END: None}
            for doc_id, text in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()):
                tokens = _tokens(text)
                if is_held_out(doc_id):
                    words.update(dict.fromkeys(tokens))
                else:
                    n.update(tokens)
                    n[END] += 1
            words.update(dict.fromkeys(n))
            every = list(words)
            for at in range(0, len(every), 50_000):
                part = every[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([block] * len(part), pa.int64()), pa.array([n[w] for w in part], pa.int64())], names=["word", "block", "c"])


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of each row.

    Trains on the documents that are not held out, all of them; a null doc_id is not held out. Null texts count as
    empty: one end token. score is the mixer's log10 probability of the text's bytes (n_bytes: its tokens, a space after
    each, and the end), so all texts' probabilities sum to at most one; bits_per_byte spreads it over them. Repeated rows
    get a row each and count each. Only doc_id and text are read. A text must fit into a task. An empty table gives no rows."""
    own = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = common.text_blocks(own, "lm_blocks")
    found = common.written(blocks.mapInArrow(_vocabulary, "word binary, block long, c long"), "vocabulary")
    words = common.written(found.groupBy("word").agg(F.sum("c").alias("c")), "words")
    total = words.agg(F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = total["n"], total["v"]
    shared = docs.sparkSession.sparkContext.broadcast(fit_mixer(blocks))
    told = found.select("word", "block").join(words, "word").select("block", "word", "c")

    def gather(t, w):
        import pyarrow as pa

        place = {x: i for i, x in enumerate(w.column("word").to_pylist())}
        c = w.column("c").to_numpy()
        base = np.log10((c + 1) / (n + v + 1))
        rows = []
        for payload in t.column("payload").to_pylist():
            docs_ = common.unpack_table(payload)
            ids, texts = docs_.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, docs_.column("text").to_pylist()):
                tokens = _tokens(text)
                at = np.fromiter(map(place.__getitem__, (*tokens, END)), dtype=np.int64, count=len(tokens) + 1)
                texts.append(b" ".join(tokens))
                rows.append((doc_id, is_held_out(doc_id), len(tokens) + 1, int((c[at] > 0).sum()), n, float(base[at].sum())))
            del docs_
            scores = np.concatenate([np.empty(0), *(shared.value.log10_of(texts[a:z]) for a, z in _chunks(texts))])
            for i, (text, score) in enumerate(zip(texts, scores.tolist()), len(rows) - len(texts)):
                size = len(text) + 2 if text else 1
                rows[i] += (score, size, -score / np.log10(2) / size)
        common.release()
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(gather, out)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(common.table(spark, sf_dir, "documents"))
