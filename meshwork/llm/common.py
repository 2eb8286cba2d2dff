"""What the operators of this subpackage share: reading tables, the shared folder, packed blocks of documents."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import shared_dir, written  # noqa: F401

#: Words are runs of anything but these: space and \t \n \v \f \r, as in Python's bytes.split().
BLANK = r"[\x20\x09-\x0D]+"
#: Terms are runs of anything but these: ASCII that is no digit or lower-case letter.
NO_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(column, UPPER, LOWER)


def terms(text: Column) -> Column:
    """The terms of a text in order, A-Z in lower case; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_TERM, -1), "")


#: terms() of the column text in DuckDB.
TERMS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def bucketed(df: DataFrame, name: str, key: str, buckets: int, folders: list[str] | None = None, kind: Column | None = None) -> DataFrame:
    """As written(), bucketed by key in the warehouse: later groupings and joins on key read it without a shuffle. With
    kind, a column of that value is added and named by folders, and each of its values gets a folder of its own."""
    full = f"{name}_{uuid.uuid4().hex}"
    out = (df if kind is None else df.withColumn(folders[0], kind)).write.format("parquet").bucketBy(buckets, key)
    (out if kind is None else out.partitionBy(*folders)).saveAsTable(full)
    return df.sparkSession.table(full)


def boxed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs as a struct), doc_id (long), text: what an operator works on where docs' own columns are to
    come back, so that their names can't clash with its own. unboxed() gives them back."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Jobs that are run inside hand Python at most so many rows at once (fewer, if the session says so)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sample_rate(rows: int, most: int) -> float:
    return 1.0 if rows <= most else most / rows


def chosen(key: Column, rate: float) -> Column:
    """A repeatable share of rows: by a hash of the key, not by position."""
    return F.pmod(F.xxhash64(F.lit(0x5EED), key), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))


#: What a Python worker remembers between tasks, by operator.
held: dict[str, object] = {}


def release(keep: str | None = None) -> None:
    """Gives freed memory of a Python worker back, since workers go on to other tasks beside the JVM, and drops what other
    operators (all but keep) remember in it."""
    import ctypes
    import gc

    import pyarrow as pa

    for name in [x for x in held if x != keep]:
        del held[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 values as zstd over the byte planes of their differences; about 6 bytes each where they are dense."""
    import zstandard

    first = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(first.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_table(t) -> bytes:
    """An Arrow table as one zstd-compressed buffer."""
    import pyarrow as pa
    import zstandard

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def unpack_table(data: bytes):
    import pyarrow as pa
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def sized(batches, block_bytes: int):
    """Lists of Arrow batches with about block_bytes of text each, cut between rows."""
    import pyarrow.compute as pc

    held, size = [], 0
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.unique(np.searchsorted(sizes, np.arange(block_bytes, (sizes[-1] if len(sizes) else 0) + 1, block_bytes)) + 1)
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            if z > a:
                held.append(b.slice(a, z - a))
                size += int(sizes[z - 1] - (sizes[a - 1] if a else 0))
            if size >= block_bytes:
                yield held
                held, size = [], 0
    if held:
        yield held


def text_blocks(docs: DataFrame, name: str, block_bytes: int = 16 << 20, buckets: int | None = None) -> DataFrame:
    """docs as packed blocks of about block_bytes of text: block, payload; a table bucketed by block.

    Blocks follow the input's partitions, so packing needs no shuffle, and the payloads are compressed."""

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kind = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
        for at, held in enumerate(sized(batches, block_bytes), TaskContext.get().partitionId() << 24):
            yield pa.RecordBatch.from_pydict({"block": [at], "payload": [pack_table(pa.Table.from_batches(held))]}, schema=kind)

    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(docs.mapInArrow(pack, "block long, payload binary"), name, "block", buckets)
