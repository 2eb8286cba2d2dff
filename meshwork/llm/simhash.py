"""SimHash near-dedup by pivot distance tables.

Every different fingerprint gets its Hamming distances to the reference fingerprints, for each quarter of its bits. Of
two fingerprints that differ in two bits or fewer, at least two quarters are equal, and so are those quarters' distance
tables: they are the keys of an equi-join. A pair found there is discarded if a coordinate of the whole distance
vectors differs by more than two (triangle inequality), and survivors are verified bit by bit."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SEED = 42
RADIUS = 2
#: Reference fingerprints: XXH64 of their numbers.
PIVOTS = [xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(8)]
#: Fingerprints under one key whose pairs are joined; a key with more goes the way of dense_links, without pairs.
MOST_PAIRED = 64


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of size words, joined by a space; of all words if there are fewer."""
    runs = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words] if words else []
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)], dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> bytes:
    """Eight bytes, the highest first: a bit is 1 if it is in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.add.reduce(np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of each row; zero for null and empty texts."""

    def make(batches):
        import pyarrow as pa

        for b in batches:
            fp = b"".join(majority_bits(shingle_hashes((t or "").encode("utf-8", "surrogatepass").lower().split(), size)) for t in b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.frombuffer(fp, dtype=">i8").astype(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _packed_distances(column: Column, mask: int) -> Column:
    """The distances of the masked bits to all references in one long, eight bits each."""
    out = F.lit(0).cast("long")
    for i, p in enumerate(PIVOTS):
        d = F.bit_count(column.bitwiseXOR(F.lit(_signed(p & mask)))).cast("long")
        out = out.bitwiseOR(F.shiftleft(d, 8 * i))
    return out


def distance_tables(prints: DataFrame) -> DataFrame:
    """fp, whole (distances of all bits), keys (one for each two of the four quarters)."""
    quarter = [0xFFFF << (16 * q) for q in range(4)]
    own = prints.select("fp", _packed_distances(F.col("fp"), (1 << 64) - 1).alias("whole"), *(_packed_distances(F.col("fp").bitwiseAND(F.lit(_signed(m))), m).alias(f"q{i}") for i, m in enumerate(quarter)))
    keys = [F.xxhash64(F.lit(4 * i + k), f"q{i}", f"q{k}") for i in range(4) for k in range(i + 1, 4)]
    return own.select("fp", "whole", F.array(*keys).alias("keys"))


def _apart(a: str, b: str) -> Column:
    """The largest difference of two packed distance vectors' coordinates."""
    at = lambda c, i: F.shiftright(F.col(c), 8 * i).bitwiseAND(F.lit(255))
    return F.greatest(*(F.abs(at(a, i) - at(b, i)) for i in range(len(PIVOTS))))


def dense_links(prints: DataFrame) -> DataFrame:
    """a, b: links that connect the same fingerprints as all pairs within two bits would, in 65 rows for each.

    Two fingerprints differ in at most two bits just if some value is within one bit of both; each is linked to the
    smallest around every such value."""
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    around = prints.select("fp", F.explode(near).alias("value"))
    low = around.groupBy("value").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("value", "low")
    return around.join(low, "value").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def links(prints: DataFrame, most_paired: int = MOST_PAIRED) -> DataFrame:
    """a, b: links between different fingerprints (fp) within two bits, enough to connect all that are linked."""
    keyed = distance_tables(prints).select("fp", "whole", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = common.written(keyed.join(shared, "key"), "members")
    few = members.filter(F.col("n") <= most_paired)
    other = few.select("key", F.col("fp").alias("b"), F.col("whole").alias("whole_b"))
    pairs = few.select("key", F.col("fp").alias("a"), "whole").join(other, "key").filter("a < b").filter(_apart("whole", "whole_b") <= RADIUS)
    sure = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    return sure.union(dense_links(members.filter(F.col("n") > most_paired).select("fp").distinct())).distinct()


def near_groups(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links) of each row.

    Equal fingerprints are linked, and so are those that differ in one or two bits. Null and empty texts have the
    fingerprint zero and are linked like others. Repeated rows get a row each. Null doc_ids never become a
    component_id unless all of a component's are null. An empty table gives no rows."""
    prints = common.written(fingerprints(docs, size), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    reached = components(links(first.select("fp"))).withColumnRenamed("node", "fp")
    named = first.join(reached, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = named.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; nulls, ties, repeated rows and empty tables as in near_groups."""
    return near_groups(common.table(spark, sf_dir, "documents"))
