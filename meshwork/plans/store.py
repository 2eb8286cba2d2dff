"""Cutting the lineage of iterations: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset on a single machine (as in tests) a new local folder. On a cluster, whose
    executors would not see that, an error says so."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.meshwork.shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-meshwork-", dir="/tmp")
        spark.conf.set("spark.meshwork.shared", found)
    return found.rstrip("/")


#: Bytes of a table that a solver's join may broadcast.
MOST_BROADCAST = 1 << 18


@contextmanager
def small_broadcasts(spark: SparkSession):
    """Joins planned inside broadcast tables of at most MOST_BROADCAST bytes: a solver's vectors, which thousands of joins read, stay
    off the driver unless they are short."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) if not before.startswith("-") else -1
    spark.conf.set(name, str(min(int(size), MOST_BROADCAST)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def swept(spark: SparkSession):
    """The shuffle files of what is executed inside go when it ends, not when the driver collects garbage: an iteration's shuffles
    would else stay on disk until the query ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, sort: list[str]) -> DataFrame:
    """As written(), a table of the warehouse bucketed by keys and sorted within buckets: joins and groupings that include
    the keys read it where it is."""
    full = f"{name}_{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*sort).saveAsTable(full)
    found = df.sparkSession.table(full)
    NAMES[id(found)] = full
    return found


#: Tables that bucketed() made, by the DataFrame that reads them.
NAMES: dict[int, str] = {}


def dropped(*tables: DataFrame) -> None:
    """Drops tables that bucketed() or written() made; others, and what was selected from one, are left alone."""
    for t in tables:
        if path := getattr(t, "written_to", None) if isinstance(t, DataFrame) else None:
            t.written_to, session = None, t.sparkSession
            at = session._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session._jsc.hadoopConfiguration()).delete(at, True)
        if name := NAMES.pop(id(t), None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
