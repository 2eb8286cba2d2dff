"""Solve logs as streams: counts by level in windows of time, and the reuse policy as a keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

JUDGED = "run long, event_id long, level string, wasted double, age int"
STATE = "age int, wasted double, references string"


def events(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """The event files of a folder as a stream, so many new files at once."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def level(event_type: Column) -> Column:
    return F.when(event_type == "purchase", "rebuild").when(event_type.isin("view", "click"), "refactorize").otherwise("reuse")


def level_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, level, n, t_solve for windows of time; rows later than the watermark are left out by Spark."""
    own = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("level", level(F.col("event_type")))
    t = own.groupBy(F.window("ts", width), "level").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("t_solve"))
    return t.select(F.col("window.start").alias("start"), "level", "n", "t_solve")


def _judge(key, frames: Iterator, state) -> Iterator:
    import json

    import pandas as pd

    age, wasted, known = (state.get[0], state.get[1], json.loads(state.get[2])) if state.exists else (0, 0.0, {})
    out = []
    for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
        if r.level == "rebuild":
            age, wasted, known = 0, 0.0, {}
        elif r.level == "refactorize":
            age += 1
        reference = known.setdefault(str(r.kind), r.iterations / r.decades)
        wasted += max(0.0, r.iterations - reference * r.decades) * r.t_solve / r.iterations
        out.append((key[0], r.event_id, r.level, wasted, age))
    state.update((age, wasted, json.dumps(known)))
    yield pd.DataFrame(out, columns=["run", "event_id", "level", "wasted", "age"])


def policy_state(stream: DataFrame) -> DataFrame:
    """run, event_id, level, wasted, age: what each run has wasted since its last rebuild, and its age, after each solve.

    The state of a run is its age, its waste and one reference for each kind of solve; it never times out. Rows of a
    micro-batch are taken in their order; a row of an earlier time in a later batch counts when it comes."""
    own = stream.select(F.col("user_id").alias("run"), "event_id", "ts", level(F.col("event_type")).alias("level"), (5 + F.col("event_id") % 40).alias("iterations"), (1 + F.col("event_id") % 8).alias("decades"), F.col("value").alias("t_solve"), (F.col("user_id") % 5).alias("kind"))
    return own.groupBy("run").applyInPandasWithState(_judge, JUDGED, STATE, "append", GroupStateTimeout.NoTimeout)
