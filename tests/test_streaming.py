import tempfile

from pyspark.sql import functions as F

from meshwork.operators.graph import components
from meshwork.plans import report_queries
from meshwork.streaming import log_stream

SF = "/root/testdata/sf0.001"


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_policy_as_state_agrees_with_windows(spark, tmp_path):
    """Files of consecutive events give the same as one query over all of them."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(3):
        e.filter(F.floor(F.col("event_id") * 3 / 1000) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    run(log_stream.policy_state(log_stream.events(spark, str(tmp_path / "events"), 3)), "judged", "append")
    found = spark.table("judged").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("wasted"), 3).alias("w"), F.sum("age").alias("a"))
    want = report_queries.Q["w06_wasted_time"](spark, SF).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("wasted"), 3).alias("w"), F.sum("age").alias("a"))
    assert {r.run: (r.n, r.a) for r in found.collect()} == {r.run: (r.n, r.a) for r in want.collect()}
    gaps = found.join(want.withColumnRenamed("w", "v"), "run").filter("abs(w - v) > 0.01")
    assert gaps.count() == 0


def test_windowed_counts(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "events"))
    run(log_stream.level_counts(log_stream.events(spark, str(tmp_path / "events"))), "counts", "complete")
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_components(spark):
    nodes = spark.range(60).withColumnRenamed("id", "idx")
    edges = spark.range(29).selectExpr("id src", "id + 1 dst").union(spark.range(1).selectExpr("40 src", "50 dst"))
    label = {r.idx: r.label for r in components(nodes, edges).collect()}
    assert [label[i] for i in (0, 29, 30, 40, 50, 59)] == [0, 0, 30, 40, 40, 59]
