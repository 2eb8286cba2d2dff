"""Connected components by smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """idx, label (the smallest idx reachable) for nodes (idx) and edges (src, dst), taken both ways.

    Each round takes the smallest label of the neighbours and then the label's own label, so that long paths shorten by
    more than one step; rounds are written to the shared folder. The joins are merges, so that no round's labels go through the
    driver as a broadcast."""
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "edges")
    labels = written(nodes.select("idx", F.col("idx").alias("label")), "labels")
    while True:
        of = labels.select(F.col("idx").alias("dst"), "label")
        near = both.join(of.hint("merge"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        low = labels.join(near.hint("merge"), labels.idx == near.src, "left").select("idx", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = low.select(F.col("idx").alias("low"), F.col("low").alias("lower"))
        new = written(low.join(jump.hint("merge"), "low").select("idx", F.col("lower").alias("new"), "label"), "labels")
        if new.filter("new <> label").isEmpty():
            return labels
        labels = new.select("idx", F.col("new").alias("label"))
