"""Scans along an order in which no task sees all rows.

Rows are dealt to ranges of the order and written once, with their place in the range; what a range needs of those before
it (a count, a sum, the last value) is one row for each range, and joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import written

MASK = (1 << 33) - 1


def ranges(rows: DataFrame, order: list[Column | str], name: str = "ranges") -> DataFrame:
    """rows with _range and _at: sorted by order, first by range and then by place within it; a table in the shared folder."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return written(sorted_, name).withColumn("_range", F.shiftright("_at", 33))


def _across() -> Window:
    """Over one row for each range, all of those before."""
    return Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def _inside(last: int) -> Window:
    return Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, last)


def placed(rows: DataFrame, *order: Column | str, weight: str | None = None, name: str = "place") -> DataFrame:
    """rows with the number (or the sum of the weights) of the rows before each in the order, which should tell all apart."""
    at = ranges(rows, list(order), name)
    if weight is None:
        own, size = F.col("_at").bitwiseAND(F.lit(MASK)), F.count(F.lit(1))
    else:
        own, size = F.coalesce(F.sum(weight).over(_inside(-1)), F.lit(0)), F.sum(weight)
    before = at.groupBy("_range").agg(size.alias("_size")).select("_range", F.coalesce(F.sum("_size").over(_across()), F.lit(0)).alias("_before"))
    return at.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_at", "_own", "_before")


def last_known(rows: DataFrame, value: str, *order: Column | str) -> DataFrame:
    """rows with value replaced by the last one that is not null at or before each row: an as-of join as a scan."""
    at = ranges(rows, list(order), "asof")
    ends = at.groupBy("_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_end"))
    carried = ends.select("_range", F.last("_end", ignorenulls=True).over(_across()).alias("_carried"))
    filled = F.coalesce(F.last(value, ignorenulls=True).over(_inside(0)), "_carried")
    return at.join(F.broadcast(carried), "_range").withColumn(value, filled).drop("_range", "_at", "_carried")


def previous(rows: DataFrame, value: Column, name: str, *order: Column | str) -> DataFrame:
    """rows with the value of the row before each (null for the first)."""
    at = ranges(rows.withColumn("_value", value), list(order), "previous")
    ends = at.groupBy("_range").agg(F.max_by("_value", "_at").alias("_end"))
    carried = ends.select("_range", F.lag("_end").over(Window.orderBy("_range")).alias("_carried"))
    own = Window.partitionBy("_range").orderBy("_at")
    before = F.when(F.row_number().over(own) == 1, F.col("_carried")).otherwise(F.lag("_value").over(own))
    return at.join(F.broadcast(carried), "_range").withColumn(name, before).drop("_range", "_at", "_value", "_carried")
