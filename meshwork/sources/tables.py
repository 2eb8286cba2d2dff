"""Matrices, vectors and solve logs derived from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import algebra, scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders x parts, the quantities: duplicate lines are summed."""
    lines = table(spark, sf_dir, "lineitem")
    return algebra.from_coo(lines.select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val")))


#: Lines of orders whose pairs of parts one task counts.
LINES_A_TASK = 250_000


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D - W + I of the parts: W counts the orders that two parts share, D has its row sums. Work follows the square of an order's lines, which are few.

    A pair is counted once and mirrored; the diagonal comes from the orders' sizes. There are as many tasks as the lines need,
    so that a task's memory does not grow with the table."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").filter("l_orderkey IS NOT NULL")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // LINES_A_TASK)
    orders = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts")).filter(F.size("parts") > 1)
    pairs = orders.select("parts", F.posexplode("parts").alias("at", "i")).select("i", F.explode(F.slice("parts", F.col("at") + 2, F.size("parts"))).alias("j"))
    counts = pairs.repartition(tasks, "i", "j").groupBy("i", "j").agg((-F.count(F.lit(1))).cast("double").alias("val"))
    entry = lambda r, c: F.struct(F.col(r).alias("row"), F.col(c).alias("col"))
    off = counts.select(F.explode(F.array(entry("i", "j"), entry("j", "i"))).alias("e"), "val").select("e.row", "e.col", "val")
    degrees = orders.select(F.explode("parts").alias("row"), (F.size("parts") - 1).cast("double").alias("val"))
    ones = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.lit(1.0).alias("val"))
    diagonal = degrees.unionByName(ones).groupBy("row").agg(F.sum("val").alias("val"))
    return off.unionByName(diagonal.select("row", F.col("row").alias("col"), "val"))


def order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Laplacian plus one of the orders as a graph with locality: each order is linked to its customer's next one, and
    each customer's first order to that of the nation's next customer who has any."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    chain = orders.select(F.col("o_orderkey").alias("row"), F.lag("o_orderkey").over(own).alias("col"))
    first = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("row")).join(customers.select("c_custkey", "c_nationkey"), "c_custkey")
    spine = scan.previous(first, F.struct("c_nationkey", F.col("row").alias("col")), "before", "c_nationkey", "c_custkey")
    spine = spine.filter(F.col("before.c_nationkey") == F.col("c_nationkey")).select("row", "before.col")
    links = chain.filter("col IS NOT NULL").unionByName(spine)
    entry = lambda r, c, v: F.struct(F.col(r).alias("row"), F.col(c).alias("col"), F.lit(v).alias("val"))
    entries = links.select(F.explode(F.array(entry("row", "col", -1.0), entry("col", "row", -1.0), entry("row", "row", 1.0), entry("col", "col", 1.0))).alias("e")).select("e.*")
    return algebra.from_coo(entries.unionByName(orders.select(F.col("o_orderkey").alias("row"), F.col("o_orderkey").alias("col"), F.lit(1.0).alias("val"))))


def chain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx and the keys along which order_chain runs: what a partition that knows the geometry would follow."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), "o_custkey").join(customers, "o_custkey", "left").select("idx", F.col("c_nationkey").alias("nation"), F.col("o_custkey").alias("customer"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D - W + I of the nations: W counts the lines between two nations' suppliers and customers, both ways."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    one = lines.groupBy(F.col("s_nationkey").cast("long").alias("row"), F.col("c_nationkey").cast("long").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("val")).filter("row <> col")
    return laplacian(algebra.from_coo(one.unionByName(algebra.transpose(one))), t("nation").select(F.col("n_nationkey").cast("long").alias("idx")))


def laplacian(w: DataFrame, x: DataFrame) -> DataFrame:
    degree = w.groupBy(F.col("row").alias("idx")).agg(F.sum("val").alias("val"))
    diagonal = degree.unionByName(x.select("idx", F.lit(1.0).alias("val"))).groupBy("idx").agg(F.sum("val").alias("val"))
    return algebra.add_diagonal(w.withColumn("val", -F.col("val")), diagonal)


def known_solution(x: DataFrame) -> DataFrame:
    """1 + idx mod 7."""
    return x.select("idx", (1 + F.col("idx") % 7).cast("double").alias("val"))


def grid_side(spark: SparkSession, sf_dir: str, name: str, share: float = 1.0, dim: int = 2) -> int:
    """The side of a square or cubic grid with at most share times as many cells as a table has rows."""
    return max(2, int((table(spark, sf_dir, name).count() * share + 1e-6) ** (1.0 / dim)))


def solve_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of solves: users are runs, each event a solve in its order, purchases rebuild the setup."""
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    level: Column = F.when(F.col("event_type") == "purchase", "rebuild").when(F.col("event_type").isin("view", "click"), "refactorize").otherwise("reuse")
    return e.select(
        F.floor(F.col("user_id") / 3).alias("grp"),
        F.element_at(F.array(F.lit("off"), F.lit("refactor"), F.lit("auto")), (F.col("user_id") % 3 + 1).cast("int")).alias("mode"),
        F.col("user_id").alias("run"),
        seq.cast("long").alias("seq"),
        F.floor(seq / 3).alias("step"),
        (seq % 3).cast("long").alias("corrector"),
        level.alias("level"),
        (5 + F.col("event_id") % 40).alias("iterations"),
        F.round(F.col("value") / 10, 4).alias("t_update"),
        F.col("value").alias("t_solve"),
        (1 + F.col("event_id") % 8).alias("decades"),
        (F.col("event_type") != "error").alias("converged"),
        (100 + F.col("user_id")).alias("n0"),
        F.element_at(F.array(F.lit(240), F.lit(336), F.lit(432)), (F.floor(F.col("user_id") / 3) % 3 + 1).cast("int")).cast("long").alias("np"),
        (F.col("user_id") % 5).alias("kind"),
    )
