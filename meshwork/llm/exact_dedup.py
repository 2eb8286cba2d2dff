"""Exact dedup: a persistent digest index, bucketed and sorted by hash; new data meets it in a sort-merge anti-join."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 text, each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), common.BLANK, " "), 256)


#: Digests of a bucket of a new index, on average: some 200 MB.
BUCKET_ROWS = 2 << 20


class DigestIndex:
    """Digests of all texts kept so far, as a table of the session's catalog.

    The table holds (digest, keep_id, group_size, batch), bucketed and sorted by digest, so that neither the anti-join nor
    the append shuffles what is there already. group_size counts the batch that brought the digest. A new index has a
    bucket for every BUCKET_ROWS rows of its first batch; compact() gives it as many as it needs later, and one sorted file
    in each of them again."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets

    def _write(self, rows: DataFrame, mode: str, name: str, buckets: int) -> None:
        rows.repartition(buckets, "digest").write.mode(mode).format("parquet").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def _open(self, rows: int) -> int:
        """The number of buckets; makes the table if it is not there."""
        if not self.spark.catalog.tableExists(self.name):
            buckets = self.buckets or max(8, -(-rows // BUCKET_ROWS))
            self._write(self.spark.createDataFrame([], "digest string, keep_id long, group_size long, batch string"), "errorifexists", self.name, buckets)
        about = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Num Buckets'").first()
        return int(about.data_type)

    def compact(self, name: str) -> DigestIndex:
        """The same index under another name, its buckets as the rows ask for and one file for each."""
        new = DigestIndex(self.spark, name)
        self._write(self.entries(), "errorifexists", name, max(8, -(-self.entries().count() // BUCKET_ROWS)))
        return new

    def dedup(self, docs: DataFrame, text: str = "text", key: str = "doc_id", batch: str | None = None) -> DataFrame:
        """Judges a batch and appends its new digests. One row for each row of docs:
        key, keep_id, group_size, kept, text_sha256.

        Of equal texts the smallest key stays, unless another batch brought the text before: then none stays and keep_id and
        group_size are that batch's. A batch that is given again under its name gets the same answer and appends nothing.
        Null texts equal empty ones. A null key loses to any other. Of rows with the same key and text one stays. Only key
        and text are read, so other columns may have any name. An empty batch appends nothing."""
        batch = batch or uuid.uuid4().hex
        rows = docs.select(F.col(f"`{key}`").alias("doc_id"), text_digest(F.col(f"`{text}`")).alias("digest"))
        digests = common.written(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
        buckets = self._open(digests.count())
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
        local = digests.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
        local = common.written(local.select("digest", F.col("first.doc_id").alias("keep_id"), "group_size", F.col("first.row").alias("keep_row")), "digest_groups")
        fresh = local.drop("keep_row").join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        self._write(fresh.withColumn("batch", F.lit(batch)), "append", self.name, buckets)
        # One row for each digest, and written: the last join reads two plain tables, so that a digest with very many rows is
        # split like any skewed key.
        answers = common.written(local.select("digest", "keep_row").join(self.entries().hint("merge"), "digest"), "digest_answers")
        return digests.join(answers, "digest").select(
            F.col("doc_id").alias(key),
            "keep_id",
            "group_size",
            ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", index: str | None = None, buckets: int | None = None) -> DataFrame:
    """DigestIndex.dedup against the named index, or against a new one."""
    return DigestIndex(docs.sparkSession, index or f"digest_index_{uuid.uuid4().hex}", buckets).dedup(docs, text, key)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row for each text, that of the smallest doc_id; all columns stay and may have any name. Ids may be
    repeated or null: a row without one stays only if no row with one has its text, and of rows with the same id and text
    one stays."""
    row = lambda digest: F.concat(digest, F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")))
    rows = common.boxed(docs)
    kept = exact_dedup(rows).filter("kept").select(row(F.col("text_sha256")).alias("mark"))
    turn = F.row_number().over(Window.partitionBy("mark").orderBy(F.lit(1)))
    return common.unboxed(rows.withColumn("mark", row(text_digest(F.col("text")))).join(kept, "mark", "left_semi").withColumn("turn", turn).filter("turn = 1"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the first batch of a new index; nulls, ties, repeated rows and empty tables as in DigestIndex.dedup."""
    return exact_dedup(common.table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), g AS (
  SELECT h, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY h
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""
