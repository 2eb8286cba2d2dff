"""Benchmark decontamination: a prefix-filtered join of item windows with the corpus, in DataFrame functions only.

Each window of an item is a set of shingles that a document must hold in full, in order and side by side. So one shingle of
each is a prefix that no match escapes: its rarest one in the corpus. Documents join by their shingles with these prefix
tokens alone; length and place of a hit rule windows out that would not fit into the document, and the words around it are
compared with the window's. Windows of which a shingle is nowhere in the corpus are gone before. Documents are read once to
count the items' shingles and once for the join, and never shuffled: what leaves a task are counts and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 5
#: Different item shingles, prefix tokens or pairs of window and item that are broadcast; more go by shuffles.
MOST_SHINGLES, MOST_TOKENS = 2_000_000, 250_000


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """window (its words, joined by spaces), item_id: each once. An item of fewer words than size, but not none, is one
    window; null texts have no words."""
    t = items.select(F.col("item_id"), common.terms(F.col("text")).alias("w"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return t.select("item_id", "w", F.explode(starts).alias("at")).select(F.array_join(F.slice("w", F.col("at"), size), " ").alias("window"), "item_id").distinct()


def shingled(window_rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """window, words, m (words of it), at, length, token for each shingle: `shingle` words, or all of a shorter window."""
    t = window_rows.select("window", F.split("window", " ").alias("words")).withColumn("m", F.size("words")).withColumn("length", F.least("m", F.lit(shingle)))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("length"))).alias("at"))
    return t.withColumn("token", F.xxhash64("length", F.slice("words", F.col("at") + 1, F.col("length"))))


def occurrences(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """text_key, words, n, at, token for each shingle of the given lengths in docs (text_key, words)."""
    most = max(lengths)
    shifted = [F.col("words"), *(F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))) for i in range(1, most))]
    spots = docs.withColumn("n", F.size("words")).select("text_key", "words", "n", F.posexplode(F.arrays_zip(*(c.alias(f"w{i}") for i, c in enumerate(shifted)))).alias("at", "w"))
    token = lambda k: F.xxhash64(F.lit(k), *(F.col(f"w.w{i}") for i in range(k)))
    if len(lengths) == 1:
        return spots.filter(F.col("at") + most <= F.col("n")).select("text_key", "words", "n", "at", token(most).alias("token"))
    each = F.explode(F.filter(F.array(*(F.when(F.col("at") + k <= F.col("n"), token(k)) for k in lengths)), lambda x: x.isNotNull()))
    return spots.select("text_key", "words", "n", "at", each.alias("token"))


def hits(docs: DataFrame, window_rows: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, most_shingles: int = MOST_SHINGLES, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """text_key, at, m, window: every occurrence of a window in docs (text_key, words), each once for equal texts."""
    pieces = common.written(shingled(window_rows.select("window").distinct(), shingle), "item_shingles")
    lengths = [r["length"] for r in pieces.select("length").distinct().orderBy("length").collect()]  # at most `shingle` numbers
    if not lengths:
        return docs.sparkSession.createDataFrame([], "text_key string, at int, m int, window string")
    wanted = pieces.select("token").distinct()
    found = occurrences(docs, lengths)
    if wanted.count() <= most_shingles:
        counts = found.join(F.broadcast(wanted), "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    else:
        counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(wanted, "token")
    # a window with a shingle that no document has can't occur
    rarity = pieces.join(common.written(counts, "shingle_counts"), "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = rarity.groupBy("window").agg(F.min(F.struct("df", "token", F.col("at").alias("offset"), "m", "words")).alias("p")).filter("p.df > 0")
    prefix = common.written(rarest.select("window", "p.token", "p.offset", "p.m", F.col("p.words").alias("own")), "prefix_tokens")
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("m") <= F.col("n"))
    if prefix.count() <= most_tokens:
        same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("m")) == F.col("own")
        met = found.join(F.broadcast(prefix), "token").filter(fits & same)
    else:  # each occurrence takes along the words that a window around it can have
        first = F.greatest(F.col("at") - size, F.lit(0))
        near = found.withColumn("first", first).withColumn("near", F.slice("words", F.col("first") + 1, 2 * size + shingle)).drop("words")
        same = F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("m")) == F.col("own")
        met = near.join(prefix, "token").filter(fits & same)
    return met.select("text_key", start.alias("at"), "m", "window").distinct()


def covered(found: DataFrame) -> DataFrame:
    """text_key, n_hit: the words inside any hit, by a running end over the hits in order."""
    ends = found.groupBy("text_key", "at").agg(F.max(F.col("at") + F.col("m")).alias("end"))
    before = F.max("end").over(Window.partitionBy("text_key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("at"), F.coalesce(before, F.col("at"))), F.lit(0))
    return ends.select("text_key", new.alias("new")).groupBy("text_key").agg(F.sum("new").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, size: int = WINDOW, shingle: int = SHINGLE, most_shingles: int = MOST_SHINGLES, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """row (the columns keep of docs as a struct, all unless given: they go through the last join), n_words, n_hit, items (ids of the items with windows in the text, sorted as
    strings), contaminated for every document.

    Null and empty texts have no words and no hits. Repeated rows get a row each and equal texts equal results, whatever
    their doc_ids. Items of equal ids count as one item; windows of items without an id hit words, but there is no id to
    list. An empty benchmark hits nothing; an empty table gives no rows. Extra columns come back in row."""
    keyed = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"), common.terms(F.col("text")).alias("words"))
    of_items = common.written(windows(items, size), "item_windows")
    found = common.written(hits(keyed.select("text_key", "words"), of_items, size, shingle, most_shingles, most_tokens), "window_hits")
    pairs = of_items.filter("item_id IS NOT NULL")
    pairs = F.broadcast(pairs) if pairs.count() <= most_tokens else pairs
    listed = found.select("text_key", "window").distinct().join(pairs, "window").select("text_key", F.col("item_id").cast("string").alias("id")).distinct()
    listed = listed.groupBy("text_key").agg(F.array_sort(F.collect_list("id")).alias("items"))
    results = common.written(covered(found).join(listed, "text_key", "left"), "contamination")
    none = F.array().cast("array<string>")
    out = keyed.select("row", "text_key", F.size("words").cast("long").alias("n_words")).join(results, "text_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("row", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), (n_hit > 0).alias("contaminated"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document, null doc_ids and repeated rows too; items in order, as one digest."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = contamination(docs, common.table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {common.TERMS_SQL} AS words FROM documents),
 i AS (SELECT item_id, {common.TERMS_SQL} AS words FROM benchmark),
 w AS (SELECT DISTINCT item_id, words[s + 1 : s + {WINDOW}] AS win FROM (SELECT item_id, words, unnest(range(greatest(len(words) - {WINDOW} + 1, 1))) AS s FROM i WHERE len(words) > 0)),
 m AS (SELECT DISTINCT len(win) AS m FROM w),
 h AS (SELECT r, s, m, win FROM (SELECT r, s, m, words[s + 1 : s + m] AS win FROM (SELECT r, words, m, unnest(range(len(words) - m + 1)) AS s FROM d, m WHERE len(words) >= m)) SEMI JOIN w USING (win)),
 n AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS place FROM h) GROUP BY r),
 f AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h JOIN w USING (win) WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN f USING (r)"""
