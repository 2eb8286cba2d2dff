"""Target-distribution importance resampling: documents are drawn by how much more likely their hashed features are in a
target than in the corpus, with Gumbel noise, so that the highest scores are a sample without replacement.

Gains of the buckets are one array, by which each text is scored in a single pass. The cutoff of the draw is found without
sorting the corpus: quantiles of a sketch bracket it, exact counts outside confirm the bracket or widen it, and only the
rows inside are sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

BUCKETS, RUNS, PERCENT, SEED, LEAST_WORDS = 10_000, (1, 1), 10, 2024, 20
#: Of the quantile sketch; half the bracket's first width in ranks is WIDTH / ACCURACY of all rows, and grows by WIDEN.
ACCURACY, WIDTH, WIDEN = 10_000, 2, 8
#: Rows of a range where rows are ranked, on average.
RANGE_ROWS = 50_000


def features(words: Column, runs: tuple[int, int] = RUNS) -> Column:
    """All runs of runs[0] to runs[1] words, joined by one space."""

    def of_size(k: int) -> Column:
        at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
        return words if k == 1 else F.transform(at, lambda i: F.array_join(F.slice(words, i, k), " "))

    found = [of_size(k) for k in range(runs[0], runs[1] + 1)]
    return found[0] if len(found) == 1 else F.concat(*found)


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(texts: DataFrame, name: str, buckets: int = BUCKETS, runs: tuple[int, int] = RUNS) -> DataFrame:
    """bucket and a count of all features in it: counted within tasks first, so that at most `buckets` rows leave each."""
    each = texts.select(F.explode(features(common.terms(F.col("text")), runs)).alias("feature"))
    return each.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, runs: tuple[int, int] = RUNS) -> DataFrame:
    """One row with `gains`, an array of `buckets` longs."""
    both = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = both.join(bucket_counts(docs, "s", buckets, runs), "bucket", "left").join(bucket_counts(target, "t", buckets, runs), "bucket", "left").fillna(0)
    one = lambda c: F.array_sort(F.collect_list(F.struct("bucket", c)))
    row = both.agg(one("s").alias("s"), one("t").alias("t"), F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c, more: (c + more).cast("double")
    ratio = lambda s, t: d(t["t"], 1) * d(F.col("all_s"), buckets) / (d(s["s"], 1) * d(F.col("all_t"), buckets))
    return row.select(F.zip_with("s", "t", lambda s, t: F.floor(1000 * F.log(ratio(s, t))).cast("long")).alias("gains"))


def scored(docs: DataFrame, target: DataFrame, keep: list[str], buckets: int = BUCKETS, runs: tuple[int, int] = RUNS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """The columns keep as a struct `row`, doc_id, n_features, weight, score, eligible, place (tells repeated rows apart):
    a table in the shared folder, so that every later pass reads numbers and not texts."""
    gain = common.written(gains(docs, target, buckets, runs), "gains")
    row = F.struct(*keep).alias("row") if keep else F.struct(F.lit(None).cast("string").alias("none")).alias("row")
    t = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), common.terms(F.col("text")).alias("words"))
    t = t.withColumn("features", features(F.col("words"), runs)).crossJoin(F.broadcast(gain))  # one row of fixed size
    total = F.aggregate("features", F.lit(0).cast("long"), lambda a, f: a + F.get(F.col("gains"), bucket(f, buckets).cast("int")))
    t = t.select("row", "doc_id", F.size("features").cast("long").alias("n_features"), total.alias("total"), (F.size("words") >= least_words).alias("eligible"), F.monotonically_increasing_id().alias("place"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    return common.written(t.select("row", "doc_id", "n_features", weight.alias("weight"), (weight + noise).alias("score"), "eligible", "place"), "scored")


def order_key() -> Column:
    """Higher scores first, then smaller doc_ids (null last); what is left tells rows apart that are alike."""
    return F.struct((-F.col("score")).alias("a"), F.col("doc_id").isNull().alias("b"), F.coalesce("doc_id", F.lit(0)).alias("c"), F.col("n_features").alias("d"), F.col("weight").alias("e"), F.col("place").alias("f"))


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """The n rows with `key` and `rank` from 1: dealt to ranges of the key, numbered there, and moved by the rows of the
    ranges before. No task sorts more than a range; equal scores and ids are split by place."""
    spark = rows.sparkSession
    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS)))
    dealt = rows.withColumn("key", order_key()).repartitionByRange(ranges, "key").sortWithinPartitions("key").withColumn("at", F.monotonically_increasing_id())
    dealt = common.written(dealt, "ranges").withColumn("range", F.shiftright("at", 33))
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row for each range
    return dealt.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("range", "at", "before")


def cutoff(pool: DataFrame, n: int, k: int, width: float = WIDTH / ACCURACY):
    """The key of the k-th of the n rows of pool (1 <= k <= n), and how many brackets were tried."""
    tries, middle = 0, 1 - k / n
    while True:
        tries += 1
        low, high = max(0.0, middle - width), min(1.0, middle + width)
        lo, hi = pool.agg(F.percentile_approx("score", [low, high], ACCURACY)).first()[0]
        least = F.lit(True) if low == 0.0 else F.col("score") >= lo
        above = F.lit(False) if high == 1.0 else F.col("score") > hi
        found = pool.agg(F.count(F.when(above, 1)).alias("above"), F.count(F.when(least & ~above, 1)).alias("inside")).first()
        if found["above"] < k <= found["above"] + found["inside"]:
            at = ranked(pool.filter(least & ~above), found["inside"]).filter(F.col("rank") == k - found["above"]).select("key.*").first()
            return at, tries
        width *= WIDEN


def resample(docs: DataFrame, target: DataFrame, keep: list[str] | None = None, percent: float = PERCENT, buckets: int = BUCKETS, runs: tuple[int, int] = RUNS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """row (the columns keep of docs, all unless given), doc_id, n_features, weight, score, rank for every document; rank is
    null for those not drawn.

    Null texts have no words. Texts without features weigh 0. A null doc_id draws its noise as an empty one and comes last
    in ties; repeated rows count each and, where only some of them fit, any of them are drawn, since all their numbers are
    equal. An empty target gives every bucket its gain against no counts; an empty table gives no rows. Extra columns are
    untouched in row, whatever their names."""
    s = scored(docs, target, docs.columns if keep is None else keep, buckets, runs, seed, least_words)
    pool = s.filter("eligible")
    n = pool.count()
    k = int(percent * n // 100)
    names = ["row", "doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return s.select(*names, none)
    at, _ = cutoff(pool, n, k)
    last = F.struct(*(F.lit(v).cast(t).alias(c) for v, (c, t) in zip(at, (("a", "long"), ("b", "boolean"), ("c", "long"), ("d", "long"), ("e", "long"), ("f", "long")))))
    drawn = F.col("eligible") & (order_key() <= last)
    return ranked(s.filter(drawn), k).select(*names, F.col("rank").cast("long")).unionByName(s.filter(~drawn).select(*names, none))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's numbers and rank in a draw of a tenth towards benchmark; null doc_ids and repeated rows stay."""
    docs, target = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark").select("text")
    return resample(docs, target, keep=[]).drop("row")


#: CRC-32 byte by byte, of each different word once.
_CRC = "list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))"
OP13_SQL = f"""WITH dw AS (SELECT r, unnest(words) AS w FROM (SELECT row_number() OVER () AS r, {common.TERMS_SQL} AS words FROM documents)),
 d AS (SELECT row_number() OVER () AS r, doc_id FROM documents),
 tw AS (SELECT unnest({common.TERMS_SQL}) AS w FROM benchmark),
 voc AS (SELECT w, xor({_CRC}, 4294967295) % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM tw)),
 s AS (SELECT b, count(*) AS s FROM dw JOIN voc USING (w) GROUP BY b),
 t AS (SELECT b, count(*) AS t FROM tw JOIN voc USING (w) GROUP BY b),
 g AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (b)),
 f AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM dw JOIN voc USING (w) JOIN g USING (b) GROUP BY r),
 k AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END::BIGINT AS weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (r)),
 z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM k),
 o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, (SELECT {PERCENT} * count(*) // 100 FROM z WHERE n_features >= {LEAST_WORDS}) AS most FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= most THEN place END::BIGINT AS rank FROM o"""
