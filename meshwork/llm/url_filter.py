"""URL filters: host and path rules, and an empirical-Bayes reputation of hosts for pages that no rule decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, host and path prefix), as the contract of op10 has them.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null url or one without ://."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return common.ascii_lower(host), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host (or a parent of it) and the path's start, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _prior(groups: DataFrame, least: float = 1.0, most: float = 1000.0) -> tuple[float, float]:
    """Rate p and strength s of a beta prior by the method of moments over groups (n, k); one row reaches the driver."""
    t = groups.filter("n > 0").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("n").alias("g"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not t.n:
        return 0.5, least
    p, room = t.k / t.n, t.n - t.nn / t.n
    if not 0 < p < 1 or room <= 0:
        return min(max(p, 1e-6), 1 - 1e-6), most
    between = (t.kk - t.n * p * p - (t.g - 1) * p * (1 - p)) / room
    return p, most if between <= 0 else min(max(p * (1 - p) / between - 1, least), most)


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Posterior of the share of bad pages of each host in pages: host, n, k, bad_rate, lower (one-sided 95 % bound).

    outcomes (page_id, bad 0/1): repeated ids count once, as bad if any says so; ids without a page and nulls are left
    out. A host's beta prior has its registered domain's mean (the last two labels), a domain's its suffix's, a
    suffix's the overall rate; the three strengths come from the data. Hosts without outcomes get their domain's mean."""
    known = outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("double").alias("bad"))
    hosts = pages.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("k"))
    hosts = common.written(hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1)), "hosts")
    sums = lambda level: hosts.groupBy(level).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall, s_suffix = _prior(sums("suffix"))
    (_, s_domain), (_, s_host) = _prior(domains), _prior(hosts)
    shrunk = lambda s, mean: (F.col("k") + s * mean) / (F.col("n") + s)
    suffixes = sums("suffix").select("suffix", shrunk(s_suffix, F.lit(overall)).alias("m_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(s_domain, F.col("m_suffix")).alias("m_domain"))
    m, strength = shrunk(s_host, F.col("m_domain")), F.col("n") + s_host
    return hosts.join(domains, "domain").select("host", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), m.alias("bad_rate"), (m - 1.645 * F.sqrt(m * (1 - m) / (strength + 1))).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, most_bad: float = 0.5, url: str = "url", key: str = "page_id") -> DataFrame:
    """One row for each page: key, host, path, rule, verdict, bad_rate, lower.

    A rule decides where one fits; else a page is blocked if the lower bound of its host's share of bad pages is above
    most_bad. Repeated pages get a row each; null keys and urls are judged like others (no host: the empty host)."""
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parts.join(reputation(parts, outcomes).select("host", "bad_rate", "lower"), "host")
    by_method = F.when(F.col("lower") > most_bad, "block").otherwise("allow")
    return judged.select(F.col("page_id").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), F.round("bad_rate", 9).alias("bad_rate"), F.round("lower", 9).alias("lower"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels of the documents with the pages' ids; bad are toxic ones and those of low quality."""
    labels = common.table(spark, sf_dir, "labels")
    bad = F.greatest(F.coalesce(F.col("toxic"), F.lit(0)), 1 - F.coalesce(F.col("quality"), F.lit(1)))
    return filter_urls(common.table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


_PRIOR = """SELECT CASE WHEN n IS NULL OR n = 0 THEN 0.5 WHEN k > 0 AND k < n AND n - nn / n > 0 THEN k / n ELSE least(greatest(k / n, 1e-6), 1 - 1e-6) END AS p,
 CASE WHEN n IS NULL OR n = 0 THEN 1.0 WHEN NOT (k > 0 AND k < n AND n - nn / n > 0) THEN 1000.0 WHEN (kk - k * k / n - (g - 1) * k / n * (1 - k / n)) <= 0 THEN 1000.0
 ELSE least(greatest(k / n * (1 - k / n) / ((kk - k * k / n - (g - 1) * k / n * (1 - k / n)) / (n - nn / n)) - 1, 1.0), 1000.0) END AS s
 FROM (SELECT sum(n) AS n, sum(k) AS k, count(*) AS g, sum(k * k / n) AS kk, sum(n * n) AS nn FROM {0} WHERE n > 0)"""
OP10_SQL = rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
l AS (SELECT doc_id, max(greatest(coalesce(toxic, 0), 1 - coalesce(quality, 1)))::DOUBLE AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0) AS k, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM p LEFT JOIN l ON doc_id = page_id GROUP BY host),
d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain),
x AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix),
ph AS ({_PRIOR.format("h")}), pd AS ({_PRIOR.format("d")}), px AS ({_PRIOR.format("x")}),
mx AS (SELECT suffix, (k + px.s * px.p) / (n + px.s) AS m FROM x, px),
md AS (SELECT domain, (k + pd.s * mx.m) / (n + pd.s) AS m FROM d JOIN mx USING (suffix), pd),
mh AS (SELECT host, (k + ph.s * md.m) / (n + ph.s) AS m, n + ph.s AS w FROM h JOIN md USING (domain), ph),
r(what, rule, rh, rp) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
f AS (SELECT page_id, host, path, max_by(rule, (length(rule), rule)) AS rule, max_by(what, (length(rule), rule)) AS what FROM (SELECT DISTINCT page_id, host, path FROM p) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.what, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (w + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(m, 9) AS bad_rate, round(m - 1.645 * sqrt(m * (1 - m) / (w + 1)), 9) AS lower
FROM p JOIN mh ON p.host = mh.host LEFT JOIN f ON f.page_id IS NOT DISTINCT FROM p.page_id AND f.host = p.host AND f.path = p.path
"""
