"""Readers and writers of a campaign's run folder: solve logs, timers, status tables, variants, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import scan

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def run_name() -> Column:
    """The file's name without folder, `log.` in front and extension."""
    base = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return F.regexp_replace(F.regexp_replace(base, r"^log\.", ""), r"\.(csv|txt)$", "")


def read_log(spark: SparkSession, path: str, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """CSV logs with a header; columns that older files lack get the default (or null). `run` is the file's name."""
    raw = spark.read.option("header", True).csv(path)
    own = {}
    for f in schema.fields:
        value = F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in raw.columns else F.lit(None).cast(f.dataType)
        own[f.name] = F.coalesce(value, F.lit((defaults or {}).get(f.name)).cast(f.dataType))
    return raw.select(run_name().alias("run"), *(c.alias(n) for n, c in own.items()))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """value, run, at: lines in order within their file (files are not split)."""
    whole = spark.read.text(path, wholetext=True).select(run_name().alias("run"), F.split("value", r"\r?\n").alias("lines"))
    return whole.select("run", F.posexplode("lines").alias("at", "value"))


def read_timers(spark: SparkSession, path: str) -> DataFrame:
    """run, timer, min, avg, max from the table at the end of each log: the lines after its last heading `phase min avg max`."""
    return parse_timers(_numbered(spark, path))


def parse_timers(lines: DataFrame) -> DataFrame:
    """As read_timers, from run, at (the line's place), value."""
    heading = F.col("value").rlike(r"^\s*\S.*\bmin\b.*\bavg\b.*\bmax\b")
    by = Window.partitionBy("run")
    marked = lines.withColumn("start", F.max(F.when(heading, F.col("at"))).over(by))
    row = rf"^\s*(\S+)\s+({NUMBER})\s+({NUMBER})\s+({NUMBER})\s*$"
    found = marked.filter((F.col("at") > F.col("start")) & F.col("value").rlike(row))
    part = lambda k: F.regexp_extract("value", row, k)
    return found.select("run", part(1).alias("timer"), *(part(k).cast("double").alias(n) for k, n in ((2, "min"), (3, "avg"), (4, "max"))))


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """name, np, status, wall from lines of white-space separated fields; comments and short lines are left out."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter((F.size(t) >= 4) & ~F.trim("value").startswith("#"))
    return rows.select(F.get(t, F.lit(0)).alias("name"), F.expr(r"try_cast(get(split(trim(value), '\\s+'), 1) AS int)").alias("np"), F.get(t, F.lit(2)).alias("status"), F.expr(r"try_cast(get(split(trim(value), '\\s+'), 3) AS double)").alias("wall")).filter("np IS NOT NULL")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """run, key, setting from KEY='value' and KEY=value words."""
    return parse_settings(spark.read.text(path, wholetext=True).select(run_name().alias("run"), "value"))


def parse_settings(text: DataFrame, run: str = "run") -> DataFrame:
    """As read_settings, from run (of any name) and value, the whole text."""
    pairs = F.regexp_extract_all("value", F.lit(r"([A-Za-z_]\w*)=('[^']*'|\"[^\"]*\"|\S*)"), F.lit(0))
    one = text.select(run, F.explode(pairs).alias("pair"))
    return one.select(run, F.regexp_extract("pair", r"^(\w+)=", 1).alias("key"), F.regexp_replace(F.regexp_replace("pair", r"^\w+=", ""), r"^['\"]|['\"]$", "").alias("setting"))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """place, name, options of each variant, in the file's order."""
    rows = _numbered(spark, path).filter(r"trim(value) <> '' AND NOT trim(value) LIKE '#%'")
    row = r"^\s*(\S+)\s*(.*?)\s*$"
    place = F.row_number().over(Window.partitionBy("run").orderBy("at")) - 1
    return rows.select(place.alias("place"), F.regexp_extract("value", row, 1).alias("name"), F.regexp_extract("value", row, 2).alias("options"))


def read_facts(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """run and one number for each pattern's first group in the whole log; null where it doesn't occur."""
    return parse_facts(spark.read.text(path, wholetext=True).select(run_name().alias("run"), "value"), patterns)


def parse_facts(text: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """As read_facts, from run and value, the whole text."""
    fact = lambda p: F.regexp_extract("value", p, 1).try_cast("double")
    return text.select("run", *(fact(p).alias(n) for n, p in patterns.items()))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """k, rel_res from lines of two numbers."""
    return spark.read.schema("k int, rel_res double").option("sep", " ").csv(path)


def history_lines(rows: DataFrame) -> DataFrame:
    """value: the lines of a history (k, v) with ten digits."""
    return rows.select(F.concat_ws(" ", F.col("k").cast("string"), F.format_string("%.10e", "v")).alias("value"))


def write_history(history: list[float], spark: SparkSession, path: str) -> None:
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(history)], "k int, v double")
    history_lines(rows.coalesce(1)).write.text(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Appends to a folder of CSV files, each with a header."""
    rows.write.mode("append").option("header", True).csv(path)


def markdown(rows: DataFrame, *order: str) -> DataFrame:
    """at, line: the lines of a report table in the order of some columns, numbers to the right; its head is at -2 and -1."""
    right = [t not in ("string", "boolean") for _, t in rows.dtypes]
    shown = lambda c, t: F.format_string("%.3f", F.col(c)) if t in ("float", "double") else F.col(c).cast("string")
    cells = [F.coalesce(F.when(F.col(c).isNotNull(), shown(c, t)), F.lit("-")) for c, t in rows.dtypes]
    body = scan.placed(rows, *order, name="at").select("at", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = [(-2, "| " + " | ".join(rows.columns) + " |"), (-1, "|" + "|".join("--:" if r else ":--" for r in right) + "|")]
    return rows.sparkSession.createDataFrame(head, "at long, line string").unionByName(body)
