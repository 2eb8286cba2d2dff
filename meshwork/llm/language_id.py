"""Language ID: multinomial naive Bayes over hashed character 2- and 3-grams; numpy scores batches of whole texts."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Cells of the hashed n-gram space; the model has this many log probabilities for each language.
CELLS = 1 << 16
#: At most about so many labelled documents are learned from, chosen by a hash of the id.
MOST_TRAINED = 20_000
#: Code points that are scored at once.
SLICE = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a code point is of Unicode's category L; the pattern alone takes letter-like numbers as well."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _cells(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
    return two >> np.uint32(16), three >> np.uint32(16)


def _count(batches):
    """Counts of each language in this task, in 16 slices."""
    import pyarrow as pa

    common.release()
    seen: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            n = seen.setdefault(lang, np.zeros(CELLS, dtype=np.int64))
            docs[lang] = docs.get(lang, 0) + 1
            for cells in _cells(_points(text)):
                n += np.bincount(cells, minlength=CELLS)
    for lang, n in seen.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang] * 16, "slice": list(range(16)), "docs": [docs[lang]] * 16, "counts": [x.tobytes() for x in n.reshape(16, -1)]}, schema=pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("docs", pa.int64()), ("counts", pa.binary())]))


def _add(t):
    import pyarrow as pa

    total = np.sum([np.frombuffer(x, dtype=np.int64) for x in t.column("counts").to_pylist()], axis=0, dtype=np.int64)
    return pa.table({"lang": t.column("lang")[:1], "slice": t.column("slice")[:1], "docs": pa.array([sum(t.column("docs").to_pylist())]), "counts": pa.array([total.tobytes()], pa.binary())})


class Model:
    """Languages, and the log probabilities (CELLS x languages)."""

    def __init__(self, langs: list[str], log_p: np.ndarray, log_prior: np.ndarray):
        self.langs, self.log_p, self.log_prior = langs, log_p, log_prior

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior of each text of a batch. The batch's n-grams are the columns of one sparse product with the
        log probabilities: they are looked up slice by slice and summed by text; n-grams across two texts count for none."""
        known = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        points = [_points(texts[i]) for i in known]
        sums = np.tile(self.log_prior, (len(known), 1))
        flat, of = np.concatenate([np.empty(0, np.uint32), *points]), np.repeat(np.arange(len(known)), [len(p) for p in points])
        for at in range(0, len(flat), SLICE):
            c, text = flat[at : at + SLICE + 2], of[at : at + SLICE + 2]
            for size, cells in zip((2, 3), _cells(c)):
                n = min(len(cells), SLICE)
                own = text[:n]
                inside = own == text[size - 1 : size - 1 + n]
                own, cells = own[inside], cells[:n][inside]
                if len(own):
                    starts = np.flatnonzero(np.diff(own, prepend=-1))
                    sums[own[starts]] += np.add.reduceat(self.log_p[cells], starts, axis=0, dtype=np.float64)
        out = [("und", 0.0)] * len(texts)
        for i, s in zip(known, sums):
            best = int(s.argmax())
            out[i] = self.langs[best], float(1 / np.exp(s - s[best]).sum())
        return out


def fit(docs: DataFrame, most: int = MOST_TRAINED) -> Model:
    """Learns from rows with text and lang: of each language all, or some most / (number of languages) chosen by a hash of
    id and text, so that a rare one is learned at any size. Priors are the shares of all rows. Only the summed counts reach
    the driver: CELLS numbers for each language."""
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows_of = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}  # a row for each language, as in the model
    each = F.lit(0.0)
    for lang, n in rows_of.items():
        each = F.when(F.col("lang") == lang, common.sample_rate(n, most // len(rows_of))).otherwise(each)
    turn = F.pmod(F.xxhash64(F.lit(0x5EED), "doc_id", "text"), F.lit(1 << 30))
    part = docs.filter(turn < (each * (1 << 30)).cast("long")).select("lang", "text")
    schema = "lang string, slice int, docs long, counts binary"
    rows = part.mapInArrow(_count, schema).groupBy("lang", "slice").applyInArrow(_add, schema).collect()
    langs = sorted({r.lang for r in rows})
    n = np.zeros((CELLS, len(langs)))
    docs_of = np.array([rows_of[x] for x in langs], dtype=np.float64)
    for r in rows:
        x = np.frombuffer(r["counts"], dtype=np.int64)
        n[r["slice"] * len(x) : (r["slice"] + 1) * len(x), langs.index(r.lang)] = x
    n += 0.5
    return Model(langs, np.log(n / n.sum(axis=0)).astype(np.float32), np.log(docs_of / docs_of.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (posterior of the predicted language, 0 for `und`) in place of text;
    docs' own columns of these two names are left out.

    `und` for null or empty texts, texts without a letter, and whenever nothing was learned."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = docs.select(*rest, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def score(batches):
        common.release()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = shared.value.predict(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*rest, "lang_pred", "score"])

    return docs.select(*rest, text).mapInArrow(score, schema)


def held_out(key: str, folds: int = 5):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; learned from the rows that are not held out.

    Repeated rows are judged alike; a null doc_id counts as an empty one; an empty table gives no rows."""
    own = docs.select("doc_id", "text", "lang", held_out("doc_id").alias("held_out"))
    return predict(own.select("doc_id", "held_out", "text"), fit(own.filter("NOT held_out")))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs, all columns (of any names), without those of no language (`und`) or a posterior below least."""
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out("doc_id")))
    judged = predict(common.boxed(docs).select("row", "text"), model)
    return common.unboxed(judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; nulls, texts without a letter, repeated rows and empty tables as in predict and identify."""
    return identify(common.table(spark, sf_dir, "documents"))
