"""Quality classifier: ordinal cumulative-link (proportional odds) regression on graded ratings over hashed text.

P(grade >= k) = sigmoid(w . x - t_k) with one weight vector and ordered thresholds. Expected grade and the probability
of the top grades follow, and documents are selected by the latter."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CELLS = 1 << 18
#: At most about so many rated documents are learned from, chosen by a hash of the id; their hashed words reach the driver.
MOST_TRAINED = 4_000
EPOCHS, RATE, DECAY, BATCH = 40, 0.5, 1e-5, 256
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Cells and values: tempered counts of words and marks, and a few of the text's shape, of length one together."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = _WORD.findall(data.lower())
    cells, n = np.unique(np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) % (CELLS - 8), return_counts=True)
    v = np.log1p(n)
    v /= np.sqrt((v * v).sum()) or 1.0
    size = max(len(data), 1)
    lines = data.split(b"\n")
    shape = [1.0, np.log1p(len(words)) / 10, len(set(words)) / max(len(words), 1), sum(map(len, words)) / max(len(words), 1) / 10, len(set(lines)) / len(lines), len(re.findall(rb"[A-Z]", data)) / size, len(re.findall(rb"[0-9]", data)) / size, len(re.findall(rb"[!-/:-@\[-`{-~]", data)) / size]
    return np.concatenate([cells, np.arange(CELLS - 8, CELLS)]), np.concatenate([v, shape])


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def at_least(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        cells, v = features(text)
        return 1 / (1 + np.exp(self.thresholds - self.weights[cells] @ v))


def fit(rated: DataFrame, grades: int, most: int = MOST_TRAINED) -> Model:
    """rated: doc_id, text, grade (0 ... grades - 1); rows with a null grade are left out. Without rows every grade is equally likely."""
    rated = rated.filter(F.col("grade").isNotNull())
    rate = common.sample_rate(rated.count(), most)

    def hashed(batches):
        import pyarrow as pa

        for b in batches:
            found = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array([x.astype("<i4").tobytes() for x, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())], names=["doc_id", "grade", "cells", "v"])

    own = rated.filter(common.chosen(F.col("doc_id"), rate)).select(F.col("doc_id").cast("long"), F.col("grade").cast("int"), "text")
    rows = own.mapInArrow(hashed, "doc_id long, grade int, cells binary, v binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), bytes(r["v"])))
    w, t = np.zeros(CELLS), np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1))
    data = [(np.frombuffer(bytes(r.cells), "<i4"), np.frombuffer(bytes(r["v"]), "<f4").astype(np.float64), r.grade) for r in rows]
    sums, sums_t = np.full(CELLS, 1e-8), np.full(grades - 1, 1e-8)
    for epoch in range(EPOCHS if data else 0):
        for at in range(0, len(data), BATCH):
            g, g_t, part = np.zeros(CELLS), np.zeros(grades - 1), data[at : at + BATCH]
            for cells, v, y in part:
                s = 1 / (1 + np.exp(t - w[cells] @ v))  # P(grade >= k)
                upper, lower = (1.0 if y == 0 else s[y - 1]), (0.0 if y == grades - 1 else s[y])
                p = max(upper - lower, 1e-9)
                d_up, d_low = upper * (1 - upper) / p, lower * (1 - lower) / p
                g[cells] += (d_up - d_low) * v
                if y:
                    g_t[y - 1] -= d_up
                if y < grades - 1:
                    g_t[y] += d_low
            g, g_t = g / len(part) - DECAY * w, g_t / len(part)
            sums, sums_t = sums + g * g, sums_t + g_t * g_t
            w += RATE * g / np.sqrt(sums)
            t = np.maximum.accumulate(t + RATE * g_t / np.sqrt(sums_t))
    return Model(w, t)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def rate(docs: DataFrame, model: Model, top: int, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade of top or more), selected (that is least or more) of each row.

    Whole texts are judged; null ones count as empty. Repeated rows get a row each. Only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        import pyarrow as pa

        for b in batches:
            p = np.array([shared.value.at_least(t) for t in b.column("text").to_pylist()]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(p[:, top - 1]), pa.array(p[:, top - 1] >= least)], names=["doc_id", "expected_grade", "tail_probability", "selected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, "doc_id long, expected_grade double, tail_probability double, selected boolean")


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 for toxic documents, 1 for others of low quality, 2 for the rest; the lowest of repeated labels."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that are not held out; rates all documents for grade 2."""
    docs = common.table(spark, sf_dir, "documents")
    rated = docs.filter(~held_out()).join(graded(common.table(spark, sf_dir, "labels")), "doc_id")
    return rate(docs, fit(rated, 3), 2).withColumn("held_out", held_out())
