import hashlib
import math
import random
import re
import zlib

import pytest

from meshwork.llm import resampling

SCHEMA = "doc_id long, text string, row string, words int, features int, rank long, key string, place long, gains int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs_of(text, runs):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(runs[0], runs[1] + 1) for i in range(len(w) - k + 1)]


def expected(docs, target, percent=10, buckets=10_000, runs=(1, 1), seed=2024, least=20):
    b = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in runs_of(text, runs):
            s[b(f)] += 1
    for text in target:
        for f in runs_of(text, runs):
            t[b(f)] += 1
    gain = [math.floor(1000 * math.log(float(y + 1) * float(sum(s) + buckets) / (float(x + 1) * float(sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for doc, text in docs:
        own = [gain[b(f)] for f in runs_of(text, runs)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    pool = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(pool[: int(percent * len(pool) // 100)]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def made(spark, docs, target, **more):
    d = spark.createDataFrame([(i, t, "r", 1, 2, 3, "k", 4, 5) for i, t in docs], SCHEMA).repartition(5)
    out = resampling.resample(d, spark.createDataFrame([(x,) for x in target], "text string"), **more)
    assert out.select("row.*").columns == d.columns
    return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def corpus(n=400):
    rnd = random.Random(6)
    of = [f"w{i}" for i in range(200)] + ["É", "日本"]
    docs = [(i * 7 % 1009, " ".join(rnd.choice(of[: rnd.choice([30, 202])]) for _ in range(rnd.choice([3, 19, 20, 21, 60])))) for i in range(n)]
    docs += [(None, docs[0][1]), (None, None), (5000, None), (5001, ""), (5002, ".,"), (5003, "W1 " * 5000), docs[8], docs[8], (docs[8][0], docs[4][1])]
    return docs, [" ".join(rnd.choice(of[:30]) for _ in range(50)) for _ in range(5)] + [None, ""]


@pytest.mark.parametrize("more", [{}, {"percent": 37, "runs": (1, 2), "buckets": 64, "seed": 5, "least": 1}, {"percent": 100, "runs": (2, 3)}, {"percent": 0}])
def test_against_brute_force(spark, more):
    docs, target = corpus()
    given = {("least_words" if k == "least" else k): v for k, v in more.items()}
    assert made(spark, docs, target, **given) == expected(docs, target, **more)


def test_many_alike(spark, monkeypatch):
    """A third and more of all rows with one score and no doc_id, cut through in the middle, over many ranges."""
    monkeypatch.setattr(resampling, "RANGE_ROWS", 40)
    docs, target = corpus(100)
    docs += [(None, " ".join(["w1"] * 30))] * 900
    for percent in (5, 50, 97):
        assert made(spark, docs, target, percent=percent) == expected(docs, target, percent=percent)


@pytest.mark.parametrize("width", [0.0002, 1e-9])
def test_cutoff_widens_its_bracket(spark, width):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(-3, 3) if i % 3 else 0, 5, 1, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, score long, n_features long, weight long, place long")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (1, 299, 1500, 2999, 3000):
        at, tries = resampling.cutoff(df, 3000, k, width)
        assert (-at["a"], at["c"]) == (order[k - 1][1], order[k - 1][0]) and tries >= 1


def test_nothing(spark):
    docs, target = corpus(30)
    assert made(spark, [], target) == []
    assert made(spark, docs, []) == expected(docs, [])
