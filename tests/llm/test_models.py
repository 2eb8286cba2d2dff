import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from meshwork.llm import fingerprint, lm_score, near_copies, quality, sentencepiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# -- fingerprints -------------------------------------------------------------------------------------------------


def edited(rows):
    """doc_id, text, edited text and next text of rows in descending doc_id."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1] or ""
        text = text or ""
        cut = len(text) // 3
        out.append((doc_id, text, text[: len(text) - cut] + other[:cut], other))
    return out


def paragraphs(text):
    out = set()
    for line in re.findall(r"[^\n]*\n+|[^\n]+", text):
        body = line.rstrip("\n")
        ends = line[len(body) :]
        parts = [body[i : i + 240] for i in range(0, len(body), 240)] or [""]
        parts[-1] += ends
        out.update(parts)
    return out


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_as_brute_force(documents):
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), reverse=True)
    found = {r.doc_id: r for r in fingerprint.versions(documents).collect()}
    assert len(found) == len(rows)
    prints = {}
    for doc_id, text, new, other in edited(rows):
        r = found[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.near_edited == pytest.approx(likeness(text, new)) and r.near_next == pytest.approx(likeness(text, other))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and prints.setdefault(new, r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_of_awkward_rows(awkward, nothing, spark):
    assert fingerprint.versions(nothing).collect() == []
    found = fingerprint.versions(awkward).collect()
    assert len(found) == awkward.count() and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in found)
    one = fingerprint.versions(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0


def test_peeling_recovers_differences_or_fails(spark):
    rnd = random.Random(3)
    rows = []
    for n in (0, 1, 3, 6, 10, 60):
        shared, a, b = ([rnd.getrandbits(63) for _ in range(k)] for k in (20, n, n // 2))
        rows.append((n, shared + a, shared + b))
    df = spark.createDataFrame(rows, "n long, a array<long>, b array<long>")
    got = df.select("n", "a", "b", fingerprint.peel(fingerprint.difference_sketch(F.col("a"), F.col("b"), 8)).alias("few"), fingerprint.changes(F.col("a"), F.col("b"), fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))).alias("all")).collect()
    for r in got:
        want = {(x, 1) for x in set(r.a) - set(r.b)} | {(x, -1) for x in set(r.b) - set(r.a)}
        assert {tuple(x) for x in r["all"]} == want and len(r["all"]) == len(want)
        assert r.few is None or {tuple(x) for x in r.few} == want
    assert got[0].few == [] and got[-1].few is None


# -- LM scoring ---------------------------------------------------------------------------------------------------


def test_scores_and_base_as_brute_force(spark, awkward, nothing):
    assert lm_score.score_texts(nothing).collect() == []
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (docs, awkward):
        rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"]) for r in df.collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = collections.Counter(w for i, t in rows if not held(i) for w in t)
        n, v = sum(c.values()), len(c)
        want = sorted((str(i), held(i), len(t), sum(w in c for w in t), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for i, t in rows)
        got = lm_score.score_texts(df).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    fitted = [r for r in lm_score.score_texts(docs).collect() if not r.held_out]
    assert sum(r.score for r in fitted) > sum(r.base_score for r in fitted)


def test_spelling_probabilities_sum_to_one():
    """Over all first bytes, and over what follows a byte, as every bit's two outcomes do."""
    words = [b"the", b"then", b"other", b"a"] * 3
    counts = np.zeros((len(lm_score.ORDERS), 2, lm_score.CELLS), dtype=np.int32)
    keys, times = np.unique(lm_score._spelling(words)[0], return_counts=True)
    for bit in range(8):
        cells, ones = lm_score._cells(keys, bit)
        for k, c in enumerate(cells):
            np.add.at(counts[k].reshape(-1), ones * lm_score.CELLS + c, times)
    m = lm_score.Mixer(counts)
    m.learn(keys, times)
    every = np.array([(keys[3] & ~np.uint64(255)) | np.uint64(b) for b in range(256)], dtype=np.uint64)
    total = np.zeros(256)
    for bit in range(8):
        x, gate, ones = m.inputs(every, bit, 0)
        s = m.mixed(x, gate)
        n = m.refined[bit][m.bucket(s)]
        p = 1 / (1 + np.exp(-s))
        p = 0.5 * (p + (n[:, 1] + 20 * p) / (n.sum(axis=1) + 20))
        total += np.log(np.where(ones == 1, p, 1 - p))
    assert np.exp(total).sum() == pytest.approx(1.0)


# -- SentencePiece ------------------------------------------------------------------------------------------------


def test_ids_as_the_library(awkward, nothing, documents, spark):
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=MODEL)
    assert sentencepiece.encode(nothing, MODEL).collect() == []
    extra = spark.createDataFrame([(1, "  two  spaces "), (2, "a▁b <s> </s>"), (3, " "), (4, "x" * 200 + "ab" * 90), (5, "日本語 𐍈 ﬁ"), (6, None), (7, " " * 27 + "a" + " " * 37 + "b"), (8, " " * 100)], "doc_id long, text string")
    allowed = {(r.doc_id, r.ids_crc32) for df in (extra, documents.filter("doc_id < 40")) for r in sentencepiece.encode(df, MODEL, "allowed").collect()}
    assert allowed == {(r.doc_id, zlib.crc32(np.array(sp.encode(r.text or ""), dtype="<u4").tobytes())) for df in (extra, documents.filter("doc_id < 40")) for r in df.collect()}
    for df in (documents.select("doc_id", "text"), awkward.select("doc_id", "text"), extra):
        want = sorted((str(r.doc_id), sp.encode(r.text or "")) for r in df.collect())
        encoded = sentencepiece.encode(df, MODEL)
        assert sorted((str(r.doc_id), list(r["ids"])) for r in encoded.collect()) == want
        texts = sorted((str(r.doc_id), sp.decode(sp.encode(r.text or ""))) for r in df.collect())
        assert sorted((str(r.doc_id), r.text) for r in sentencepiece.decode(encoded, MODEL).collect()) == texts


def test_texts_with_their_own_marks_as_the_library(spark):
    """Runs of marks that spaces and the text's own U+2581 make together; and many random texts of such characters."""
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=MODEL)
    assert not any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
    rnd = random.Random(12)
    texts = ["x▁▁  y", "▁  ▁x", "▁", " ▁", "▁ ", "a▁b", "  ▁▁  "]
    texts += ["".join(rnd.choice(["x", "the", "y", " ", " ", "▁", "▁", ".", "é", "日"]) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]
    found = sentencepiece.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL).collect()
    assert len(found) == len(texts) and [texts[r.doc_id] for r in found if list(r["ids"]) != sp.encode(texts[r.doc_id])] == []


def test_viterbi_fold_as_brute_force(spark):
    rnd = random.Random(4)
    pieces = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4))): -rnd.random() * 5 for _ in range(14)} | {"a": -3.0, "b": -3.5}
    words = ["".join(rnd.choice("ab") for _ in range(n)) for n in range(1, 11)]

    def best(w):
        if not w:
            return 0.0, ()
        return max((pieces[w[:k]] + best(w[k:])[0], (w[:k], *best(w[k:])[1])) for k in range(1, len(w) + 1) if w[:k] in pieces)

    rows = [(w, sorted((e, s, -pieces[w[s:e]]) for s in range(len(w)) for e in range(s + 1, len(w) + 1) if w[s:e] in pieces)) for w in words]
    df = spark.createDataFrame(rows, "word string, edges array<struct<e:int,s:int,cost:double>>")
    for r in df.select("word", sentencepiece.viterbi_fold(F.col("edges"), F.length("word")).alias("bits")).collect():
        cut = [i for i in range(len(r.word) + 1) if r.bits >> i & 1]
        parts = [r.word[a:b] for a, b in zip(cut, cut[1:])]
        assert "".join(parts) == r.word and sum(pieces[p] for p in parts) == pytest.approx(best(r.word)[0])


# -- quality ------------------------------------------------------------------------------------------------------


def test_quality_ranks_held_out_grades(spark, awkward, nothing):
    rnd = random.Random(6)
    words = {0: "bad worse awful".split(), 1: "meh plain dull".split(), 2: "good fine great".split()}
    text = lambda g: " ".join(rnd.choice(words[g] if rnd.random() < 0.3 else ["the", "a", "of", "it"]) for _ in range(60))
    rows = [(i, text(i % 3), i % 3) for i in range(600)]
    rated = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.fit(rated.filter("doc_id < 480"), 3)
    assert model.thresholds[0] <= model.thresholds[1]
    got = {r.doc_id: r for r in quality.rate(rated.filter("doc_id >= 480"), model, 2).collect()}
    mean = [np.mean([got[i].expected_grade for i, _, g in rows[480:] if g == k]) for k in range(3)]
    assert mean[0] + 0.5 < mean[1] < mean[2] - 0.5
    assert np.mean([got[i].selected == (g == 2) for i, _, g in rows[480:]]) > 0.95
    flat = quality.fit(nothing.withColumn("grade", F.lit(None).cast("int")), 3)
    found = quality.rate(awkward, flat, 2).collect()
    assert len(found) == awkward.count() and all(r.tail_probability == pytest.approx(1 / 3, abs=1e-6) for r in found)
    assert quality.rate(nothing, flat, 2).collect() == []


# -- near copies and the pipeline ---------------------------------------------------------------------------------


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def test_near_copies_against_brute_force(spark, awkward, nothing):
    rnd = random.Random(8)
    rows = []
    for group in range(12):
        base = [f"w{rnd.randrange(4000)}" for _ in range(200)]
        for copy in range(4):
            own = list(base)
            for _ in range(copy * 2):
                own[rnd.randrange(200)] = f"w{rnd.randrange(4000)}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = {r.doc_id: r.group_id for r in near_copies.near_copy_groups(docs).collect()}
    s = {i: shingles(t) for i, t in rows}
    for i, _ in rows:
        for j in range(i):
            like = len(s[i] & s[j]) / len(s[i] | s[j])
            same = label.get(i, i) == label.get(j, j)
            assert same or like < 0.84
            assert not same or i // 4 == j // 4
    assert near_copies.near_copy_groups(nothing).collect() == []
    kept = near_copies.keep_one(awkward)
    # rows without an id lose to all others, and both of them here have a copy with one
    assert kept.columns == awkward.columns and kept.filter("doc_id IS NULL").count() == 0


def test_keep_one_of_repeated_rows_and_clashing_names(spark):
    words = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, words("a")), (1, words("a")), (1, words("b")), (2, words("b") + " more"), (None, words("a") + " end"), (None, words("c")), (None, words("c")), (3, words("d")), (4, "")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, row int, key int, alone int, digest int, score int")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, words("a")), (1, words("b")), (None, words("c")), (3, words("d")), (4, "")], key=str)


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        assert docs.columns == names
    rows = {r.doc_id: r for r in docs.collect()}
    assert set(rows) <= set(before) and len({(r.text or "").strip() for r in rows.values()}) == len(rows)
    shared = [shingles(r.text) for r in rows.values()]
    assert all(5 * len(a & b) < 4 * len(a | b) for i, a in enumerate(shared) for b in shared[:i] if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)))
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == set(rows)
