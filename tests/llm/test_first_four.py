import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshwork.llm import exact_dedup, language_id, packing, url_filter

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_exact_dedup_as_sql(spark, documents):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(exact_dedup.OP8_SQL).fetchall()
    assert sorted(map(tuple, exact_dedup.op8_exact_dedup(spark, "/root/testdata/sf0.001").collect())) == sorted(want)


def test_exact_dedup_of_awkward_rows(awkward, nothing):
    rows = exact_dedup.exact_dedup(awkward).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in awkward.collect():
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    assert len(rows) == awkward.count() and sum(r.kept for r in rows) == len(groups)
    assert sorted(r.group_size for r in rows) == sorted(len(g) for g in groups.values() for _ in g)
    assert {r.keep_id for r in rows} == {min((i for i in g if i is not None), default=None) for g in groups.values()}
    assert exact_dedup.exact_dedup(nothing).collect() == []
    assert exact_dedup.keep_first(awkward).columns == awkward.columns


def test_digest_index_persists(spark, awkward):
    index = exact_dedup.DigestIndex(spark, "digests_of_test", 4)
    first = index.dedup(awkward.filter("doc_id > 20"))
    kept = {r.text_sha256: r.keep_id for r in first.filter("kept").collect()}
    second = index.dedup(awkward).collect()
    assert all(not r.kept and r.keep_id == kept[r.text_sha256] for r in second if r.text_sha256 in kept)
    digests = [r.digest for r in index.entries().collect()]
    assert len(digests) == len(set(digests)) == len({r.text_sha256 for r in second})


def test_a_batch_given_again_gets_the_same_answer(spark):
    index = exact_dedup.DigestIndex(spark, "digests_given_again")
    one = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    first = sorted(map(tuple, index.dedup(one, batch="one").collect()))
    assert sorted(map(tuple, index.dedup(one, batch="one").collect())) == first and sum(r[3] for r in first) == 2
    two = spark.createDataFrame([(4, "b"), (5, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in index.dedup(two, batch="two").collect()) == [(4, 3, False), (5, 5, True)]
    assert sorted(map(tuple, index.compact("digests_compacted").entries().collect())) == sorted(map(tuple, index.entries().collect()))


def test_language_as_brute_force(spark, documents):
    """Counts, priors and posteriors of every text by plain loops over its n-grams."""
    rows = [(r.doc_id, r.text, r.lang) for r in documents.limit(60).collect()]
    docs = spark.createDataFrame([*rows, (900, "½ ² ③", "en"), (901, "Ⅷ", "en"), (902, None, "en"), (903, "1 2", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    known = [(t, lang) for _, t, lang in rows if t is not None and lang is not None] + [("½ ² ③", "en"), ("Ⅷ", "en")]
    counts = {lang: np.zeros(language_id.CELLS) for lang in model.langs}
    cells = lambda t: [int(x) for part in language_id._cells(language_id._points(t)) for x in part]
    for t, lang in known:
        for x in cells(t):
            counts[lang][x] += 1
    prior = {lang: sum(k == lang for _, k in known) / len(known) for lang in counts}
    for r in language_id.predict(docs.select("doc_id", "text"), model).collect():
        text = docs.filter(docs.doc_id == r.doc_id).first().text if r.doc_id >= 900 else dict((i, t) for i, t, _ in rows)[r.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        s = {lang: np.log(prior[lang]) + sum(np.log((n[x] + 0.5) / (n.sum() + 0.5 * len(n))) for x in cells(text)) for lang, n in counts.items()}
        best = max(s, key=s.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(np.exp(v - s[best]) for v in s.values()), abs=1e-3)


def test_packing_round_trip(awkward, nothing, documents):
    tokenizer = Tokenizer.from_file(PATH)
    assert packing.pack(nothing, PATH).collect() == []
    for docs in (documents, awkward):
        ids = {}
        for r in docs.collect():
            ids.setdefault(r.doc_id, []).append(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes())
        rows = packing.pack(docs, PATH, 100).collect()
        whole = sorted((d, len(x) // 4, s, zlib.crc32(x[4 * s : 4 * s + 8192])) for d, each in ids.items() if d is not None for x in each for s in range(0, len(x) // 4, 2048))
        assert whole == sorted((r.doc_id, r.doc_tokens, r.start, r.ids_crc32) for r in rows if r.doc_id is not None)
        at = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == at.get(r.sequence_id, 0)
            at[r.sequence_id] = r.offset + r.length
        assert max(at.values()) <= 2048


def test_first_fit_decreasing_as_scan():
    sizes = np.random.default_rng(1).integers(1, 2049, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 2048)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        room += [2048] * (b == len(room))
        assert (bins[i], offsets[i]) == (b, 2048 - room[b])
        room[b] -= sizes[i]


def test_language_held_out_accuracy(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in language_id.identify(docs).collect()}
    own = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in own if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == own[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows.values())
    found = language_id.identify(awkward).collect()
    assert len(found) == awkward.count() and all(r.lang_pred in ("en", "de", "und") for r in found)
    assert language_id.identify(nothing).collect() == []
    assert language_id.predict(awkward, language_id.fit(nothing)).filter("lang_pred <> 'und'").count() == 0
    assert language_id.keep_identified(awkward).columns == awkward.columns


URLS = [None, "", "no scheme/x", "HTTP://A.Example.NET/en/x?q#f", "http://example.net/de", "http://net", "http://net?x=/", "ftp://x.fr.org/fr/", "http://org/fr/a", "http://notexample.com/de/", "http://m.example.com/de/1#t", "a://b://c/d", "x://h#/p", "x:///p"]


@pytest.mark.parametrize("url", URLS)
def test_url_parts_and_rules(spark, url):
    host = path = ""
    if url and "://" in url:
        rest = url.partition("://")[2]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.lower()
    fits = [(len(t), t, v) for v, t in url_filter.RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    r = url_filter.filter_urls(df, spark.createDataFrame([], "page_id long, bad int")).first()
    assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
    assert r.verdict == (max(fits)[2] if fits else "allow")


def test_bad_hosts_are_blocked(spark):
    rows = [(i, f"http://h{i % 4}.d{i % 2}.info/a") for i in range(400)] + [(None, "http://h0.d0.info/b"), (7, "http://h0.d0.info/b")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(0, 300)] + [(None, 1), (3, None)], "page_id long, bad int")
    got = url_filter.filter_urls(pages, outcomes).collect()
    assert len(got) == len(rows)
    assert {r.host for r in got if r.verdict == "block"} == {"h1.d1.info"}
