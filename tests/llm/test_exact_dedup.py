import uuid

from meshwork.llm import exact_dedup


def test_keep_first_with_repeated_and_null_keys(spark):
    rows = [(1, "a  b"), (1, "a b"), (1, "c"), (2, "c"), (None, "a b"), (None, "d"), (None, "d"), (None, "e"), (3, "e"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, " ".join((r.text or "").split())) for r in exact_dedup.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b"), (1, "c"), (None, "d"), (3, "e"), (4, "")], key=str)


def test_many_equal_texts_and_null_keys(spark):
    n = 100_000
    docs = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN id + 5 END AS doc_id", "CASE WHEN id % 10 = 0 THEN concat('t', id % 7) END AS text")
    got = exact_dedup.exact_dedup(docs)
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "Bucketed: true" not in plan
    rows = got.collect()
    assert len(rows) == n
    groups = {}
    for i in range(n):
        groups.setdefault(f"t{i % 7}" if i % 10 == 0 else "", []).append(i + 5 if i % 3 == 0 else None)
    want = sorted((len(g), min(k for k in g if k is not None)) for g in groups.values())
    assert sorted({(r.group_size, r.keep_id) for r in rows}) == want
    assert sorted((r.group_size, r.doc_id) for r in rows if r.kept) == want


def test_later_batches_meet_the_index(spark):
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    answer = lambda df: sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)
    one = batch((1, "a"), (2, "a"), (None, "b"), (None, "b"))
    first = answer(index.dedup(one, batch="one"))
    assert first == sorted([(1, 1, 2, True), (2, 1, 2, False), (None, None, 2, True), (None, None, 2, False)], key=str)
    assert answer(index.dedup(batch((0, "a"), (7, "c"), (8, " c")), batch="two")) == [(0, 1, 2, False), (7, 7, 1, True), (8, 8, 1, True)]
    assert answer(index.dedup(one, batch="one")) == first
    assert index.entries().count() == 4
