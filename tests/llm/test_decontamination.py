import random
import re

import pytest

from meshwork.llm import decontamination

SCHEMA = "doc_id long, text string, row string, words int, window string, token long, at int, items string"
ITEMS = "item_id long, text string, words int, window string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, size=10):
    of = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            of.setdefault(tuple(w[i : i + size]), set()).add(item)
    lengths, out = {len(w) for w in of}, []
    for doc, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (t := tuple(w[i : i + m])) in of:
                    hit |= set(range(i, i + m))
                    ids |= of[t]
        out.append((doc, len(w), len(hit), tuple(sorted(str(i) for i in ids if i is not None)), bool(hit)))
    return sorted(out, key=str)


def made(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "r", 1, "w", 2, 3, "i") for i, t in docs], SCHEMA).repartition(4)
    b = spark.createDataFrame([(i, t, 1, "w") for i, t in items], ITEMS)
    return sorted(((r.row.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontamination.contamination(d, b, **more).collect()), key=str)


def corpus(seed=1):
    rnd = random.Random(seed)
    w = lambda n, of: [rnd.choice(of) for _ in range(n)]
    many, few = [f"w{i}" for i in range(300)] + ["É", "日本語", "𐍈x"], ["a", "b"]
    items = [(i, " ".join(w(rnd.randint(10, 40), many))) for i in range(25)]
    items += [(40, " ".join(w(30, few))), (41, "one"), (42, "two words"), (43, "Three, short WORDS"), (44, " ".join(w(7, many))), (45, None), (46, " ,.; "), (None, " ".join(w(20, many))), (3, " ".join(w(12, many))), (47, items[0][1]), items[5]]
    docs = []
    for i in range(60):
        body = w(rnd.randint(0, 80), many)
        for _ in range(rnd.randint(0, 3)):
            own = words(rnd.choice(items)[1])
            a = rnd.randint(0, max(0, len(own) - 3))
            at = rnd.randint(0, len(body))
            body[at:at] = own[a : a + rnd.choice([5, 9, 10, 11, 40])]
        docs.append((i, rnd.choice([" ", ", ", " \n"]).join(x.upper() if rnd.random() < 0.1 and x.isascii() else x for x in body)))
    docs += [(None, items[0][1]), (None, items[0][1]), (70, None), (71, ""), (72, "!?"), (73, "one"), (74, "x" * 9000), (75, " ".join(w(3000, few))), (76, " ".join([items[2][1]] * 300)), docs[4], (2, items[1][1])]
    return docs, items


@pytest.mark.parametrize("most", [(2_000_000, 250_000), (0, 0)])
def test_against_brute_force(spark, most):
    docs, items = corpus()
    assert made(spark, docs, items, most_shingles=most[0], most_tokens=most[1]) == expected(docs, items)


@pytest.mark.parametrize("size,shingle", [(4, 2), (3, 3), (6, 1)])
def test_other_sizes(spark, size, shingle):
    docs, items = corpus(2)
    assert made(spark, docs, items, size=size, shingle=shingle) == expected(docs, items, size)


def test_hot_copies_and_a_passage_of_all(spark):
    docs, items = corpus(3)
    docs = [(i, docs[3][1]) for i in range(800)] + [(1000 + i, f"z{i} " + items[7][1]) for i in range(800)]
    assert made(spark, docs, items) == expected(docs, items)


def test_nothing(spark):
    docs, items = corpus()
    assert made(spark, [], items) == []
    assert made(spark, docs, []) == expected(docs, []) == made(spark, docs, [(1, None), (2, "--")])


def test_no_python_on_the_path(spark):
    plan = decontamination.op12_benchmark_decontamination(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
