import random

import numpy as np

from meshwork.llm import near_copies


def shingles(text, size=5):
    w = text.lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def groups(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    label = {r.doc_id: r.group_id for r in near_copies.near_copy_groups(docs).collect()}
    return [label.get(i, i) for i, _ in rows]


def test_pairs_at_the_threshold(spark):
    """Of each pair one is the other's beginning: k of m shingles are shared."""
    rows, like = [], []
    for turn, (k, m) in enumerate([(4, 5), (5, 6), (6, 7), (3, 4), (8, 10), (7, 9), (40, 50), (39, 50), (400, 500), (399, 500), (2400, 3000), (2399, 3000)]):
        words = [f"t{turn}w{i}" for i in range(m + 4)]
        rows += [(len(rows), " ".join(words[: k + 4])), (len(rows) + 1, " ".join(words))]
        like.append(5 * k >= 4 * m)
    label = groups(spark, rows)
    assert [label[2 * i] == label[2 * i + 1] for i in range(len(like))] == like
    assert len(set(label)) == len(rows) - sum(like)


def test_pairs_in_a_bucket_of_thousands_against_brute_force(spark):
    """All share a template and are some 0.5 to 0.8 alike; each pair shares its own edits of it, and one has some more."""
    rnd = random.Random(3)
    template = [f"w{i}" for i in range(200)]
    rows = []
    for pair in range(1000):
        base = list(template)
        for at in rnd.sample(range(10), rnd.randrange(3, 9)):
            base[20 * at + rnd.randrange(20)] = f"p{pair}e{at}"
        other = list(base)
        for at in rnd.sample(range(200), rnd.randrange(1, 7)):
            other[at] = f"q{pair}e{at}"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    s = [shingles(t) for _, t in rows]
    place = {x: i for i, x in enumerate(sorted(shingles(" ".join(template))))}
    has = np.zeros((len(s), len(place)), dtype=np.float32)
    for i, x in enumerate(s):
        has[i, [place[y] for y in x if y in place]] = 1
    both = (has @ has.T).astype(int)
    for i in range(0, len(s), 2):  # only the two of a pair share any other
        both[i + 1, i] = len(s[i] & s[i + 1])
    n = np.array([len(x) for x in s])
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in np.argwhere(np.tril(5 * both >= 4 * (n[:, None] + n[None, :] - both), -1)).tolist():
        a, b = sorted((top(i), top(j)))
        parent[b] = a
    expected = [top(i) for i in range(len(rows))]
    assert len(set(expected)) > 500
    assert groups(spark, rows) == expected
