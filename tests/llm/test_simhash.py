import random

import xxhash

from meshwork.llm import simhash
from meshwork.llm.components import components


def brute(rows, size=3):
    prints = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        runs = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        prints.append((doc_id, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    return prints


def groups(values):
    at = {v: v for v in values}

    def root(v):
        while at[v] != v:
            v = at[v]
        return v

    values = sorted(at)
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= 2:
                at[root(a)] = root(b)
    return {v: root(v) for v in values}


def expected(rows):
    prints = brute(rows)
    of = groups({f for _, f in prints})
    low = {}
    for d, f in prints:
        if d is not None:
            low[of[f]] = min(d, low.get(of[f], d))
    return sorted(((d, f"{f:016x}", low.get(of[f])) for d, f in prints), key=str)


def test_rows_as_brute_force(documents, awkward):
    for docs in (documents, awkward):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert sorted((tuple(r) for r in simhash.near_groups(docs).collect()), key=str) == expected(rows)


def test_empty(nothing):
    assert simhash.near_groups(nothing).collect() == []


def test_links_of_clusters_both_ways(spark):
    rnd = random.Random(2)
    values = set()
    for _ in range(6):
        c = rnd.getrandbits(64)
        for _ in range(60):
            c ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.3:
                c ^= 1 << rnd.randrange(64)
            values.add(c)
    values |= {rnd.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = groups(values)
    for most in (0, 5, 64):
        found = components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), most)).collect()
        label = {r.node % (1 << 64): r.component for r in found}
        parts = {}
        for v in values:
            parts.setdefault(want[v], set()).add(label.get(v, v))
        assert all(len(p) == 1 for p in parts.values()) and len({next(iter(p)) for p in parts.values()}) == len(parts)


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("(id * 7) % 307 a", "((id + 1) * 7) % 307 b")
    found = components(edges).collect()
    assert len(found) == 301 and {r.component for r in found} == {0}
