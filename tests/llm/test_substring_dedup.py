import hashlib

from meshwork.llm import substring_dedup


def brute(rows, size=20):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None and r[1] or "", r[1] is None))
    seen, out = set(), []
    for doc_id, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone[i : i + size] = [True] * size
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_rows_as_brute_force(documents, awkward, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(substring_dedup, "RANGE_WINDOWS", 5_000)
    for docs in (documents, awkward):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        found = [tuple(r) for r in substring_dedup.remove_repeats(docs).collect()]
        assert sorted(found, key=str) == sorted(brute(rows), key=str)
        assert any(r[2] for r in found)


def test_empty(nothing):
    assert substring_dedup.remove_repeats(nothing).collect() == []


def test_texts_keep_columns(awkward):
    out = substring_dedup.remove_repeats(awkward, texts=True)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    digests = {(r.doc_id, r.kept_sha256) for r in substring_dedup.remove_repeats(awkward).collect()}
    assert {(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in out.collect()} == digests
