"""The mixer predicts running text: contexts cross words, every occurrence counts, and weights move along a text."""

import zlib

import numpy as np
import pytest

from meshwork.llm import lm_score


def fitted(texts):
    keys, times = lm_score._merged(*zip(*[(k, np.bincount(at)) for k, at in [lm_score._counted(lm_score._spelling(texts)[0])]]))
    counts = np.zeros((len(lm_score.ORDERS), 2, lm_score.CELLS), dtype=np.int32)
    lm_score._add_keys(counts, keys, times)
    m = lm_score.Mixer(counts)
    m.learn(keys, times)
    return m.fitted()


def test_the_order_of_words_counts(spark):
    """Two held-out texts of the same words: the one whose order training has is likelier."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, "red fox by day " * 20) for i in range(200) if i not in held] + [(held[0], "red fox by day red fox by day"), (held[1], "day day by by fox fox red red")]
    got = {r.doc_id: r for r in lm_score.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = got[held[0]], got[held[1]]
    assert a.held_out and b.held_out and a.base_score == pytest.approx(b.base_score) and a.n_bytes == b.n_bytes
    assert a.score > b.score + 3


def test_keys_have_five_bytes_the_word_and_every_byte():
    texts = [b"ab abc", b"", b"x " + b"long" * 5, b"y " + b"long" * 5]
    keys, lengths = lm_score._spelling(texts)
    data = [t + b" \n" if t else b"\n" for t in texts]
    assert lengths.tolist() == [len(t) for t in data]
    at = 0
    for t in data:
        padded = b"\0\0\0\0 " + t
        for i in range(len(t)):
            assert int(keys[at + i]) & ((1 << 48) - 1) == int.from_bytes(padded[i : i + 6], "big")
        at += len(t)
    words = lm_score._cells(keys, 0)[0][-1]  # the cell of the first bit follows from the word so far, wherever that stands
    assert (words[:3] == words[3:6]).all() and len(set(words[:3].tolist())) == 3
    x, y = (int(lengths[:i].sum()) for i in (2, 3))
    assert (words[x + 2 : x + 22] == words[y + 2 : y + 22]).all()


def test_what_a_chunk_holds_is_bounded(monkeypatch):
    """A key's arrays take some 80 bytes for each byte of a chunk, so blocks are read chunk by chunk and merged on the way."""
    import tracemalloc

    text = b" ".join(b"%d" % (i * 7919) for i in range(lm_score.CHUNK_BYTES // 8))
    tracemalloc.start()
    lm_score._spelling([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 * lm_score.CHUNK_BYTES <= 200 << 20


def test_occurrences_count():
    once, often = (fitted([b"ab"] * n + [b"ac"] * 10) for n in (1, 50))
    assert often.log10_of([b"ab"])[0] > once.log10_of([b"ab"])[0] + 0.2


def test_a_text_s_score_is_its_own_and_its_weights_move(monkeypatch):
    rnd = np.random.default_rng(0)
    texts = [b" ".join(rnd.choice([b"the", b"then", b"other", b"a", b"thorn"], n).tolist()) for n in (3, 400, 40, 0)]
    m = fitted(texts[1:3] * 3)
    together = m.log10_of(texts)
    assert together == pytest.approx([m.log10_of([t])[0] for t in texts], rel=1e-5) and (together < 0).all()
    monkeypatch.setattr(lm_score, "OWN_RATE", 0.0)
    fixed = m.log10_of(texts)
    assert fixed[0] == pytest.approx(together[0]) and abs(fixed[1] - together[1]) > 1e-3
