import numpy as np
import pyarrow as pa

from meshwork.llm import common, sentencepiece


def test_numbering_by_slices_gives_every_text_its_words():
    texts = ["a b a", "", None, " a  b", "c ▁d a", "x" * 3000, "b c　e"] * 400
    counts, ids, words = sentencepiece._numbered(pa.chunked_array([texts[:1000], texts[1000:]]))
    ends = np.cumsum(counts)
    for text, z, n in zip(texts, ends.tolist(), counts.tolist()):
        assert [words[i] for i in ids[z - n : z]] == sentencepiece.words_of(text)
    assert len(set(words)) == len(words)
    assert [len(x) for x in sentencepiece._numbered(pa.chunked_array([], pa.string()))] == [0, 0, 0]


def test_a_slice_bounds_what_is_split_at_once(monkeypatch):
    seen = []
    one = sentencepiece._numbered_slice
    monkeypatch.setattr(sentencepiece, "_numbered_slice", lambda t: seen.append(t.nbytes) or one(t))
    sentencepiece._numbered(pa.chunked_array([[" ".join(f"w{i}" for i in range(2000))] * 800]))
    assert len(seen) > 2 and max(seen) < 2 * sentencepiece.SLICE_BYTES


def test_words_keep_their_atoms_when_these_are_dealt():
    """Numbers point into the ranges' lists one after the other; no word keeps a tuple of its own on the way."""
    import public_tokenizers

    pieces = sentencepiece.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["▁the", "▁end.", "▁日本x", "▁", "▁a-b,c", "▁the,"]
    many, used, atoms = sentencepiece._atoms(words, pieces)
    lists, number = sentencepiece._dealt(atoms, 5)
    every = [x for _, data in lists for x in sentencepiece._unpack_words(data)]
    ends = np.cumsum(many)
    for w, z, n in zip(words, ends.tolist(), many):
        assert tuple(every[number[i]] for i in used[z - n : z]) == sentencepiece.atoms_of(w, pieces)
    assert sorted(every) == sorted(set(every)) and [r for r, _ in lists] == sorted({r for r, _ in lists})
    assert sentencepiece._dealt([], 3)[0] == []


def test_batches_are_small_inside_and_as_before_after(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with common.batches_of(spark, 7):
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
        assert max(r.n for r in spark.range(100).mapInArrow(sizes, "n long").collect()) <= 7
    assert spark.conf.get(name) == before
