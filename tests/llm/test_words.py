import numpy as np
import pyarrow as pa

from lodestone.llm import words as W

from .conftest import words_of

TEXTS = ["A b\tc\x0bd", "", None, "é x  y", " lead", "trail ", "\n\n", "A b"]


def test_words_are_split_as_defined_and_equal_words_have_equal_hashes():
    hashes, starts, ends, at = W.words(pa.array(TEXTS))
    counts = np.diff(at).tolist()
    assert counts == [len(words_of(t)) for t in TEXTS]
    flat = [w for t in TEXTS for w in words_of(t)]
    by_word = {}
    for word, value in zip(flat, hashes.tolist()):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)


def test_pieces_of_long_texts_do_not_change_hashes(monkeypatch):
    text = pa.array(["word%d x " % (i % 7) * 3 for i in range(50)] + ["y" * 500])
    whole = W.words(text)[0]
    monkeypatch.setattr(W, "PIECE", 64)
    assert (W.words(text)[0] == whole).all()


def test_sliced_arrays_and_slices_cover_all_rows():
    array = pa.array(["a b", "c", None, "d e f"] * 5).slice(3, 11)
    assert sum(len(part) for _, part in W.slices(array, 4)) == 11
    assert len(W.words(array)[0]) == sum(len(words_of(x)) for x in array.to_pylist())


def test_shingles():
    hashes = W.words(pa.array(["a b a b a b c"]))[0]
    assert len(W.shingles(hashes, 2)) == 3 and len(W.shingles(hashes[:1], 5)) == 1 and not len(W.shingles(hashes[:0], 5))


def test_character_inputs_have_one_group_a_word():
    texts = pa.array(["abcdef ab a"])
    hashes, starts, ends, _ = W.words(texts)
    parts, at = W.pieces(W.raw(texts)[0], starts, ends)
    assert np.diff(at).tolist() == [5 + 3, 1, 0] and len(parts) == 9
