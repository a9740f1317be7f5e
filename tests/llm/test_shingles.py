import numpy as np
import pytest

from tessera.llm import shingles


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_slices_give_the_hashes_of_the_whole(monkeypatch, size):
    rng = np.random.default_rng(size)
    for n in (0, 1, 5, 40, 300):
        text = bytes(rng.choice(list(b"ab C\n\xc3"), n).astype(np.uint8))
        whole, _ = shingles.word_hashes([text])
        (sets,) = shingles.shingle_sets([text], 3)
        with monkeypatch.context() as m:
            m.setattr(shingles, "SLICE", size)
            sliced = [*shingles.long_word_hashes(text)]
            assert np.array_equal(np.concatenate(sliced) if sliced else whole[:0], whole)
            assert np.array_equal(next(shingles.shingle_sets([text], 3)), sets)


def test_chunks_hold_every_text_once():
    texts = [b"x" * n for n in (0, 3, 9, 1, 1, 20, 0)]
    chunks = list(shingles.in_chunks(texts, 10))
    assert [t for _, c in chunks for t in c] == texts
    assert all(texts[at : at + len(c)] == c and (len(c) == 1 or sum(map(len, c)) <= 10) for at, c in chunks)
