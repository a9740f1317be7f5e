import random

import pytest

from tessera.llm.suffix_sort import suffix_order


@pytest.mark.parametrize("seed", range(60))
def test_against_sorting(seed):
    rng = random.Random(seed)
    text = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randrange(0, 80))]
    assert suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_repetitive_texts():
    for text in ([1] * 50, [1, 2] * 40, [2, 1] * 40, [1, 1, 2, 1, 1, 2, 1, 3] * 10, list(range(30, 0, -1))):
        assert suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])
