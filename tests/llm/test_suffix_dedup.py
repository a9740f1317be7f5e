import hashlib
import random

import pytest

from tessera.llm import suffix_dedup
from tessera.llm.suffix_dedup import LENGTH, remove_repeats

SCHEMA = "doc_id long, text string, body string, key int, n int"


def expected(rows):
    """Every window of every document in order, kept in a dictionary."""
    texts = {(-(2**63) if i is None else i, t or "") for i, t in rows}
    ordered = sorted(texts, key=lambda r: r[0])
    seen, out = {}, {}
    for i, t in ordered:
        b = t.encode()
        cover = [False] * len(b)
        for s in range(len(b) - LENGTH + 1):
            w = b[s : s + LENGTH]
            if w in seen:
                cover[s : s + LENGTH] = [True] * LENGTH
            else:
                seen[w] = s
        rest = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(c and not p for c, p in zip(cover, [False, *cover]))
        out[i, t] = (len(b), sum(cover), spans, hashlib.sha256(rest).hexdigest())
    return sorted(((i, *out[-(2**63) if i is None else i, t or ""]) for i, t in rows), key=str)


def made(rng):
    words = ["the", "of", "and", "stone", "river", "é", "über", "light", "x", "quiet"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [line(40) for _ in range(4)]
    rows = []
    for i in range(80):
        parts = [line(rng.randrange(1, 60))] + [rng.choice(passages) for _ in range(rng.randrange(3))] + [line(rng.randrange(1, 30))]
        text = "\n".join(parts)
        if i % 9 == 0 and rows:
            text = rng.choice(rows)[1] or ""
            cut = rng.randrange(len(text) + 1)
            text = text[:cut] + "!" + text[cut:]
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "a" * 350), (103, "ab" * 200), (104, "z" * 99), (105, "z" * 100), (106, "z" * 101), (None, passages[0]), (3, rows[3][1]), (107, "\0" * 150 + line(30) + "\0" * 150), (108, passages[1] * 30)]
    return rows


@pytest.mark.parametrize("most", [2048, 3])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    rows = made(random.Random(6))
    df = spark.createDataFrame([(*r, "b", 1, 2) for r in rows], SCHEMA).repartition(5)
    got = remove_repeats(df).drop("kept_bytes").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_text_of_several_pieces(spark):
    rng = random.Random(8)
    words = [f"w{n}" for n in range(5000)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = line(60)
    text = line(195_000)[: (1 << 20) - 150]
    rows = [(1, passage), (2, text + passage + line(9000) + passage + text[500:900])]
    got = remove_repeats(spark.createDataFrame([(*r, "b", 1, 2) for r in rows], SCHEMA)).drop("kept_bytes").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
