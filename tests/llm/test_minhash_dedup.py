import random
import re

import pytest

from tessera.llm.minhash_dedup import near_duplicates

SCHEMA = "doc_id long, text string, node long, label string, first int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Components of rows: two rows with one identifier are linked only by their own texts."""
    sets = [(i, shingles(t)) for i, t in rows]
    linked = {n: {n} for n, (i, _) in enumerate(sets) if i is not None}
    known = [n for n in linked if sets[n][1]]
    for at, n in enumerate(known):
        for m in known[:at]:
            s, t = sets[n][1], sets[m][1]
            if 100 * len(s & t) >= 75 * len(s | t):
                linked[n].add(m)
                linked[m].add(n)
    label = {}
    for n in linked:
        seen, todo = {n}, [n]
        while todo:
            for m in linked[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        label[n] = min(sets[m][0] for m in seen)
    return sorted(((i, len(s), label.get(n), i is None or label[n] == i) for n, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]

    def edited(base, times):
        out = list(base)
        for _ in range(times):
            out[rng.randrange(len(out))] = rng.choice(words)
        return out

    base, common = text(120), text(50)
    rows = [(i, " ".join(edited(base, rng.randrange(0, 9)))) for i in range(120)]  # a family around the threshold
    rows += [(200 + i, " ".join(common + text(rng.randrange(5, 60)))) for i in range(80)]
    rows += [(300 + i, " ".join(text(rng.randrange(1, 200)))) for i in range(60)]
    rows += [(400 + i, rows[3][1].upper()) for i in range(30)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one two"), (504, "ONE\ttwo"), (505, "one two three"), (None, rows[3][1]), (506, "é É"), (507, "é é"), (508, "w1 " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "l", 2) for r in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = near_duplicates(spark.createDataFrame([(*r, 1, "l", 2) for r in rows], SCHEMA)).collect()
    assert [(r.component_id, r.kept) for r in sorted(got)] == [(1, True), (1, True), (1, False)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_two_texts_of_one_identifier_are_two_nodes(spark):
    words = [f"w{n}" for n in range(80)]
    x, y = " ".join(words[:40]), " ".join(words[40:])
    rows = [(1, x + " more"), (5, x), (5, y), (7, y + " more"), (8, "alone " * 3), (8, y)]
    got = near_duplicates(spark.createDataFrame([(*r, 1, "l", 2) for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert [(r.doc_id, r.component_id) for r in sorted(got)] == [(1, 1), (5, 1), (5, 5), (7, 5), (8, 8), (8, 5)]


@pytest.mark.parametrize("most", [16, 40])
def test_recall_in_a_large_group_around_the_threshold(spark, most):
    """Copies of one text with up to ``most`` changed words: similarities from 0.3 to 1, most of them near 0.75 from either side."""
    rng = random.Random(most)
    words = [f"w{n}" for n in range(3000)]
    base = [rng.choice(words) for _ in range(300)]
    rows = []
    for n in range(400):
        out = list(base)
        for _ in range(rng.randrange(most)):
            at = rng.randrange(len(out) - 3)
            out[at : at + rng.randrange(3)] = rng.choices(words, k=rng.randrange(3))
        rows.append((n, " ".join(out)))
    got = near_duplicates(spark.createDataFrame([(*r, 1, "l", 2) for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_a_template_with_other_fillings_makes_no_pairs(spark, monkeypatch):
    """Texts under the threshold that share all but their fillings: no candidate is compared pair by pair."""
    from tessera.llm import minhash_dedup, prefix_join

    rng = random.Random(6)
    words = [f"w{n}" for n in range(100_000)]
    base = [rng.choice(words) for _ in range(300)]
    rows = []
    for n in range(300):
        out = list(base)
        for at in range(15, 300, 30):
            out[at] = rng.choice(words)
        rows.append((n, " ".join(out)))
    compared = []
    counted = prefix_join.overlaps
    for module in (minhash_dedup, prefix_join):
        monkeypatch.setattr(module, "overlaps", lambda pairs, sets: (compared.append(pairs.count()), counted(pairs, sets))[1])
    got = near_duplicates(spark.createDataFrame([(*r, 1, "l", 2) for r in rows], SCHEMA)).collect()
    assert all(r.component_id == r.doc_id for r in got)
    assert compared and compared[-1] == 0 and max(compared) < 20 * len(rows)
