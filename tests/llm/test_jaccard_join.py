import random
import re

import pytest

from tessera.llm import prefix_join
from tessera.llm.jaccard_join import _prefix_sizes, jaccard_classes
from tessera.llm.prefix_join import least_overlap, links_across, prefix_keys, with_hubs

SCHEMA = "doc_id long, text string, node long, label string, token int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    known = [n for n, (i, s) in enumerate(sets) if i is not None and s]
    linked = {n: {n} for n, (i, _) in enumerate(sets) if i is not None}
    for at, n in enumerate(known):
        for m in known[:at]:
            s, t = sets[n][1], sets[m][1]
            if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
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
    return sorted(((i, len(s), label.get(n)) for n, (i, s) in enumerate(sets)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "l", 2) for r in rows], SCHEMA)


def told(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, df.collect()), key=str)


def edited(rng, base, words, times):
    out = list(base)
    for _ in range(times):
        at = rng.randrange(len(out) - 3)
        out[at : at + rng.randrange(3)] = rng.choices(words, k=rng.randrange(3))
    return out


@pytest.mark.parametrize("seed, percent", [(1, 80), (2, 80), (3, 55)])
def test_against_brute_force(spark, seed, percent):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    base, common = text(120), text(50)
    rows = [(i, " ".join(edited(rng, base, words, rng.randrange(0, 9)))) for i in range(120)]  # a family around the threshold
    rows += [(200 + i, " ".join(common + text(rng.randrange(5, 60)))) for i in range(80)]
    rows += [(300 + i, " ".join(text(rng.randrange(1, 200)))) for i in range(60)]
    rows += [(400 + i, rows[3][1].upper()) for i in range(30)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one two"), (504, "ONE\ttwo"), (505, "one two three"), (None, rows[3][1]), (506, "é É"), (507, "é é"), (508, "w1 " * 30_000)]
    rows += [(600, " ".join(map(str, range(60_000)))), (601, " ".join(map(str, range(5_000, 60_000)))), (7, rows[9][1]), (7, rows[9][1]), (7, " ".join(text(40)))]
    assert told(jaccard_classes(frame(spark, rows).repartition(4), percent=percent)) == brute(rows, percent)


def test_families_that_chain(spark):
    """Versions of a text, each a few words from the one before, and near them a family without links."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    at = [rng.choice(words) for _ in range(200)]
    rows = []
    for n in range(150):
        at = edited(rng, at, words, 3)
        rows.append((1000 - n, " ".join(at)))
    rows += [(2000 + n, " ".join(edited(rng, at, words, 25))) for n in range(150)]
    assert told(jaccard_classes(frame(spark, rows).repartition(3))) == brute(rows)


def test_a_template_with_other_fillings_meets_under_no_key(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(100_000)]
    base = [rng.choice(words) for _ in range(300)]

    def filled():
        out = list(base)
        for at in range(15, 300, 30):
            out[at] = rng.choice(words)
        return " ".join(out)

    rows = [(n, filled()) for n in range(300)]
    assert told(jaccard_classes(frame(spark, rows))) == [(n, len(shingles(t)), n) for n, t in sorted(rows, key=str)]
    import numpy as np

    sets = spark.createDataFrame([(n, np.array(sorted(hash(s) % 2**63 for s in shingles(t)), np.uint64).tobytes()) for n, t in rows], "node long, shingles binary")
    assert prefix_keys(sets, 80).count() < len(rows)  # of some 40 common members that a prefix of one size for all would have


def test_prefixes_hold_what_links_share():
    for percent in (55, 75, 80, 100):
        for n in range(1, 120):
            for m in range(-(-percent * n // 100), n + 1):
                assert least_overlap(n, m, percent) * (100 + percent) >= percent * (n + m)
                (p, need_n), (q, need_m) = _prefix_sizes(n, percent), _prefix_sizes(m, percent)
                for size, length, need in ((n, p, need_n), (m, q, need_m)):
                    # that many of the shared ones are in the prefix, however they lie
                    assert min(size, length) - (size - least_overlap(n, m, percent)) >= min(need, least_overlap(n, m, percent))


@pytest.mark.parametrize("matches", [(1,), (5,), (64,)])
def test_any_number_of_matches_gives_the_same_links(spark, monkeypatch, matches):
    monkeypatch.setattr(prefix_join, "MATCHES", matches)
    monkeypatch.setattr(prefix_join, "HUBS", 0)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    base = [rng.choice(words) for _ in range(60)]
    rows = [(n, " ".join(edited(rng, base, words, rng.randrange(6)))) for n in range(60)]
    assert told(jaccard_classes(frame(spark, rows))) == brute(rows)


def test_links_only_between_labels(spark):
    import numpy as np

    one = np.arange(50, dtype=np.uint64)
    sets = spark.createDataFrame([(n, np.sort(np.append(one, np.uint64(1000 + n % 2))).tobytes()) for n in range(4)], "node long, shingles binary")
    keys = prefix_keys(sets, 80)
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1)], "node long, label long")
    found = {frozenset(map(int, r)) for r in links_across(keys, with_hubs(keys, sets), labels, sets, 80).collect()}
    assert found == {frozenset(p) for p in [(0, 1), (0, 3), (2, 1), (2, 3)]}


def test_empty_table(spark):
    assert told(jaccard_classes(frame(spark, []))) == []
    assert told(jaccard_classes(frame(spark, [(1, None), (None, None)]))) == [(1, 0, 1), (None, 0, None)]
