import hashlib
import math
import random
import re
import zlib

import numpy as np

from tessera.llm import importance
from tessera.llm.importance import crc32_spans, importance_resample

SCHEMA = "doc_id long, text string, score string, rank int, place int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, low, high):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(low, high + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, low=1, high=1, buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    docs = [(i, *features(t, low, high)) for i, t in rows]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, fs in docs:
        for f in fs:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text, low, high)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (s.sum() + buckets) / ((x + 1) * (t.sum() + buckets)))) for x, y in zip(s, t)]
    out = []
    for i, n, fs in docs:
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = n
    return sorted(map(tuple, out), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def told(df):
    assert df.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, df.collect()), key=str)


def corpus():
    rng = random.Random(13)
    words = [f"w{n}" for n in range(300)] + ["É", "日本", "x-y", "A_b", "0", "l" * 100]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(n, text(rng.randrange(0, 60))) for n in range(200)]
    rows += [(300, None), (301, ""), (302, " -\t"), (303, text(70_000)), (304, "Q" * 700_000), (None, text(30)), (None, text(30)), (5, text(40)), (5, rows[5][1])]
    rows += [(400 + n, rows[7][1]) for n in range(50)]
    return rows, [text(20) for _ in range(10)] + [None, ""]


def test_against_brute_force(spark):
    rows, target = corpus()
    benchmark = spark.createDataFrame([(t,) for t in target], "text string").repartition(3)
    assert told(importance_resample(frame(spark, rows).repartition(5), benchmark)) == brute(rows, target)


def test_longer_runs_and_slices(spark, monkeypatch):
    rows, target = corpus()
    monkeypatch.setattr(importance, "SLICE", 200)
    benchmark = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resample(frame(spark, rows[:205] + rows[205:]).repartition(2), benchmark, runs=(1, 3), buckets=97, percent=50, least_words=3, seed=7)
    assert told(got) == brute(rows, target, 1, 3, 97, 3, 50, 7)


def test_pieces_count_as_the_whole_text():
    text = b" ".join(b"w%d" % n for n in range(5000))
    whole = importance.hashed_runs([text], 1, 3, 1000)
    parts = [importance.hashed_runs([p], 1, 3, 1000, known) for p, known in importance._pieces(text * 9, 2)]
    again = importance.hashed_runs([text * 9], 1, 3, 1000)
    assert len(whole[0]) == 3 * 5000 - 3
    assert len(parts) > 1 or len(text) * 9 <= importance.SLICE
    assert np.array_equal(sum(np.bincount(p[0], minlength=1000) for p in parts), np.bincount(again[0], minlength=1000))
    assert sum(p[2][0] for p in parts) == again[2][0]


def test_hash_of_spans():
    data = np.frombuffer(bytes(range(256)) * 4, np.uint8)
    starts, sizes = np.array([0, 5, 5, 700, 3, 9]), np.array([0, 1, 64, 65, 300, 9])
    assert crc32_spans(data, starts, sizes).tolist() == [zlib.crc32(data[a : a + n]) for a, n in zip(starts, sizes)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert told(importance_resample(frame(spark, []), none)) == []
    rows = [(1, "a b c " * 10), (2, "b " * 30)]
    assert told(importance_resample(frame(spark, rows), none, percent=100)) == brute(rows, [], percent=100)


def test_rank_is_the_place_in_the_whole_order(spark):
    rows = [(n, "same words " * 12) for n in range(500)] + [(n % 5, "same words " * 11) for n in range(300)]
    got = told(importance_resample(frame(spark, rows).repartition(7), spark.createDataFrame([("same",)], "text string"), percent=60))
    assert got == brute(rows, ["same"], percent=60)
    assert sorted(r[5] for r in got if r[5]) == list(range(1, 481))
