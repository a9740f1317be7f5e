import hashlib
from collections import defaultdict

import pytest

from tessera.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, run int, part string, body string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "b") for r in rows], SCHEMA)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_against_brute_force(spark, keep):
    rows = [(i, "copy") for i in range(400)] + [(1000 + i, f"text {i % 50}" + "x" * (i % 7) * 3000) for i in range(300)]
    rows += [(5000, None), (5001, ""), (5002, "é"), (None, "copy"), (5003, "a" * 48 + "1"), (5004, "a" * 48 + "2"), (5005, "a" * 48 + "1")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = max if keep == "largest" else min
    stay = {t: best(x for x in v if x is not None) for t, v in groups.items()}
    want = sorted(((i, stay[t or ""], len(groups[t or ""]), i == stay[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)
    got = exact_dedup(frame(spark, rows).repartition(7), keep=keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_repeated_identifiers_keep_one_row(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c")]
    got = exact_dedup(frame(spark, rows)).collect()
    assert len(got) == 5
    assert sorted((r.text_sha256[:4], r.group_size) for r in got if r.kept) == sorted((hashlib.sha256(t.encode()).hexdigest()[:4], n) for t, n in (("a", 2), ("b", 1), ("c", 2)))


def test_empty_table(spark):
    assert exact_dedup(frame(spark, [])).collect() == []
