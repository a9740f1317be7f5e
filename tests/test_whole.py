"""Queries read every row that their operator is about."""

from collections import Counter

from tessera.operators import similar
from tessera.plans import catalogue
from tessera.sources import views as V

FOLDER = "/root/testdata/sf0.001"


def test_every_event(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    for name in ("rationals", "fps_snap"):
        assert sorted(r.event_id for r in catalogue.queries()[name](spark, FOLDER).collect()) == sorted(r.event_id for r in events.collect())
    distinct = {(r.event_type, r.user_id % 7, r.event_id % 5) for r in events.collect()}
    want = {(*e, code) for e in distinct for code, bad in (("domain", e[1] > 4), ("version", e[2] == 0), ("id", e[0] == "view")) if bad}
    assert {tuple(r) for r in catalogue.queries()["manifest_errors"](spark, FOLDER).collect()} == want


def test_views_of_all_rows(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").collect()
    ids = sorted(r.event_id for r in events)
    assert sorted(r.pos for r in V.samples(spark, FOLDER).collect()) == ids
    assert V.faces(spark, FOLDER).count() == sum(i % 5 % 4 for i in ids)
    assert V.segments(spark, FOLDER).count() == len(ids) - len({r.user_id for r in events})
    said = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    words = V.words(spark, FOLDER).collect()
    assert len(words) == sum(w != "" for r in said for w in (r.text or "").split(" ")) == len({w.word_id for w in words})
    assert catalogue.queries()["lag_deltas"](spark, FOLDER).count() == len(ids)


def test_every_query_vector(spark, monkeypatch):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    asked = {r.vec_id for r in rows if r.vec_id % 100 == 0}
    got = catalogue.queries()["vector_top_k"](spark, FOLDER).collect()
    assert Counter(r.query_id for r in got) == dict.fromkeys(asked, 10)
    monkeypatch.setattr(similar, "QUERY_ROWS", 2)
    monkeypatch.setattr(similar, "DATA_ROWS", 7)
    data = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(1, 401)] + [(500, [1.0]), (501, None)], "vec_id long, embedding array<float>")
    queries = data.where("vec_id in (100, 200, 300, 501)").withColumnRenamed("vec_id", "query_id")
    found = similar.block_top_k(queries, data, k=3).collect()
    assert {q: sorted(r.vec_id for r in found if r.query_id == q) for q in (100, 200, 300, 501)} == {100: [1, 4, 7], 200: [2, 5, 8], 300: [3, 6, 9], 501: []}
