from tessera.operators import blocks, folds


def test_spacing(spark):
    rows = spark.createDataFrame([(1, float(t), i) for i, t in enumerate([0, 0.5, 0.75, 1.4, 1.5, 3])] + [(2, 0.1, 9)], "src long, t double, id long")
    got = blocks.spaced(rows, by="src", t="t", key="id", gap=0.75).collect()
    assert sorted((r.src, r.id) for r in got) == [(1, 0), (1, 2), (1, 4), (1, 5), (2, 9)]


def test_sticky_speaker_stays_unless_clearly_better(spark):
    rows = [(0, 1, ["A", "B"], [0.20, 0.19]), (0, 2, ["A", "B"], [0.19, 0.20]), (0, 3, None, None), (0, 4, ["A", "B"], [0.19, 0.25]), (0, 5, ["C"], [0.01])]
    df = spark.createDataFrame(rows, "src long, word_id long, tracks array<string>, scores array<double>")
    got = {r.word_id: r.track for r in folds.sticky_speaker(df).collect()}
    assert got == {1: "A", 2: "A", 3: "OFFSCREEN", 4: "B", 5: "C"}


def test_caption_chunks(spark):
    words = [(0, i * 0.5, i * 0.5 + 0.4, w, s) for i, (w, s) in enumerate([("one", "A"), ("two.", "A"), ("three", "A"), ("four", "B")])] + [(0, 9.0, 9.2, "late", "B")]
    got = folds.caption_chunks(spark.createDataFrame(words, "src long, start double, end double, word string, speaker string")).collect()
    assert sorted((r.start, r.text, r.speaker) for r in got) == [(0.0, "one two.", "A"), (1.0, "three", "A"), (1.5, "four", "B"), (9.0, "late", "B")]


def test_normalised_cues(spark):
    cues = [(0, 0.0, 2.0, "a", None), (0, 1.0, 3.0, "b", None), (0, 1.5, 2.5, "inside", None), (0, -1.0, 1.0, "negative", None), (0, 4.0, 5.0, " ", None), (0, float("nan"), 5.0, "x", None)]
    got = folds.normalise_cues(spark.createDataFrame(cues, "src long, start double, end double, text string, speaker string")).collect()
    assert sorted((r.start, r.end, r.text) for r in got) == [(0.0, 2.0, "a"), (2.0, 3.0, "b")]


def test_online_clusters(spark):
    rows = [(0, i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(20)]
    got = {r.key: r.cluster for r in folds.online_clusters(spark.createDataFrame(rows, "src long, key long, vector array<double>"), threshold=0.8).collect()}
    assert got == {i: "C2" if i % 2 else "C1" for i in range(20)}


def test_one_to_one(spark):
    edges = [(0, "S1", "A", 0.9), (0, "S2", "A", 0.95), (0, "S1", "B", 0.8), (0, "S3", "C", 0.5)]
    got = folds.one_to_one(spark.createDataFrame(edges, "src long, speaker string, track string, posterior double")).collect()
    assert sorted((r.speaker, r.track) for r in got) == [("S1", "B"), ("S2", "A")]
