from collections import Counter, defaultdict

import pytest
import sentencepiece

import corpus_pipeline as C
from tessera.llm import language_id
from tests.llm.test_minhash_dedup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string"
ROWS = [(i, t, "en", s, None if t is None else len(t), 5, "k") for i, t, s in [
    (1, "the quick brown fox jumps over the lazy dog again", "a"), (2, "the quick brown fox jumps over the lazy dog again", "b"), (3, None, "a"), (4, "12 34", "b"),
    (5, "", None), (6, "one two three four five six", None), (6, "one two three four five six", None), (None, "nobody knows this text at all", "a"), (7, "other words are here for once " * 40, "c")]]


def stages(spark, df, folder):
    out, docs = [], df
    for n, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, "unused").write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        out.append(docs)
    return out


def told(df):
    """Documents with a letter whose best language has more than MIN_ODDS times the even odds."""
    model = language_id.fit_languages(df.where(~language_id.held_out()))
    rows = [(r.doc_id, r.text) for r in df.collect() if r.text and any(c.isalpha() for c in r.text)]
    best = language_id.document_probabilities(model, [t.encode() for _, t in rows]).max(axis=1)
    return Counter(r for r, p in zip(rows, best) if p >= min(1, C.MIN_ODDS / len(model.languages)))


def check(df, outs):
    """Each stage against plain Python on what the stage before kept."""
    lang, exact, near, mixed, coded = outs
    kept = Counter((r.doc_id, r.text) for r in lang.collect())
    assert kept == told(df)

    largest = {}
    for i, t in kept:
        if t not in largest or (i is not None and (largest[t] is None or i > largest[t])):
            largest[t] = i
    after = Counter((r.doc_id, r.text) for r in exact.collect())
    assert after == Counter({(i, t): 1 for t, i in largest.items()})

    rows = sorted(after, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    groups = defaultdict(list)
    for n, _, component, _ in brute(list(enumerate(t for _, t in rows))):
        groups[component].append(rows[n])
    last = Counter((r.doc_id, r.text) for r in near.collect())
    assert sum(last.values()) == len(groups)
    for group in groups.values():
        (stays,) = [r for r in group if last[r]]
        assert stays[0] == min(group, key=lambda r: (r[0] is None, r[0] or 0))[0]

    size = lambda t: len(t.split())
    given, taken = defaultdict(int), defaultdict(int)
    for r in near.collect():
        given[r.source] += size(r.text)
    for r in mixed.collect():
        taken[r.source] += size(r.text)
    assert all(taken[s] <= 3 * given[s] for s in given)
    assert abs(sum(taken.values()) - sum(given.values())) <= len(given)
    assert mixed.columns == near.columns == exact.columns == lang.columns

    model = sentencepiece.SentencePieceProcessor(model_file=C.sentencepiece_codec.MODEL)
    assert Counter((r.doc_id, r.n_tokens) for r in coded.collect()) == Counter((r.doc_id, len(model.encode(r.text))) for r in mixed.collect())


def test_edge_cases(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    check(df, stages(spark, df, tmp_path))


def test_rows_that_share_an_identifier(spark, tmp_path):
    a, b = " ".join(f"word{n}x" for n in range(60)), " ".join(f"other{n}y" for n in range(60))
    rows = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (None, b + " again"), (None, "quite another text without an identifier"), (2, "a third text of the second one")]
    df = spark.createDataFrame([(i, t, "en", "a", len(t), 5, "k") for i, t in rows], SCHEMA)
    outs = stages(spark, df, tmp_path)
    check(df, outs)
    assert {(r.doc_id, r.text) for r in outs[2].collect()} == {rows[0], rows[2], rows[5], rows[6]}


def test_a_cut_text_keeps_its_white_space(spark):
    text = " one\n\ttwo  three four\n"
    rows = [(1, text * 3, "en", "a", 0, 5, "k"), (2, "x y z", "en", "b", 0, 5, "k"), (3, "u v", "en", "c", 0, 5, "k")]
    mixed = C.mix(spark, spark.createDataFrame(rows, SCHEMA), "unused").collect()
    assert mixed and all(r.n_chars == len(r.text) and any(t.startswith(r.text) for _, t, *_ in rows) for r in mixed)
    assert any(r.text != t and t.startswith(r.text) for r in mixed for _, t, *_ in rows)


def test_documents(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    outs = stages(spark, df, tmp_path)
    check(df, outs)
    whole = C.run(spark, "/root/testdata/sf0.001").collect()
    assert Counter(whole) == Counter(outs[-1].collect())


@pytest.mark.parametrize("stage", [s for _, s in C.STAGES])
def test_empty_table(spark, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), "unused").collect() == []
