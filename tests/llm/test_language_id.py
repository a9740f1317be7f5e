import numpy as np
import pytest

from tessera.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in L.LanguageModel.fresh(["a", "b", "c"], hidden=3, seed=1).params.items()}
    codes = rng.integers(0, 256, (7, 4)).astype(np.intp)
    mask = np.ones((7, 4))
    mask[5:, 1] = 0
    labels = np.array([0, 1, 2, 1])
    _, grads = L.gradients(p, codes, mask, labels)
    for name in p:
        some = [(codes[0, 0], 1)] if name.startswith("table") else [tuple(rng.integers(0, s) for s in p[name].shape) for _ in range(3)]
        for at in some:
            old = p[name][at]
            p[name][at] = old + 1e-5
            up, _ = L.gradients(p, codes, mask, labels)
            p[name][at] = old - 1e-5
            down, _ = L.gradients(p, codes, mask, labels)
            p[name][at] = old
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_held_out_accuracy_and_determinism(spark):
    got = L.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(got) == 1000 and len(out) > 250
    assert sum(r.lang == r.lang_pred for r in out) / len(out) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    again = {r.doc_id: (r.lang_pred, r.score) for r in L.query(spark, SF).collect()}
    assert all(again[r.doc_id] == (r.lang_pred, r.score) for r in got)


def test_nulls_and_clashing_columns(spark):
    rows = [(1, "the of and the", "en", 0.5), (2, "der und die das", "de", 0.5), (3, None, "en", None), (4, "123 !? \n", None, None), (5, "", "de", None), (None, "the of", "en", 1.0), (6, "x" * 200_000, None, None), (1, "the of and the", "en", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = L.fit_languages(df)
    assert model.languages == ["de", "en"]
    got = L.identify_languages(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    by = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert by[3] == by[4] == by[5] == ("und", 0.0)
    assert by[6][0] in ("de", "en")
    assert got.count() == len(rows)


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = L.fit_languages(df)
    assert [r.lang_pred for r in L.identify_languages(df, model).collect()] == ["und"]
    assert L.identify_languages(df.where("false"), model).collect() == []


def plain_probabilities(model, text):
    """Every byte by itself, one after another, in windows that start afresh."""
    p, total = {k: v.astype(np.float64) for k, v in model.params.items()}, np.zeros(len(model.languages))
    sig = lambda x: 1 / (1 + np.exp(-x))
    for at in range(0, len(text), L.WINDOW):
        part = text[at : at + L.WINDOW]
        states = {}
        for way, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            units = p["turn_" + way].shape[1]
            h = np.zeros(units)
            for t in order:
                g, u = p["table_" + way][part[t]], p["turn_" + way] @ h
                z, r = sig(g[:units] + u[:units]), sig(g[units : 2 * units] + u[units : 2 * units])
                n = np.tanh(g[2 * units :] + r * u[2 * units :])
                h = (1 - z) * n + z * h
                states[way, t] = h
        for t in range(len(part)):
            x = p["top"] @ np.concatenate([states["f", t], states["b", t]]) + p["bias"][:, 0]
            e = np.exp(x - x.max())
            total += e / e.sum()
    return total / max(1, len(text))


def test_batches_equal_a_plain_pass_over_bytes():
    rng = np.random.default_rng(5)
    model = L.LanguageModel.fresh(["a", "b", "c"], seed=9)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 63, 64, 65, 200, 7, 128)]
    got = L.document_probabilities(model, texts)
    assert np.allclose(got, [plain_probabilities(model, t) for t in texts], atol=1e-5)
