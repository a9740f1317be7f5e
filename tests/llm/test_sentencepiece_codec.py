import itertools
import math
import random

import pytest
import sentencepiece

from tessera.llm.sentencepiece_codec import MODEL, Vocabulary, decode, encode, encode_words, load_vocabulary

SCHEMA = "doc_id long, text string, tokens string, words int"
TEXTS = ["", None, "  a  b ", "a\nb", "\t x", "héllo wörld " * 30, "   ", "🙂 \x00 <s>", "x" * 3000, "the " * 20_000, " \n \n", "naïve space", "the the", "the the"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)


def test_equals_the_library_and_round_trips(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abcdeth \n-.éß1") for _ in range(rng.randrange(60))) for _ in range(300)]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in decode(encode(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].tokens) == model.encode(t or ""), repr(t)
        assert got[i].text == (t or "")


@pytest.mark.parametrize("seed", range(5))
def test_unigram_scores_are_the_best(seed):
    rng = random.Random(seed)
    pieces = [("<unk>", 0.0)] + [(p, -rng.random() * 9) for p in {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 4))) for _ in range(20)}]
    v = Vocabulary.from_pieces(pieces, kind="unigram")
    words = ["".join(rng.choice("ab▁c") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    floor = min(v.scores.values()) - 10
    for word, ids in encode_words(v, set(words)).items():
        def cuts(w):
            for n in range(len(w)):
                for at in itertools.combinations(range(1, len(w)), n):
                    parts = [w[a:b] for a, b in zip((0, *at), (*at, len(w)))]
                    if all(p in v.scores or len(p) == 1 for p in parts):
                        yield parts
        best = max(sum(v.scores.get(p, floor) for p in parts) for parts in cuts(word))
        import numpy as np

        out = np.frombuffer(ids, np.int32).tolist()
        text = [pieces[i][0] for i in out]
        if v.unknown not in out:
            assert "".join(text) == word
            assert math.isclose(sum(v.scores[p] for p in text), best)


def test_empty_table(spark):
    assert decode(encode(frame(spark, []))).collect() == []


@pytest.mark.parametrize("change", ["normaliser", "spaces", "piece"])
def test_models_that_are_not_handled_are_refused(tmp_path, change):
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(MODEL, "rb") as f:
        spec.ParseFromString(f.read())
    if change == "normaliser":
        spec.normalizer_spec.name = "nmt_nfkc"
    elif change == "spaces":
        spec.normalizer_spec.remove_extra_whitespaces = True
    else:
        spec.pieces[500].type = 4
    (tmp_path / "m.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        load_vocabulary(str(tmp_path / "m.model"))
