"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled
texts. It reads a text in windows of ``WINDOW`` bytes, in both directions, gives every byte a
probability for each language, and a document's probabilities are the mean over all its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import bounded_batches, table

WINDOW, HIDDEN = 64, 8
PER_LANGUAGE, EXCERPT = 600, 384
EPOCHS, BATCH, RATE = 5, 256, 0.02
UNDETERMINED = "und"
_BLOCK = 1024
_CHUNK_BYTES = 1 << 19


@dataclass
class LanguageModel:
    """``table``: for each direction what a byte adds to the gates; ``turn``: what the state adds;
    ``top`` and ``bias``: from both states to a language."""

    languages: list[str]
    params: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 2) -> LanguageModel:
        rng = np.random.default_rng(seed)
        p = {"top": rng.normal(0, 0.3, (len(languages), 2 * hidden)), "bias": np.zeros((len(languages), 1))}
        for way in ("f", "b"):
            p["table_" + way] = rng.normal(0, 0.5, (256, 3 * hidden))
            p["turn_" + way] = rng.normal(0, 0.3, (3 * hidden, hidden))
        return cls(languages, {k: v.astype(np.float32) for k, v in p.items()})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _states(table_: np.ndarray, turn: np.ndarray, codes: np.ndarray, mask: np.ndarray | None, order: range, saved: dict | None = None) -> np.ndarray:
    """The state after each byte; codes and mask are (time, window), the result (time, unit, window)."""
    h, n_units = np.zeros((turn.shape[1], codes.shape[1]), turn.dtype), turn.shape[1]
    out = np.empty((len(codes), *h.shape), turn.dtype)
    for t in order:
        g, u = table_[codes[t]].T, turn @ h
        gates = _sigmoid(g[: 2 * n_units] + u[: 2 * n_units])
        z, r = gates[:n_units], gates[n_units:]
        n = np.tanh(g[2 * n_units :] + r * u[2 * n_units :])
        if saved is not None:
            saved[t] = (h, z, r, n, u[2 * n_units :])
        h = n + z * (h - n)
        if mask is not None:
            h = h * mask[t]
        out[t] = h
    return out


def _probabilities(p: dict[str, np.ndarray], forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    units = forward.shape[1]
    x = np.matmul(p["top"][:, :units], forward) + np.matmul(p["top"][:, units:], backward) + p["bias"]
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def gradients(p: dict[str, np.ndarray], codes: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all bytes, and its gradient by backpropagation through time."""
    steps, units = len(codes), p["turn_f"].shape[1]
    orders = {"f": range(steps), "b": range(steps - 1, -1, -1)}
    saved: dict[str, dict] = {"f": {}, "b": {}}
    hs = {w: _states(p["table_" + w], p["turn_" + w], codes, mask, orders[w], saved[w]) for w in orders}
    probs = _probabilities(p, hs["f"], hs["b"])
    count = mask.sum()
    picked = np.take_along_axis(probs, labels[None, None, :].repeat(steps, 0), axis=1)[:, 0]
    loss = float(-(np.log(picked + 1e-9) * mask).sum() / count)
    d = probs
    d[:, labels, np.arange(len(labels))] -= 1
    d *= (mask / count)[:, None, :]
    grads = {"bias": d.sum(axis=(0, 2))[:, None], "top": np.concatenate([np.einsum("tcb,thb->ch", d, hs[w], optimize=True) for w in ("f", "b")], axis=1)}
    for way, part in (("f", slice(0, units)), ("b", slice(units, 2 * units))):
        turn, up = p["turn_" + way], p["top"][:, part].T
        d_turn, d_codes, later = np.zeros_like(turn), np.empty((steps, 3 * units, codes.shape[1]), turn.dtype), 0.0
        for t in reversed(orders[way]):
            before, z, r, n, u = saved[way][t]
            dh = (up @ d[t] + later) * mask[t]
            da = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = da * u * r * (1 - r)
            du = np.concatenate([dz, dr, da * r])
            d_turn += du @ before.T
            d_codes[t] = np.concatenate([dz, dr, da])
            later = dh * z + turn.T @ du
        d_table = np.zeros_like(p["table_" + way])
        np.add.at(d_table, codes.ravel(), d_codes.transpose(0, 2, 1).reshape(-1, 3 * units))
        grads |= {"table_" + way: d_table, "turn_" + way: d_turn}
    return loss, grads


def _windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """All windows of all texts: codes (window, time), the texts' numbers, and which bytes are real."""
    whole, owners, rest, rest_owners = [], [], [], []
    for n, text in enumerate(texts):
        codes = np.frombuffer(text, np.uint8)
        full = len(codes) // WINDOW
        if full:
            whole.append(codes[: full * WINDOW].reshape(-1, WINDOW))
            owners.append(np.full(full, n))
        if len(codes) > full * WINDOW:
            rest.append(codes[full * WINDOW :])
            rest_owners.append(n)
    if whole:
        yield np.concatenate(whole), np.concatenate(owners), None
    if rest:
        codes, mask = np.zeros((len(rest), WINDOW), np.uint8), np.zeros((len(rest), WINDOW), np.float32)
        for n, part in enumerate(rest):
            codes[n, : len(part)], mask[n, : len(part)] = part, 1
        yield codes, np.array(rest_owners), mask


def train(texts: list[bytes], labels: list[str], *, epochs: int = EPOCHS, seed: int = 2) -> LanguageModel:
    """Fit a network to texts; equal inputs give equal networks."""
    model = LanguageModel.fresh(sorted(set(labels)), seed=seed)
    index = {x: n for n, x in enumerate(model.languages)}
    of_text = np.array([index[x] for x in labels])
    parts = [(c, of_text[o], np.ones(c.shape, np.float32) if m is None else m) for c, o, m in _windows(texts)]
    if not parts or len(model.languages) < 2:
        return model
    codes, target, mask = (np.concatenate(x) for x in zip(*parts))
    rng, p = np.random.default_rng(seed), model.params
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    total = epochs * -(-len(codes) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for at in range(0, len(codes), BATCH):
            some = order[at : at + BATCH]
            _, grads = gradients(p, codes[some].T.astype(np.intp), np.ascontiguousarray(mask[some].T), target[some])
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def document_probabilities(model: LanguageModel, texts: list[bytes]) -> np.ndarray:
    """(text, language): the mean over every byte of each text; zero for an empty text."""
    p, sums = model.params, np.zeros((len(texts), len(model.languages)))
    for codes, owners, mask in _windows(texts):
        for at in range(0, len(codes), _BLOCK):
            own = np.ascontiguousarray(codes[at : at + _BLOCK].T).astype(np.intp)
            real = None if mask is None else np.ascontiguousarray(mask[at : at + _BLOCK].T)
            forward = _states(p["table_f"], p["turn_f"], own, real, range(WINDOW))
            backward = _states(p["table_b"], p["turn_b"], own, real, range(WINDOW - 1, -1, -1))
            probs = _probabilities(p, forward, backward)
            pooled = (probs if real is None else probs * real[:, None, :]).sum(axis=0)
            for c in range(len(sums[0])):
                sums[:, c] += np.bincount(owners[at : at + _BLOCK], pooled[c], len(texts))
    return sums / np.maximum([[len(t)] for t in texts], 1)


def fit_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, seed: int = 2) -> LanguageModel:
    """Fit on about ``per_language`` rows of each language, an excerpt of ``EXCERPT`` characters of each.

    Which rows is decided by a hash of their identifier and a rate from the language's count, so the
    driver receives a sample whose size doesn't depend on the table's. Rows with a null text, language or
    identifier are not learned from. Without any such row the model knows no language.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[lang_col]: r["n"] for r in known.groupBy(lang_col).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel.fresh([])
    grain = 1 << 30
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, int(grain * min(1.0, per_language / n)))])
    mark = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    start = F.pmod(F.shiftright(mark, 33), F.greatest(F.lit(1), F.length(text_col) - EXCERPT)).cast("int") + 1
    rows = (
        known.where(F.pmod(mark, F.lit(grain)) < F.element_at(rate, F.col(lang_col)))
        .select(mark.alias("mark"), F.col(lang_col).alias("lang"), F.substring(F.col(text_col), start, F.lit(EXCERPT)).alias("excerpt"))
        .collect()
    )
    rows.sort(key=lambda r: (r["mark"], r["lang"], r["excerpt"]))
    return train([r["excerpt"].encode() for r in rows], [r["lang"] for r in rows], seed=seed)


_LETTERS, _BODY = "_tessera_has_letter", "_tessera_body"


def _predictor(model: LanguageModel, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [t if ok else b"" for t, ok in zip(batch.column(_BODY).to_pylist(), batch.column(_LETTERS).to_pylist())]
            langs, scores, at = [], [], 0
            while at < len(bodies):
                to, size = at, 0
                while to < len(bodies) and (size < _CHUNK_BYTES or to == at):
                    size += len(bodies[to])
                    to += 1
                probs = document_probabilities(model, bodies[at:to]) if model.languages else np.zeros((to - at, 1))
                best = probs.argmax(axis=1)
                for n, body in enumerate(bodies[at:to]):
                    known = bool(body) and bool(model.languages)
                    langs.append(model.languages[best[n]] if known else UNDETERMINED)
                    scores.append(min(1.0, float(probs[n, best[n]])) if known else 0.0)
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return predict


def identify_languages(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score (columns of those names are replaced).

    Only the text decides. A null text or one without a letter is ``und`` with score 0, and so is every
    text if the model knows no language. Repeated rows are judged alike; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    own = docs.drop("lang_pred", "score")
    text = F.col(text_col).cast("string")
    ready = own.select("*", F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(_LETTERS), F.coalesce(text, F.lit("")).cast("binary").alias(_BODY))
    schema = T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return ready.mapInArrow(_predictor(model, own.columns), schema)


def held_out(id_col: str = "doc_id"):
    """True for the documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out()))
    return identify_languages(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
