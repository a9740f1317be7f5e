"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

The distinct marked words of a batch are sorted, which lays them out as a trie in depth-first
order: each word keeps the forward states of the prefix that it shares with the word before
and only goes on from there.

For a unigram model the state of a prefix is its best score and last piece. For a BPE model the
state is the last piece of the prefix's own encoding: a piece may follow another exactly if
merging the two alone leaves both as they are, and just one piece that may follow ends at each
position, so the forward pass gives the encoding that merging the whole word would.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_CACHE_WORDS, _CACHE_PAIRS, _CHUNK_CHARS = 300_000, 300_000, 1 << 20


@dataclass
class Vocabulary:
    """Pieces of a model with what encoding and decoding need."""

    kind: str
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int] | None
    unknown: int
    raw: list[bytes]
    words_split: bool = True
    words: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)
    follows: dict[str, dict[str, bool]] = field(default_factory=dict)
    n_pairs: int = 0
    tails: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        """By the last two characters of pieces: the lengths that pieces with that end have, longest first."""
        sizes: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                sizes.setdefault(piece[-2:], set()).add(len(piece))
        self.tails = {k: tuple(sorted(x, reverse=True)) for k, x in sizes.items()}

    @classmethod
    def from_pieces(cls, pieces: list[tuple[str, float]], *, kind: str, byte_ids: list[int] | None = None, unknown: int = 0, skip: frozenset[int] = frozenset()) -> Vocabulary:
        ids = {p: i for i, (p, _) in enumerate(pieces) if i not in skip and i != unknown}
        raw = [b"" if i in skip else p.replace(MARK, " ").encode() for i, (p, _) in enumerate(pieces)]
        raw[unknown] = " ⁇ ".encode()
        for value, i in enumerate(byte_ids or ()):
            raw[i] = bytes([value])
        inner = any(a != MARK and b == MARK for p in ids for a, b in zip(p, p[1:])) or any("\n" in p and len(p) > 1 for p in ids)
        return cls(kind, ids, {p: s for p, s in pieces if p in ids}, byte_ids, unknown, raw, not inner)


USER_DEFINED = 4


def _refuse_unhandled(spec) -> None:
    rule = spec.normalizer_spec
    if rule.name not in ("", "identity") or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces or not rule.add_dummy_prefix or spec.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("models that normalise texts are not supported")
    if any(piece.type == USER_DEFINED for piece in spec.pieces):
        raise ValueError("models with pieces defined by a user are not supported")
    if spec.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")


def load_vocabulary(model_file: str = MODEL) -> Vocabulary:
    """Read a model file; the driver does so once and ships the pieces (bounded by the model) to tasks.

    A model whose normaliser changes texts, or that has pieces defined by a user, is refused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(size)]
    byte_ids = [i for i in range(size) if model.is_byte(i)]
    skip = frozenset(i for i in range(size) if model.is_control(i) or model.is_unused(i) or model.is_byte(i))
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(model_file, "rb") as f:
        spec.ParseFromString(f.read())
    _refuse_unhandled(spec)
    kind = {1: "unigram", 2: "bpe"}[spec.trainer_spec.model_type]
    return Vocabulary.from_pieces(pieces, kind=kind, byte_ids=byte_ids if len(byte_ids) == 256 else None, unknown=model.unk_id(), skip=skip)


def merged(v: Vocabulary, text: str) -> list[str]:
    """BPE by its definition: merge the best neighbouring pair, leftmost first, until none is a piece."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for n in range(len(parts) - 1):
            score = v.scores.get(parts[n] + parts[n + 1])
            if score is not None and (best is None or score > best):
                best, at = score, n
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _may_follow(v: Vocabulary, left: str, right: str) -> bool:
    if v.n_pairs >= _CACHE_PAIRS:
        v.follows.clear()
        v.n_pairs = 0
    v.n_pairs += 1
    known = v.follows.setdefault(left, {})[right] = merged(v, left + right) == ([left, right] if left else [right])
    return known


def _piece_ids(v: Vocabulary, parts: Iterable[str]) -> bytes:
    out = []
    for part in parts:
        i = v.ids.get(part)
        if i is not None:
            out.append(i)
        elif v.byte_ids:
            out.extend(v.byte_ids[b] for b in part.encode())
        elif not out or out[-1] != v.unknown:
            out.append(v.unknown)
    return array("i", out).tobytes()


def _extend_bpe(v: Vocabulary, word: str, last: list[str], score: list[float], start: int) -> None:
    """Forward states of the prefixes behind ``start``: the piece that ends the prefix's encoding.

    Just one piece may; when no longer one does, it is the single character.
    """
    ids, follows, tails = v.ids, v.follows, v.tails
    for end in range(start + 1, len(word) + 1):
        best = word[end - 1]
        for size in tails.get(word[end - 2 : end], ()) if end > 1 else ():
            if size > end:
                continue
            piece = word[end - size : end]
            if piece in ids:
                left = last[end - size]
                after = follows.get(left)
                known = None if after is None else after.get(piece)
                if _may_follow(v, left, piece) if known is None else known:
                    best = piece
                    break
        last.append(best)
        score.append(0.0)


def _extend_unigram(v: Vocabulary, word: str, last: list[str], score: list[float], start: int) -> None:
    """Forward states of the prefixes behind ``start``: the best score and the piece it ends with."""
    scores, floor = v.scores, min(v.scores.values(), default=0.0) - UNKNOWN_PENALTY
    for end in range(start + 1, len(word) + 1):
        best, top = word[end - 1], score[end - 1] + scores.get(word[end - 1], floor)
        for size in v.tails.get(word[end - 2 : end], ()) if end > 1 else ():
            piece = word[end - size : end]
            if size <= end and piece in scores and score[end - size] + scores[piece] > top:
                best, top = piece, score[end - size] + scores[piece]
        last.append(best)
        score.append(top)


def encode_words(v: Vocabulary, words: Iterable[str]) -> dict[str, bytes]:
    """The ids of distinct words, as int32 bytes. One depth-first pass over the words' trie."""
    out: dict[str, bytes] = {}
    previous, last, score = "", [""], [0.0]
    extend = _extend_bpe if v.kind == "bpe" else _extend_unigram
    for word in sorted(words):
        shared, most = 0, min(len(word), len(previous))
        while shared < most and word[shared] == previous[shared]:
            shared += 1
        del last[shared + 1 :], score[shared + 1 :]
        extend(v, word, last, score, shared)
        parts, end = [], len(word)
        while end:
            parts.append(last[end])
            end -= len(last[end])
        out[word] = _piece_ids(v, reversed(parts))
        previous = word
    return out


def marked_words(v: Vocabulary, text: str) -> list[str]:
    """The text with its spaces marked, cut where no piece reaches across."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    return _WORDS.findall(marked) if v.words_split else [marked]


def _encoder(v: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def chunk_of(ids: list, texts: list[str]) -> pa.RecordBatch:
        split = [marked_words(v, t) for t in texts]
        # two generations of known words, so that frequent ones outlive the rest
        new = set().union(*split).difference(v.words)
        if len(v.words) + len(new) > _CACHE_WORDS:
            v.older, v.words = v.words, {}
            new = set().union(*split)
        known = new.intersection(v.older)
        v.words.update((w, v.older[w]) for w in known)
        v.words.update(encode_words(v, new - known))
        rows = [b"".join(map(v.words.__getitem__, words)) for words in split]
        offsets = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
        values = pa.array(np.frombuffer(b"".join(rows), np.int32))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "tokens"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= _CHUNK_CHARS:
                    yield chunk_of(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield chunk_of(ids, texts)

    return encode


def encode(docs: DataFrame, *, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, tokens array<int>.

    Null and empty texts have no tokens. Special tokens are never produced; their strings in a
    text are ordinary text. Repeated rows are encoded alike. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    v = vocabulary or load_vocabulary()
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(_encoder(v), "doc_id long, tokens array<int>")


def _decoder(v: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    raw = np.array(v.raw, dtype=object)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for tokens in batch.column("tokens"):
                values = tokens.values
                text = b"" if values is None else b"".join(raw[values.to_numpy(zero_copy_only=False)].tolist())
                # the mark that encoding puts in front of a text
                texts.append(text.removeprefix(b" ").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tokens"), pa.array(texts, pa.string())], names=["doc_id", "tokens", "text"])

    return decode


def decode(encoded: DataFrame, *, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Rows (doc_id, tokens) to (doc_id, tokens, text). Null tokens give the empty text; bytes
    that are no UTF-8 become replacement characters."""
    v = vocabulary or load_vocabulary()
    return encoded.select("doc_id", "tokens").mapInArrow(_decoder(v), "doc_id long, tokens array<int>, text string")


def encode_and_decode(docs: DataFrame, *, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_tokens, token_hash (Spark's xxhash64 of the ids), text_sha256 of the decoded text."""
    v = vocabulary or load_vocabulary()
    back = decode(encode(docs, vocabulary=v), vocabulary=v)
    return back.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.xxhash64("tokens").alias("token_hash"), F.sha2("text", 256).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"))
