"""Word shingles of whole texts, hashed with numpy over many short texts or a slice of a long one at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20260101)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)

# Texts are hashed in slices of so many bytes; a slice takes some forty times its size in memory.
SLICE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def finish(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _spans(joined: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased bytes: each word's start, end and unfinished hash, which adds up over parts of a word."""
    inside = np.concatenate([[False], ~drop[joined], [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(~inside[1:] & inside[:-1])
    up, down = _powers(len(joined))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[joined] * up[: len(joined)], dtype=np.uint64)])
    return starts, ends, (sums[ends] - sums[starts]) * down[starts]


def word_hashes(texts: list[bytes], *, drop: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts together: a hash for each lower-cased word, and the number of each text's
    first word (one more entry than texts).

    ``drop`` marks the bytes that are in no word. Two words with one hash need an
    accident of 64 bits.
    """
    starts, ends, raw = _spans(_LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)], drop)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return finish(raw + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


def long_word_hashes(text: bytes, *, drop: np.ndarray = _SPACE) -> Iterator[np.ndarray]:
    """The same hashes for one long text, a slice of ``SLICE`` bytes at a time; words may be longer than a slice."""
    raw, length = 0, 0  # of the word that the last slice ended in
    for at in range(0, len(text), SLICE):
        part = _LOWER[np.frombuffer(text, np.uint8, min(SLICE, len(text) - at), at)]
        starts, ends, raws = _spans(part, drop)
        sizes = (ends - starts).astype(np.uint64)
        if length and len(starts) and starts[0] == 0:
            raws[0] = np.uint64((raw + int(raws[0]) * pow(_BASE, length, 2**64)) % 2**64)
            sizes[0] += np.uint64(length)
        elif length:
            raws, sizes = np.concatenate([[np.uint64(raw)], raws]), np.concatenate([[np.uint64(length)], sizes])
        raw, length = 0, 0
        if len(ends) and ends[-1] == len(part):
            raw, length = int(raws[-1]), int(sizes[-1])
            raws, sizes = raws[:-1], sizes[:-1]
        yield finish(raws + sizes)
    if length:
        yield finish(np.array([raw], np.uint64) + np.uint64(length))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words, ignoring where texts end."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _STEP + hashes[j : n + j]
    return finish(out + np.uint64(k))


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes; all words as one if fewer, none if none."""
    if len(texts) == 1 and len(texts[0]) > SLICE:
        yield _long_shingles(texts[0], k)
        return
    hashes, first = word_hashes(texts)
    rolled = rolling(hashes, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        else:
            yield rolling(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64)


def _long_shingles(text: bytes, k: int) -> np.ndarray:
    tail, found = np.empty(0, np.uint64), []
    for hashes in long_word_hashes(text):
        tail = np.concatenate([tail, hashes])
        found.append(np.unique(rolling(tail, k)))
        tail = tail[max(0, len(tail) - k + 1) :]
    out = np.unique(np.concatenate(found))
    return out if len(out) or not len(tail) else rolling(tail, len(tail))


def in_chunks(texts: Iterable[bytes], most: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of up to ``most`` bytes together, with the place of the first; a longer text is alone."""
    at, n, chunk, size = 0, 0, [], 0
    for n, text in enumerate(texts):
        if chunk and size + len(text) > most:
            yield at, chunk
            at, chunk, size = n, [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield at, chunk


def bodies(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary column one after another, null as empty."""
    return (value.as_py() or b"" for value in column)
