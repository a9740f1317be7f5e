"""Masks of frames of 8 by 8 pixels that are carried on from frame to frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessera.operators.folds import ordered_fold


def mask_step(last: tuple[np.ndarray, float] | None, key: int, own: list[int], dx: list[int], dy: list[int], every: int) -> tuple[tuple[np.ndarray, float], tuple]:
    """The mask and coverage after a frame, and its row (key, mask, coverage, delta, stability, score).

    A key frame takes its own mask, the others the last mask moved along the flow, where pixels may meet or
    leave. Stability compares the moved mask with the frame's own."""
    own = np.asarray(own, bool).reshape(8, 8)
    moved = None
    if last is not None:
        y, x = np.nonzero(last[0])
        ty, tx = y + np.asarray(dy).reshape(8, 8)[y, x], x + np.asarray(dx).reshape(8, 8)[y, x]
        inside = (ty >= 0) & (ty < 8) & (tx >= 0) & (tx < 8)
        moved = np.zeros((8, 8), bool)
        moved[ty[inside], tx[inside]] = True
    refresh = moved is None or key % every == 0
    mask = own if refresh else moved
    coverage = float(mask.mean())
    delta = 0.0 if last is None else coverage - last[1]
    stability = None
    if moved is not None:
        union = int((moved | own).sum())
        stability = int((moved & own).sum()) / union if union else 1.0
    score = min(1.0, max(0.0, 3 * coverage)) * max(0.0, 1 - abs(delta) / 0.30)
    if stability is not None and 1e-6 < stability < 0.85:
        score = min(score, 0.85)
    if not refresh:
        score = min(score, 0.90)
    return (mask, coverage), (key, "".join("01"[b] for b in mask.ravel().astype(int)), coverage, delta, stability, score)


def propagate_masks(frames: DataFrame, every: int = 8) -> DataFrame:
    """Frames (src, key, own, dx, dy) with 8 by 8 arrays to (src, key, mask, coverage, delta, stability, score)."""

    def step(last, row):
        src, key, own, dx, dy = row
        state, made = mask_step(last, key, own, dx, dy, every)
        return state, [(src, *made)]

    return ordered_fold(frames, by="src", order=["key"], start=lambda: None, step=step, schema="src long, key long, mask string, coverage double, delta double, stability double, score double")
