"""Kernels that read many places of a frame: frames are rows with one array a channel, so that no pixel is
joined to another. Arrays go through Arrow to numpy, a bounded number of pixels at a time.

A kernel maps images (frame, y, x, channel) to images. Positions are in pixels from the first one's centre;
what lies outside repeats the edge.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.pixels import LUMA_709, LUMA_AP1

Images = np.ndarray
Kernel = Callable[[Images], Images]
# Fixed value: the turn between two taps of a spiral.
GOLDEN = 2.39996323
_PIXELS_AT_ONCE = 1 << 20


def apply(frames: DataFrame, kernel: Kernel, width: int, height: int) -> DataFrame:
    """``frames`` (frame, r, g, b, more channels) with every channel an array by rows; the kernel sees all of
    them and returns three. Result: frame, width, height, r, g, b."""
    channels = [c for c in frames.columns if c != "frame"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = max(1, _PIXELS_AT_ONCE // (width * height))
            for at in range(0, batch.num_rows, some):
                part = batch.slice(at, some)
                images = np.stack([np.asarray(part.column(c).flatten(), float).reshape(-1, height, width) for c in channels], axis=-1)
                out = kernel(images)
                n, h, w, _ = out.shape
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (h * w))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(out[..., k]).ravel())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column("frame"), pa.array(np.full(n, w, np.int32)), pa.array(np.full(n, h, np.int32)), *lists], names=["frame", "width", "height", "r", "g", "b"])

    return frames.mapInArrow(run, "frame long, width int, height int, r array<double>, g array<double>, b array<double>")


def to_pixels(frames: DataFrame) -> DataFrame:
    """A row for each pixel of the frames that ``apply`` returns."""
    each = frames.select("frame", "width", F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "p"))
    return each.select("frame", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), "p.r", "p.g", "p.b")


def sample(images: Images, sx: np.ndarray, sy: np.ndarray) -> Images:
    """Bilinear reads at positions (y, x), the same in all frames."""
    h, w = images.shape[1:3]
    x, y = np.floor(sx), np.floor(sy)
    fx, fy = (sx - x)[..., None], (sy - y)[..., None]
    left, right = (np.clip(x + k, 0, w - 1).astype(int) for k in (0, 1))
    up, down = (np.clip(y + k, 0, h - 1).astype(int) for k in (0, 1))
    top = images[:, up, left] * (1 - fx) + images[:, up, right] * fx
    low = images[:, down, left] * (1 - fx) + images[:, down, right] * fx
    return top * (1 - fy) + low * fy


def places(width: int, height: int, of_width: int | None = None, of_height: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the centres of a frame's pixels lie in one of another size."""
    x = (np.arange(width) + 0.5) / width * (of_width or width) - 0.5
    y = (np.arange(height) + 0.5) / height * (of_height or height) - 0.5
    return np.broadcast_to(x, (height, width)), np.broadcast_to(y[:, None], (height, width))


def spiral(radius: float) -> list[tuple[float, float]]:
    n = int(min(32, max(8, math.ceil(radius * 1.25))))
    return [(math.sqrt((i + 0.5) / n) * radius * math.cos(GOLDEN * i), math.sqrt((i + 0.5) / n) * radius * math.sin(GOLDEN * i)) for i in range(n)]


def bokeh(radius: float) -> Kernel:
    """Taps on a spiral, bright ones with more weight."""

    def kernel(images: Images) -> Images:
        if radius < 0.5:
            return images
        sx, sy = places(images.shape[2], images.shape[1])
        total, weights = 0.0, 0.0
        for dx, dy in spiral(radius):
            tap = sample(images, sx + dx, sy + dy)
            weight = 1 + 4 * (tap @ np.array(LUMA_AP1))[..., None]
            total, weights = total + tap * weight, weights + weight
        return total / weights

    return kernel


def pyramid(images: Images) -> list[Images]:
    """Halves of halves, each pixel the mean of four (of two or one at odd ends)."""
    out = [images]
    while max(out[-1].shape[1:3]) > 1:
        last = out[-1]
        h, w = max(1, last.shape[1] // 2), max(1, last.shape[2] // 2)
        rows = np.stack([np.minimum(np.arange(h) * 2 + k, last.shape[1] - 1) for k in (0, 1)])
        cols = np.stack([np.minimum(np.arange(w) * 2 + k, last.shape[2] - 1) for k in (0, 1)])
        out.append(sum(last[:, rows[a]][:, :, cols[b]] for a in (0, 1) for b in (0, 1)) / 4)
    return out


def _between_levels(levels: list[Images], lod: float, width: int, height: int) -> Images:
    low = min(int(lod), len(levels) - 1)
    high = min(low + 1, len(levels) - 1)
    one, two = (sample(levels[k], *places(width, height, levels[k].shape[2], levels[k].shape[1])) for k in (low, high))
    return one + (two - one) * (lod - low)


def mip_blur(radius: float) -> Kernel:
    """One read between two levels of the pyramid, chosen by the radius."""

    def kernel(images: Images) -> Images:
        if radius < 0.5:
            return images
        levels = pyramid(images)
        return _between_levels(levels, min(math.log2(max(radius, 1.0)), len(levels) - 1), images.shape[2], images.shape[1])

    return kernel


def masked_blur(radius: float, threshold: float) -> Kernel:
    """Channels r, g, b and a mask: the more mask, the blurrier level of the half-sized frame and the more of it."""

    def kernel(images: Images) -> Images:
        sharp, mask = images[..., :3], images[..., 3]
        levels = pyramid(sharp)[1:] or [sharp]
        m = np.clip((mask - threshold) / max(1 - threshold, 1e-6), 0, 1)
        lod = m * min(math.log2(max(radius, 1.0)), len(levels) - 1)
        h, w = sharp.shape[1:3]
        stack = np.stack([sample(x, *places(w, h, x.shape[2], x.shape[1])) for x in levels])
        low = np.minimum(lod.astype(int), len(levels) - 1)
        high = np.minimum(low + 1, len(levels) - 1)
        n, y, x = np.indices(mask.shape)
        one, two = stack[low, n, y, x], stack[high, n, y, x]
        blurred = one + (two - one) * (lod - low)[..., None]
        return np.where((mask < threshold)[..., None], sharp, sharp + (blurred - sharp) * m[..., None])

    return kernel


def spectral_blur(radius: float, scales: tuple[float, float, float], reach: int = 16) -> Kernel:
    """Along x with a width for each channel, each pixel's taps moved by a dither."""
    sigma = np.maximum(radius * np.array(scales) / 2, 0.01)

    def kernel(images: Images) -> Images:
        h, w = images.shape[1:3]
        sx, sy = places(w, h)
        x, y = np.meshgrid(np.arange(w), np.arange(h))
        inner = x * 0.06711056 + y * 0.00583715
        outer = (inner - np.floor(inner)) * 52.9829189
        jitter = (outer - np.floor(outer) - 0.5) * 0.5
        total, weights = 0.0, 0.0
        for i in range(-reach, reach + 1):
            at = i + jitter
            weight = np.exp(-(at[..., None] ** 2) / (2 * sigma**2))
            total, weights = total + sample(images, sx + at, sy) * weight, weights + weight
        return total / np.maximum(weights, 0.001)

    return kernel


# Offsets of a two-step filter with their weights.
DOWN_TAPS = [(2 * i, 2 * j, 0.125 if i == j == 0 else 0.0625 if i * j == 0 else 0.03125) for i in (-1, 0, 1) for j in (-1, 0, 1)] + [(i, j, 0.125) for i in (-1, 1) for j in (-1, 1)]


def bloom_down(images: Images) -> Images:
    """Half the size by thirteen taps."""
    h, w = images.shape[1:3]
    sx, sy = places(max(1, w // 2), max(1, h // 2), w, h)
    return sum(sample(images, sx + dx, sy + dy) * weight for dx, dy, weight in DOWN_TAPS)


def up_taps(radius: float, taps: int = 12) -> list[tuple[float, float, float]]:
    reach = [(math.sqrt(i / taps) * radius, GOLDEN * i) for i in range(1, taps + 1)]
    return [(0.0, 0.0, 1.0)] + [(r * math.cos(a), r * math.sin(a), math.exp(-(r * r) / 0.5)) for r, a in reach]


def bloom_up(radius: float, weight: float) -> Kernel:
    """The frame and its half-sized form, spread by taps on a spiral, added."""

    def kernel(images: Images) -> Images:
        h, w = images.shape[1:3]
        small = bloom_down(images)
        sx, sy = places(w, h, small.shape[2], small.shape[1])
        taps = up_taps(radius)
        spread = sum(sample(small, sx + dx, sy + dy) * k for dx, dy, k in taps) / sum(k for *_, k in taps)
        return images + spread * weight

    return kernel


def _ramp(a: float, b: float, x: np.ndarray) -> np.ndarray:
    t = np.clip((x - a) / (b - a), 0, 1)
    return t * t * (3 - 2 * t)


def skin_weight(images: Images) -> np.ndarray:
    """How much a colour is like skin: an ellipse of two colour differences, within a range of luma. Its numbers are fixed values."""
    r, g, b = np.moveaxis(images, -1, 0)
    luma = images @ np.array(LUMA_709)
    cb, cr = -0.1146 * r - 0.3854 * g + 0.5 * b + 0.5, 0.5 * r - 0.4542 * g - 0.0458 * b + 0.5
    far = np.hypot((cb - 0.38) / 0.14, (cr - 0.56) / 0.18)
    return (1 - _ramp(0.5, 1.3, far)) * _ramp(0.03, 0.15, luma) * (1 - _ramp(0.88, 0.98, luma))


def smooth_skin(images: Images, strength: float) -> Images:
    """The mean with four neighbours, each weighed by its likeness."""
    sx, sy = places(images.shape[2], images.shape[1])
    reach, sigma = 0.5 + strength * 0.5, 0.02 + strength * 0.03
    total, weights = images, 1.0
    for dx, dy in ((-reach, 0), (reach, 0), (0, -reach), (0, reach)):
        tap = sample(images, sx + dx, sy + dy)
        weight = 0.25 * np.exp(-((tap - images) ** 2).sum(axis=-1, keepdims=True) / (2 * sigma * sigma))
        total, weights = total + tap * weight, weights + weight
    return total / weights


def beauty(smoothing: float, intensity: float) -> Kernel:
    k, s = min(1.0, max(0.0, intensity)), min(1.0, max(0.0, smoothing))

    def kernel(images: Images) -> Images:
        if k < 0.001 or s < 0.001:
            return images
        skin = skin_weight(images)[..., None]
        changed = images + (smooth_skin(images, s) - images) * (skin * k * (0.25 + 0.55 * s))
        return np.where(skin < 0.01, images, changed)

    return kernel


def _to_hsl(p: Images) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    top, low = p.max(axis=-1), p.min(axis=-1)
    d, lightness = top - low, (top + low) / 2
    safe = np.where(d == 0, 1, d)
    half = np.where(lightness > 0.5, 2 - top - low, top + low)
    s = np.where(d == 0, 0, d / np.where(half == 0, 1, half))
    r, g, b = np.moveaxis(p, -1, 0)
    h = np.where(top == r, (g - b) / safe + np.where(g < b, 6, 0), np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    return np.where(d == 0, 0, h), s, lightness


def _from_hsl(h: np.ndarray, s: np.ndarray, lightness: np.ndarray) -> Images:
    high = np.where(lightness < 0.5, lightness * (1 + s), lightness + s - s * lightness)
    base = 2 * lightness - high
    out = []
    for shift in (1 / 3, 0, -1 / 3):
        t = h + shift
        t = np.where(t < 0, t + 1, np.where(t > 1, t - 1, t))
        ramp = np.where(6 * t < 1, base + (high - base) * 6 * t, np.where(2 * t < 1, high, np.where(3 * t < 2, base + (high - base) * (2 / 3 - t) * 6, base)))
        out.append(np.where(s == 0, lightness, ramp))
    return np.stack(out, axis=-1)


def face_enhance(smoothing: float, correction: float, intensity: float) -> Kernel:
    """Channels r, g, b and a face mask: smoothed skin, hues drawn towards skin's."""

    def kernel(images: Images) -> Images:
        colour, mask = images[..., :3], images[..., 3:]
        both = np.sqrt(mask * np.maximum(skin_weight(colour)[..., None], 0.3))
        out = colour
        if smoothing > 0.01:
            out = out + (smooth_skin(colour, smoothing) - out) * (both * smoothing * 0.4)
        if correction > 0.01:
            h, s, lightness = _to_hsl(out)
            off = h - 0.08
            off = np.where(off > 0.5, off - 1, np.where(off < -0.5, off + 1, off))
            turned = h - off * correction * 0.1
            turned = np.where(turned < 0, turned + 1, np.where(turned > 1, turned - 1, turned))
            corrected = out + (_from_hsl(turned, s, lightness) - out) * (both * correction * 0.3)
            out = np.where((np.abs(off) > 0.06)[..., None], corrected, out)
        changed = colour + (out - colour) * (intensity * mask)
        return np.where((mask < 0.01) | (intensity < 0.01), colour, changed)

    return kernel


def light_shafts(light: tuple[float, float], *, density: float = 0.9, decay: float = 0.9, weight: float = 0.1, exposure: float = 1.2, samples: int = 12, depth: float = 0.4, tint: tuple[float, float, float] = (1.0, 0.9, 0.7)) -> Kernel:
    """Channels r, g, b and depth: light gathered on the way to its source, none behind what stands before it."""

    def kernel(images: Images) -> Images:
        h, w = images.shape[1:3]
        sx, sy = places(w, h)
        u, v = (sx + 0.5) / w, (sy + 0.5) / h
        step_x, step_y = (u - light[0]) / samples * density, (v - light[1]) / samples * density
        x, y = np.meshgrid(np.arange(w), np.arange(h))
        inner = x * 0.06711056 + y * 0.00583715
        outer = (inner - np.floor(inner)) * 52.9829189
        jitter = outer - np.floor(outer)
        u, v = u - step_x * jitter, v - step_y * jitter
        left, total = np.ones(images.shape[:3] + (1,)), 0.0
        for _ in range(min(100, samples)):
            u, v = u - step_x, v - step_y
            tap = sample(images, u * w - 0.5, v * h - 0.5)
            left = np.where(tap[..., 3:] < depth, 0.0, left)
            total = total + tap[..., :3] * (left * weight)
            left = left * decay
        return total * np.array(tint) * exposure

    return kernel
