"""A lit cloud of given densities, marched through from a camera, tile by tile.

Each row brings its own densities, camera and scene depth. A batch of rows is marched together: every step moves all rays that are still inside their
box and not yet dark, so the work is that of the longest ray. Rays are independent of each other; a task holds one batch of frames.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LUMA = np.array([0.2126, 0.7152, 0.0722])


@dataclass(frozen=True)
class Nebula:
    """What the cloud, its light and the march are like. ``debug`` shows blue ratios (1), edges (2) or densities (3) instead of the picture."""

    fov: float = 60.0
    aspect: float = 1.0
    low: tuple[float, float, float] = (-4.0, -4.0, -4.0)
    high: tuple[float, float, float] = (4.0, 4.0, 4.0)
    frequency: float = 0.6
    octaves: int = 3
    lacunarity: float = 2.0
    gain: float = 0.5
    density_scale: float = 0.6
    time: float = 1.5
    wind: tuple[float, float, float] = (0.1, 0.0, 0.05)
    light: tuple[float, float, float] = (0.4, -1.0, 0.3)
    light_colour: tuple[float, float, float] = (1.0, 0.9, 0.8)
    ambient: float = 0.08
    scattering: float = 0.9
    absorption: float = 0.7
    phase: float = 0.35
    steps: int = 24
    shadow_steps: int = 3
    step: float = 0.6
    warm: tuple[float, float, float] = (1.0, 0.45, 0.2)
    cool: tuple[float, float, float] = (0.2, 0.35, 1.0)
    emission: float = 0.6
    hdr: float = 1.4
    debug: int = 0


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def _between(grids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Densities between the grid's values, which repeat beyond it. grids is (rows, n, n, n), p (rows, rays, 3)."""
    n = grids.shape[1]
    low = np.floor(p)
    f, i = p - low, low.astype(np.int64)
    row = np.arange(len(grids))[:, None]
    out = np.zeros(p.shape[:2])
    for corner in range(8):
        side = np.array([corner & 1, corner >> 1 & 1, corner >> 2 & 1])
        at = (i + side) % n
        out += np.prod(np.where(side, f, 1 - f), axis=-1) * grids[row, at[..., 0], at[..., 1], at[..., 2]]
    return out


def _density(grids: np.ndarray, p: np.ndarray, c: Nebula) -> np.ndarray:
    """Several octaves of the grid in the wind, each finer and weaker than the one before."""
    q = (p + np.array(c.wind) * c.time) * c.frequency
    total = sum(c.gain**k * _between(grids, q * c.lacunarity**k) for k in range(c.octaves))
    return np.maximum(0.0, total / sum(c.gain**k for k in range(c.octaves))) * c.density_scale


def _steepness(grids: np.ndarray, p: np.ndarray, c: Nebula) -> np.ndarray:
    """The slope of the coarsest octave by central differences."""
    eps = max(c.step * 0.75, 0.01)
    square = 0.0
    for axis in np.eye(3) * eps:
        square = square + (_between(grids, (p + axis) * c.frequency) - _between(grids, (p - axis) * c.frequency)) ** 2
    return np.sqrt(square) / max(2 * eps, 1e-3)


def _lit(grids: np.ndarray, p: np.ndarray, to_light: np.ndarray, c: Nebula) -> np.ndarray:
    """What is left of the light on its way to p: coarser steps until the box ends."""
    low, size = np.array(c.low), np.array(c.high) - np.array(c.low)
    depth, inside = np.zeros(p.shape[:2]), np.ones(p.shape[:2], bool)
    for k in range(c.shadow_steps):
        q = p + to_light * (c.step * 2 * (k + 1))
        share = (q - low) / size
        inside &= ((share >= 0) & (share <= 1)).all(axis=-1)
        depth += np.where(inside, _density(grids, q, c), 0.0) * (c.scattering + c.absorption) * c.step * 2
    return np.exp(-depth)


def _remap(x: np.ndarray) -> np.ndarray:
    """Middle densities, 0.3 to 0.6, spread by a logistic curve; the others stay."""
    curve = lambda u: 1 / (1 + np.exp(-8.0 * (u - 0.5)))
    spread = 0.30 + 0.30 * (curve((x - 0.30) / 0.30) - curve(0.0)) / max(1e-6, curve(1.0) - curve(0.0))
    return np.where((x >= 0.30) & (x < 0.60), spread, x)


def march(grids: np.ndarray, camera: np.ndarray, forward: np.ndarray, right: np.ndarray, up: np.ndarray, depth: np.ndarray, width: int, height: int, c: Nebula) -> np.ndarray:
    """Red, green, blue and alpha (rows, pixels, 4) of rows with cameras (rows, 3) and scene depths (rows, pixels), 1 being infinitely far."""
    y, x = np.divmod(np.arange(width * height), width)
    nx, ny = (x + 0.5) / width * 2 - 1, (y + 0.5) / height * 2 - 1
    tan = np.tan(c.fov * 0.5 * np.pi / 180)
    ray = _unit(forward[:, None] + right[:, None] * (nx * tan * c.aspect)[None, :, None] + up[:, None] * (ny * tan)[None, :, None])
    origin = camera[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (np.array(c.low) - origin) / ray, (np.array(c.high) - origin) / ray
    near, far = np.fmin(a, b).max(axis=-1), np.fmax(a, b).min(axis=-1)
    hit = (near <= far) & (far >= 0)
    far = np.minimum(far, np.where(depth < 1.0, depth * 100.0, 1e10))
    noise = 52.9829189 * np.modf(0.06711056 * x + 0.00583715 * y)[0]
    t = np.maximum(near, 0.0) + np.modf(noise)[0][None] * c.step

    to_light = _unit(-np.array(c.light))
    cos = (ray * to_light).sum(axis=-1)
    forward_share = np.maximum(0.0, cos) ** 6
    phase = (1 - c.phase**2) / (4 * np.pi * (1 + c.phase**2 - 2 * c.phase * cos) ** 1.5)
    light, scale = np.array(c.light_colour), max(c.density_scale, 1e-3)
    colour, left = np.zeros((*ray.shape[:2], 3)), np.ones(ray.shape[:2])
    edge, before, after, count = np.full(ray.shape[:2], 1e9), np.zeros(ray.shape[:2]), np.zeros(ray.shape[:2]), np.zeros(ray.shape[:2])
    for _ in range(c.steps):
        going = hit & (t < far) & (left > 0.01)
        if not going.any():
            break
        p = np.where(going[..., None], origin + ray * t[..., None], 0.0)
        raw = _density(grids, p, c)
        density = raw * (raw / (raw + 0.0015))
        pre = np.clip(density / scale, 0.0, 1.0)
        width_here = 1 / (1 + _steepness(grids, p, c) * 2.5)
        shaped = density * (pre / (pre + width_here * 0.45))
        post = _remap(np.clip(shaped / scale, 0.0, 1.0))
        final = post * scale
        scattering, absorption = c.scattering * (0.90 + 0.50 * post), c.absorption * (0.90 + 2.20 * post**2)
        extinction = (scattering + absorption) * final
        rim = (forward_share / (1 + extinction * 0.35))[..., None]
        scattered = (light * (1 - rim) + (light @ LUMA) * rim) * (_lit(grids, p, to_light, c) * phase * scattering * final)[..., None]
        emitted = np.array(c.cool) * (1 - post[..., None]) + np.array(c.warm) * post[..., None]
        apart = np.clip(0.06 * (post - 0.5), -0.03, 0.03)
        emitted = emitted * (1 - 0.85) + emitted * np.stack([1 + apart, np.ones_like(apart), 1 - apart], axis=-1) * 0.85
        luma = (scattered @ LUMA) * 6.0
        pull = (luma / (1 + luma))[..., None]
        emitted = emitted * (1 - pull) + (emitted @ LUMA)[..., None] * pull
        emission = emitted * (c.emission * (0.35 + 0.65 * (1 - post)) * final)[..., None]
        through = np.exp(-extinction * c.step)
        seen = (scattered + emission + light * (c.ambient * 0.95) * final[..., None]) * (1 - through)[..., None] * c.hdr
        on = going[..., None]
        colour += np.where(on, left[..., None] * seen, 0.0)
        left = np.where(going, left * through, left)
        edge = np.where(going, np.minimum(edge, width_here), edge)
        before += np.where(going, pre, 0.0)
        after += np.where(going, post, 0.0)
        count += going
        t = np.where(going, t + c.step, t)

    alpha = 1 - left
    total = np.maximum(1e-6, colour.sum(axis=-1))
    blue = colour[..., 2] / total
    excess = np.where((alpha > 0.40) & (blue > 0.65), colour[..., 2] - 0.65 * total, 0.0)
    colour = colour + excess[..., None] * np.array([0.5, 0.5, -1.0])
    one, none = np.ones_like(alpha), np.zeros_like(alpha)
    if c.debug == 1:
        gate = alpha > 0.40
        out = np.stack([blue * gate, colour[..., 2] / np.maximum(1e-6, colour.sum(axis=-1)) * gate, none, one], axis=-1)
    elif c.debug == 2:
        out = np.stack([1 - edge, 0.25 + 0.75 * (1 - np.abs(edge - 0.5) * 2), edge, one], axis=-1)
    elif c.debug == 3:
        out = np.stack([before / np.maximum(1, count), after / np.maximum(1, count), none, one], axis=-1)
    else:
        out = np.concatenate([colour, alpha[..., None]], axis=-1)
    return np.where(hit[..., None], out, 0.0)


def render(rows: DataFrame, width: int, height: int, nebula: Nebula = Nebula()) -> DataFrame:
    """Rows (frame, density, side, camera, forward, right, up, depth) to (frame, rgba): four numbers for each pixel, by rows.

    ``density`` holds side cubed values; rows of one call have the same side. Rays that miss the box are transparent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 64) for at in range(0, whole.num_rows, 64)):
                of = lambda c: np.asarray(batch.column(c).flatten(), np.float64).reshape(batch.num_rows, -1)  # noqa: E731, B023
                side = batch.column("side")[0].as_py()
                out = march(of("density").reshape(-1, side, side, side), of("camera"), of("forward"), of("right"), of("up"), of("depth"), width, height, nebula)
                offsets = pa.array(np.arange(0, out.size + 1, width * height * 4, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("frame"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["frame", "rgba"])

    return rows.select("frame", "density", "side", "camera", "forward", "right", "up", "depth").mapInArrow(run, "frame long, rgba array<double>")
