"""Colour work in steps: lightness models, log encoding, viewing transforms for both displays, tables, keyed grades.

Kernels here take and give pixel tables (frame, x, y, r, g, b). Each step is a projection of its own, so that
its terms are computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.pixels import ACESCG_TO_REC709, LUMA_709, LUMA_AP1, Rgb, clamp, dot, matrix, mix, pq_encode, smoothstep, source, srgb_encode

# A gamut matrix by row, luma weights and the log curve's constants.
ACESCG_TO_REC2020 = ((1.0258247, -0.0200532, -0.0057716), (-0.0022344, 1.0045865, -0.0023521), (-0.0050134, -0.0252901, 1.0303034))
LUMA_2020 = (0.2627, 0.6780, 0.0593)
CCT_LINEAR, CCT_LOG, CCT_SLOPE, CCT_OFFSET = 0.0078125, 0.155251141552511, 10.5402377416545, 0.0729055341958355


def step(frames: DataFrame, out: Rgb) -> DataFrame:
    return frames.withColumns(dict(zip("rgb", out)))


def zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def with_hsl(frames: DataFrame) -> DataFrame:
    """Add hue, saturation and lightness (h, s, l)."""
    q = frames.withColumn("top", F.greatest("r", "g", "b")).withColumn("low", F.least("r", "g", "b"))
    top, low, d = F.col("top"), F.col("low"), F.col("top") - F.col("low")
    s = F.when(d == 0, 0.0).when((top + low) / 2 > 0.5, d / (2 - top - low)).otherwise(d / (top + low))
    red = (F.col("g") - F.col("b")) / d + F.when(F.col("g") < F.col("b"), 6.0).otherwise(0.0)
    h = F.when(d == 0, 0.0).when(top == F.col("r"), red).when(top == F.col("g"), (F.col("b") - F.col("r")) / d + 2).otherwise((F.col("r") - F.col("g")) / d + 4) / 6
    return q.withColumns({"h": h, "s": s, "l": (top + low) / 2}).drop("top", "low")


def from_hsl(frames: DataFrame) -> DataFrame:
    """Channels from (h, s, l), which go."""
    high = F.when(F.col("l") < 0.5, F.col("l") * (F.col("s") + 1)).otherwise(F.col("l") + F.col("s") - F.col("s") * F.col("l"))
    q = frames.withColumn("high", high).withColumn("base", F.col("l") * 2 - F.col("high"))
    turned = {n: F.col("h") + k / 3 for n, k in (("r", 1), ("g", 0), ("b", -1))}
    q = q.withColumns({"h" + n: F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t) for n, t in turned.items()})

    def channel(n: str) -> Column:
        t, rise = F.col("h" + n), F.col("high") - F.col("base")
        ramp = F.when(t * 6 < 1, F.col("base") + rise * t * 6).when(t * 2 < 1, F.col("high")).when(t * 3 < 2, F.col("base") + rise * (2 / 3 - t) * 6).otherwise(F.col("base"))
        return F.when(F.col("s") == 0, F.col("l")).otherwise(ramp)

    return step(q, Rgb(*map(channel, "rgb"))).drop("high", "base", "hr", "hg", "hb", "h", "s", "l")


def cct_encode(x: Column) -> Column:
    """The log encoding; 9.72 and 17.52 are fixed values of it like those above."""
    return F.when(x <= CCT_LINEAR, x * CCT_SLOPE + CCT_OFFSET).otherwise((F.log2(F.greatest(x, F.lit(CCT_LINEAR))) + 9.72) / 17.52)


def cct_decode(x: Column) -> Column:
    return F.when(x <= CCT_LOG, (x - CCT_OFFSET) / CCT_SLOPE).otherwise(F.pow(F.lit(2.0), x * 17.52 - 9.72))


def fitted_curve(x: Column) -> Column:
    """The fitted rendering curve; its numbers are fixed values."""
    return (x * (x + 0.0245786) - 0.000090537) / (x * (x * 0.983729 + 0.4329510) + 0.238081)


def _spread(luma: str = "luma") -> Column:
    return F.sqrt(sum((F.pow(F.col(c) - F.col(luma), 2) for c in "rgb"), F.lit(0.0)))


def _red_lead() -> Column:
    return smoothstep(0.0, 0.25, F.col("r") - F.greatest("g", "b"))


def sweeten(frames: DataFrame, highlights: float = 0.12, reds: float = 0.06) -> DataFrame:
    """Take colour out of highlights, and pull strong reds towards luma."""
    q = frames.withColumn("luma", dot(source(), LUMA_AP1)).withColumn("high", smoothstep(1.0, 4.0, zero(F.col("luma"))) * highlights)
    q = step(q, source().each(lambda c: mix(c, F.col("luma"), F.col("high"))))
    q = q.withColumn("pull", _red_lead() * smoothstep(0.03, 0.25, _spread()) * reds)
    return q.withColumn("r", mix(F.col("r"), F.col("luma"), F.col("pull"))).drop("luma", "high", "pull")


def rendering(frames: DataFrame) -> DataFrame:
    """The reference rendering before a display: glow, red modifier, sweetening, fitted curve."""
    q = step(frames, source().each(zero)).withColumn("luma", dot(source(), LUMA_AP1))
    q = q.withColumn("gain", smoothstep(0.02, 0.20, _spread()) * smoothstep(0.10, 2.0, F.col("luma")) * 0.06 + 1)
    q = step(q, source().each(lambda c: c * F.col("gain"))).withColumn("luma", dot(source(), LUMA_AP1))
    q = q.withColumn("pull", _red_lead() * smoothstep(0.02, 0.25, _spread()) * smoothstep(0.10, 3.0, F.col("luma")) * 0.10)
    q = q.withColumn("r", mix(F.col("r"), F.col("luma"), F.col("pull"))).drop("luma", "gain", "pull")
    return step(sweeten(q), source().each(fitted_curve))


def compress_chroma(frames: DataFrame, weights: tuple[float, float, float], threshold: Column, limit: Column, strength: Column) -> DataFrame:
    """Saturation relative to luma beyond ``threshold`` bends towards ``limit``; luma stays."""
    q = frames.withColumns({"luma": dot(source(), weights), "threshold": threshold, "limit": limit, "strength": clamp(strength)})
    q = q.withColumn("sat", _spread() / F.greatest(F.col("luma"), F.lit(1e-4)))
    over, room = F.col("sat") - F.col("threshold"), F.greatest(F.col("limit") - F.col("threshold"), F.lit(1e-3))
    bent = F.when(F.col("sat") <= F.col("threshold"), F.col("sat")).otherwise(F.col("threshold") + over * room / (over + room))
    q = q.withColumn("scale", F.when(F.col("sat") > 1e-6, bent / F.col("sat")).otherwise(1.0))
    squeezed = source().each(lambda c: mix(c, F.col("luma") + (c - F.col("luma")) * F.col("scale"), F.col("strength")))
    return step(q, squeezed.each(zero)).drop("luma", "threshold", "limit", "strength", "sat", "scale")


def to_rec709(frames: DataFrame, *, gamut: float = 0.0, highlights: float = 0.12, reds: float = 0.06) -> DataFrame:
    """The viewing transform for standard displays, with its strengths."""
    q = step(sweeten(frames, highlights, reds), source().each(lambda c: fitted_curve(zero(c))))
    q = step(q, matrix(source(), ACESCG_TO_REC709))
    if gamut > 0:
        q = step(q, source().each(zero)).withColumn("bright", smoothstep(0.25, 1.0, dot(source(), LUMA_AP1)))
        limit = mix(F.lit(2.4), F.lit(1.35), F.col("bright"))
        q = compress_chroma(q, LUMA_AP1, limit * 0.85, limit, F.lit(gamut)).drop("bright")
    q = step(q, source().each(clamp))
    return step(q, source().each(lambda c: clamp(srgb_encode(c))))


def to_pq(frames: DataFrame, nits: float = 1000.0) -> DataFrame:
    """The viewing transform for HDR displays of ``nits``."""
    q = step(step(rendering(frames), matrix(source(), ACESCG_TO_REC2020)), source().each(zero))
    q = step(q, source().each(zero)).withColumn("bright", smoothstep(100.0, 600.0, dot(source(), LUMA_2020) * (nits / 10)) * 0.60)
    q = compress_chroma(q, LUMA_2020, F.lit(1.20), F.lit(1.50), F.col("bright")).drop("bright")
    return step(q, source().each(lambda c: pq_encode(c * (nits / 100000))))


def to_pq_tuned(frames: DataFrame, nits: float = 1000.0, scale: float = 0.12, highlights: float = 0.3, knee: float = 800.0, gamut: float = 0.7) -> DataFrame:
    """The same with its own strengths: chroma, highlights, scale and a knee in nits."""
    q = step(step(rendering(frames), matrix(source(), ACESCG_TO_REC2020)), source().each(zero))
    if gamut > 0:
        q = q.withColumn("bright", smoothstep(100.0, 600.0, dot(source(), LUMA_2020) * nits * scale) * min(1.0, gamut))
        q = compress_chroma(q, LUMA_2020, F.lit(1.20), F.lit(1.50), F.col("bright")).drop("bright")
    q = q.withColumn("luma", dot(source(), LUMA_2020)).withColumn("fade", clamp(clamp(F.col("luma")) * highlights))
    q = step(q, source().each(lambda c: mix(c, F.col("luma"), F.col("fade"))))
    q = q.withColumn("luma", dot(source(), LUMA_2020)).withColumn("gain", mix(F.lit(0.10), F.lit(scale), smoothstep(0.02, 0.20, F.col("luma"))) * nits)
    q = step(q, source().each(lambda c: c * F.col("gain"))).drop("luma", "fade", "gain")
    return step(q, source().each(lambda c: pq_encode(c / (c / max(knee, 1.0) + 1) / 10000)))


def keyed_grade(frames: DataFrame, *, key: tuple[float, float, float] | None = None, mask: Column | None = None, tolerance: float = 0.1, softness: float = 0.2, invert: bool = False, hue: float = 0.0, saturation: float = 1.0, exposure: float = 0.0) -> DataFrame:
    """Exposure, a hue shift and saturation where a mask or the nearness to a key colour says so."""
    if mask is None:
        far = F.greatest(*[F.abs(c - k) for c, k in zip(source(), key)])
        mask = 1 - smoothstep(tolerance, tolerance + softness, far)
    q = frames.withColumns({"mask": 1 - mask if invert else mask, "r0": F.col("r"), "g0": F.col("g"), "b0": F.col("b")})
    q = with_hsl(step(q, source().each(lambda c: c * 2.0**exposure))).withColumn("h", F.col("h") + hue)
    q = from_hsl(q.withColumn("h", F.when(F.col("h") > 1, F.col("h") - 1).when(F.col("h") < 0, F.col("h") + 1).otherwise(F.col("h"))))
    q = q.withColumn("luma", dot(source(), LUMA_AP1))
    q = step(q, Rgb(*[mix(F.col(c + "0"), mix(F.col("luma"), F.col(c), saturation), F.col("mask")) for c in "rgb"]))
    return q.drop("mask", "luma", "r0", "g0", "b0")


def _trilinear(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Channels looked up between the eight nearest entries of ``table`` (red, green, blue, channel)."""
    n = len(table)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([np.asarray(batch.column(c)) for c in "rgb"], axis=1).clip(0, 1)
            at = (p * n - 0.5).clip(0, n - 1)  # entries stand at the middle of their cells
            low = np.floor(at).astype(int)
            high, f = np.minimum(low + 1, n - 1), at - low
            out = np.zeros_like(p)
            for corner in range(8):
                pick = [(corner >> k) & 1 for k in range(3)]
                i, j, k = (np.where(side, high[:, a], low[:, a]) for a, side in enumerate(pick))
                weight = np.prod([f[:, a] if side else 1 - f[:, a] for a, side in enumerate(pick)], axis=0)
                out += weight[:, None] * table[i, j, k]
            changed = dict(zip("rgb", out.T))
            yield pa.RecordBatch.from_arrays([pa.array(changed[c]) if c in changed else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return look_up


def apply_table(frames: DataFrame, table: np.ndarray) -> DataFrame:
    """A three-dimensional table on every pixel; ``table`` is bounded by its file format and travels with the tasks."""
    return frames.mapInArrow(_trilinear(np.asarray(table, float)), frames.schema)


def apply_table_in_log(frames: DataFrame, table: np.ndarray, intensity: float = 1.0) -> DataFrame:
    """A table made for the log encoding, mixed with the picture."""
    q = frames.withColumns({c + "0": F.col(c) for c in "rgb"})
    q = apply_table(step(q, source().each(cct_encode)), table)
    return step(q, Rgb(*[mix(F.col(c + "0"), cct_decode(F.col(c)), intensity) for c in "rgb"])).drop("r0", "g0", "b0")


def layers_over(layers: list[str], alphas: list[float]) -> Rgb:
    """Layers with channels (r, g, b) followed by each name, from the bottom up."""

    def channel(c: str) -> Column:
        out = F.lit(0.0)
        for name, alpha in zip(layers, alphas):
            out = out * (1 - alpha) + F.col(c + name) * alpha
        return out

    return Rgb(*map(channel, "rgb"))


def volumetric_over(pixels: DataFrame) -> DataFrame:
    """A premultiplied medium (r2, g2, b2, a2) over a scene, which loses a little of its stars and gains a
    halo where the medium's alpha changes between neighbours."""
    across, down = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    change = sum((F.abs(F.coalesce(F.lead("a2").over(w), "a2") - F.coalesce(F.lag("a2").over(w), "a2")) for w in (across, down)), F.lit(0.0))
    luma = dot(source(), LUMA_709)
    q = pixels.withColumns({"change": change, "star": luma / (luma + 0.08)}).withColumn("edge", F.col("change") / (F.col("change") + 0.15) * F.col("star"))
    kept = (1 - F.col("edge") * (F.col("a2") * 0.75 + 0.25) * 0.05) * (1 - F.col("a2"))
    return q.select("frame", "x", "y", *[(F.col(c + "2") * (F.col("edge") * 0.03 + 1) + F.col(c) * kept).alias(c) for c in "rgb"])


def whiten(frames: DataFrame, inside: Column, strength: float) -> DataFrame:
    """Less saturation, more brightness and contrast in a region; a strength near zero changes nothing."""
    s = min(1.0, max(0.0, strength))
    if s < 1e-6:
        return frames
    q = frames.withColumn("luma", dot(source(), LUMA_709))
    changed = source().each(lambda c: (mix(F.col("luma"), c, 1 - 0.25 * s) + 0.05 * s - 0.5) * (1 + 0.06 * s) + 0.5)
    return step(q, Rgb(*[F.when(inside, n).otherwise(c) for n, c in zip(changed, source())])).drop("luma")


def band_composite(bands: DataFrame, weights: tuple[tuple[float, ...], ...], *, exposure: float = 1.2, contrast: float = 1.1, saturation: float = 1.15, gamma: float = 2.2) -> DataFrame:
    """Bands b0, b1... of pixels (frame, x, y) to channels: weighted sums, each divided by its frame's largest,
    exposure, an exponential shoulder, contrast, saturation, gamma."""
    mixed = {n: sum((F.col(f"b{i}") * w for i, w in enumerate(row)), F.lit(0.0)) for n, row in zip("rgb", weights)}
    q = bands.withColumns(mixed)
    most = q.groupBy("frame").agg(F.greatest(*[F.max(c) for c in "rgb"], F.lit(1e-6)).alias("most"))
    q = step(q.join(most, "frame"), source().each(lambda c: 1 - F.exp(-(zero(c) / F.col("most")) * exposure)))
    q = step(q, source().each(lambda c: clamp((c - 0.5) * contrast + 0.5))).withColumn("luma", dot(source(), LUMA_709))
    q = step(q, source().each(lambda c: clamp(mix(F.col("luma"), c, saturation))))
    return step(q, source().each(lambda c: F.pow(c, 1 / gamma))).select("frame", "x", "y", "r", "g", "b")
