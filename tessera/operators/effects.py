"""More image kernels: lens and camera effects, false colour, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.pixels import LUMA_709, Rgb, clamp, dot, grid, mix, source

# A colour map's polynomials, lowest power first.
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)


def gradient_noise(x: Column, y: Column) -> Column:
    """A dither value in [0, 1) for a pixel; its numbers are fixed values."""
    inner = x * 0.06711056 + y * 0.00583715
    outer = (inner - F.floor(inner)) * 52.9829189
    return outer - F.floor(outer)


def bloom_prefilter(threshold: float = 0.4, knee: float = 0.2, most: float = 0.9) -> Rgb:
    """What is brighter than a threshold with a soft knee, by the largest channel."""
    c = source().each(lambda x: F.least(x, F.lit(most)))
    bright = F.greatest(*c)
    soft = clamp(bright - threshold + knee, 0.0, 2 * knee)
    gain = F.greatest(soft * soft / (4 * knee + 1e-4), bright - threshold) / F.greatest(bright, F.lit(1e-4))
    return c.each(lambda x: x * gain)


def bloom_composite(intensity: float = 0.5) -> Rgb:
    """The bloom of the second frame added, with dither."""
    dither = (gradient_noise(F.col("x"), F.col("y")) - 0.5) / 255.0
    return Rgb(*[F.col(c) + F.col(c + "2") * intensity + dither for c in "rgb"])


def vignette(sensor: float = 36.0, focal: float = 35.0, intensity: float = 0.8, smoothness: float = 0.5, roundness: float = 0.6, width: int = 8, height: int = 8) -> Rgb:
    """Illumination falling off with the angle to the axis, with dither."""
    aspect = width / height
    px = F.abs(((F.col("x") + 0.5) / width - 0.5) * sensor)
    py = F.abs(((F.col("y") + 0.5) / height - 0.5) * (sensor / aspect))
    d = mix(F.greatest(px, py), F.sqrt(px * px + py * py), roundness)
    fall = F.pow(F.lit(focal) / F.sqrt(d * d + focal * focal), 10.0 * (1 - smoothness) + 2.0 * smoothness)
    dither = (gradient_noise(F.col("x"), F.col("y")) - 0.5) * 0.002
    return source().each(lambda c: c * (fall * intensity + (1 - intensity)) + dither)


def false_color(exposure: float = 0.2, gamma: float = 1.2) -> Rgb:
    """Luma through a colour map; what isn't finite is black."""
    finite = source().each(lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c))
    t = clamp(F.pow(F.greatest(dot(finite, LUMA_709), F.lit(0.0)) * 2.0**exposure, 1 / max(gamma, 1e-6)))
    poly = lambda k: sum((F.pow(t, i) * v for i, v in enumerate(k)), F.lit(0.0))
    return Rgb(*[clamp(poly(k)) for k in TURBO])


def hlg_output() -> Rgb:
    """Hybrid log-gamma of scene light; its numbers are fixed values of the standard."""
    return source().each(lambda c: F.when(c <= 1 / 12, F.sqrt(F.greatest(c, F.lit(0.0)) * 3)).otherwise(F.log(F.greatest(c * 12 - 0.28466892, F.lit(1e-9))) * 0.17883277 + 0.55991073))


def _sampled(frames: DataFrame, at: DataFrame, channel: str, width: int, height: int) -> DataFrame:
    """One channel of every frame read bilinearly at (u, v) of each (x, y), edges clamped."""
    sx, sy = F.col("u") * width - 0.5, F.col("v") * height - 0.5
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("k")
    taps = at.select("x", "y", sx.alias("sx"), sy.alias("sy")).select("x", "y", "sx", "sy", corner)
    inside = lambda c, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), c)).cast("int")
    fx, fy = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    w = F.when(F.col("k.i") == 1, fx).otherwise(1 - fx) * F.when(F.col("k.j") == 1, fy).otherwise(1 - fy)
    taps = taps.select("x", "y", inside(F.floor("sx") + F.col("k.i"), width).alias("px"), inside(F.floor("sy") + F.col("k.j"), height).alias("py"), w.alias("w"))
    p = frames.select("frame", F.col("x").alias("px"), F.col("y").alias("py"), F.col(channel).alias("c"))
    return p.join(taps, ["px", "py"]).groupBy("frame", "x", "y").agg(F.sum(F.col("w") * F.col("c")).alias(channel))


def lens(frames: DataFrame, k1: float = 0.3, k2: float = 0.1, aberration: float = 0.2, width: int = 8, height: int = 8) -> DataFrame:
    """Radial distortion with red and blue shifted apart; what comes from outside is black."""
    p = grid(frames.sparkSession, width, height).withColumn("cx", F.col("x") / width - 0.5).withColumn("cy", F.col("y") / height - 0.5)
    p = p.withColumn("r2", F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy")).withColumn("scale", 1 - F.col("r2") * k1 - F.col("r2") * F.col("r2") * k2)
    out = None
    for c, side in (("r", -1), ("g", 0), ("b", 1)):
        s = F.col("scale") * (F.col("r2") * (side * aberration) + 1)
        one = _sampled(frames, p.select("x", "y", (F.col("cx") * s + 0.5).alias("u"), (F.col("cy") * s + 0.5).alias("v")), c, width, height)
        out = one if out is None else out.join(one, ["frame", "x", "y"])
    u, v = F.col("cx") * F.col("scale") + 0.5, F.col("cy") * F.col("scale") + 0.5
    edge = p.select("x", "y", ((u < 0) | (u > 1) | (v < 0) | (v > 1)).alias("outside"))
    return out.join(edge, ["x", "y"]).select("frame", "x", "y", *[F.when(F.col("outside"), 0.0).otherwise(F.col(c)).alias(c) for c in "rgb"])


def _catmull(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a <= 1, a * a * a * 1.5 - a * a * 2.5 + 1).when(a < 2, a * a * a * -0.5 + a * a * 2.5 - a * 4 + 2).otherwise(0.0)


def bicubic_resize(frames: DataFrame, width: int, height: int, size: int = 8) -> DataFrame:
    """Resample with 16 Catmull-Rom taps at pixel centres, weights normalised, edges clamped."""
    sx, sy = (F.col("x") + 0.5) / width * size - 0.5, (F.col("y") + 0.5) / height * size - 0.5
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-1, 3) for j in range(-1, 3)])).alias("k")
    at = grid(frames.sparkSession, width, height).select("x", "y", sx.alias("sx"), sy.alias("sy")).select("x", "y", "sx", "sy", corner)
    inside = lambda c: F.least(F.lit(size - 1), F.greatest(F.lit(0), c)).cast("int")
    w = _catmull(F.col("k.i") - (F.col("sx") - F.floor("sx"))) * _catmull(F.col("k.j") - (F.col("sy") - F.floor("sy")))
    taps = at.select("x", "y", inside(F.floor("sx") + F.col("k.i")).alias("px"), inside(F.floor("sy") + F.col("k.j")).alias("py"), w.alias("w"))
    p = frames.select("frame", F.col("x").alias("px"), F.col("y").alias("py"), "r", "g", "b")
    total = F.sum("w")
    return p.join(taps, ["px", "py"]).groupBy("frame", "x", "y").agg(*[F.when(total > 1e-6, F.sum(F.col("w") * F.col(c)) / total).otherwise(F.sum(F.col("w") * F.col(c))).alias(c) for c in "rgb"])


def box_blur(frames: DataFrame, radius: int = 1, size: int = 8) -> DataFrame:
    """The mean over a square, rows first and then columns, edges repeated."""
    out = frames
    for axis, other in (("x", "y"), ("y", "x")):
        step = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("d")
        t = out.select("frame", "x", "y", step).withColumn("s", F.least(F.lit(size - 1), F.greatest(F.lit(0), F.col(axis) + F.col("d"))))
        n = out.select("frame", F.col(axis).alias("s"), other, "r", "g", "b")
        out = t.join(n, ["frame", "s", other]).groupBy("frame", "x", "y").agg(*[F.avg(c).alias(c) for c in "rgb"])
    return out


def asinh_stretch(low: float = 0.1, high: float = 0.9, alpha: float = 5.0) -> Rgb:
    scale = math.asinh(alpha)
    return source().each(lambda c: F.asinh(clamp((c - low) / (high - low)) * alpha) / scale)


POINT_EFFECTS = {f.__name__: f for f in (bloom_prefilter, vignette, false_color, hlg_output, asinh_stretch)}
