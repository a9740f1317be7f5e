"""Image kernels over pixel tables (frame, x, y, r, g, b).

Point kernels are column expressions, compositors join two frames on their pixels, and stencils
join a table of taps. ``Rgb`` holds the three channels of one expression.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Gamut matrices by row, luma weights and colour tables.
REC709_TO_ACESCG = ((0.6131, 0.3395, 0.0474), (0.0702, 0.9164, 0.0134), (0.0206, 0.1096, 0.8698))
ACESCG_TO_REC709 = ((1.7049, -0.6217, -0.0833), (-0.1301, 1.1407, -0.0106), (-0.0240, -0.1289, 1.1530))
LUMA_709 = (0.2126, 0.7152, 0.0722)
LUMA_AP1 = (0.2722287, 0.6740818, 0.0536895)
MACBETH = (
    (0.092, 0.058, 0.042), (0.360, 0.237, 0.187), (0.095, 0.132, 0.254), (0.080, 0.119, 0.043), (0.179, 0.164, 0.353), (0.102, 0.368, 0.301),
    (0.547, 0.178, 0.032), (0.055, 0.077, 0.245), (0.392, 0.081, 0.099), (0.081, 0.037, 0.121), (0.360, 0.403, 0.043), (0.624, 0.312, 0.017),
    (0.023, 0.036, 0.208), (0.041, 0.231, 0.057), (0.310, 0.031, 0.033), (0.656, 0.527, 0.022), (0.372, 0.073, 0.228), (0.063, 0.271, 0.455),
    (0.889, 0.889, 0.889), (0.566, 0.566, 0.566), (0.351, 0.351, 0.351), (0.187, 0.187, 0.187), (0.085, 0.085, 0.085), (0.030, 0.030, 0.030),
)
BARS_TOP = ((0.75, 0.75, 0.75), (0.75, 0.75, 0.0), (0.0, 0.75, 0.75), (0.0, 0.75, 0.0), (0.75, 0.0, 0.75), (0.75, 0.0, 0.0), (0.0, 0.0, 0.75))
BARS_MIDDLE = ((0.0, 0.0, 0.75), (0.07, 0.07, 0.07), (0.75, 0.0, 0.75), (0.07, 0.07, 0.07), (0.0, 0.75, 0.75), (0.07, 0.07, 0.07), (0.75, 0.75, 0.75))
BARS_LOW = ((0.03, 0.1, 0.16), (1.0, 1.0, 1.0), (0.2, 0.0, 0.4), (0.05, 0.05, 0.05), (0.0, 0.0, 0.0), (0.05, 0.05, 0.05))


class Rgb(NamedTuple):
    r: Column
    g: Column
    b: Column

    def each(self, f: Callable[[Column], Column]) -> Rgb:
        return Rgb(*map(f, self))


def source() -> Rgb:
    return Rgb(F.col("r"), F.col("g"), F.col("b"))


def put(frames: DataFrame, out: Rgb) -> DataFrame:
    """The frames with new channels."""
    others = [c for c in frames.columns if c not in ("r", "g", "b")]
    return frames.select(*others, *[c.alias(n) for n, c in zip("rgb", out)])


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def dot(p: Rgb, w: tuple[float, float, float]) -> Column:
    return p.r * w[0] + p.g * w[1] + p.b * w[2]


def matrix(p: Rgb, m) -> Rgb:
    return Rgb(*[dot(p, row) for row in m])


def mix(a: Column, b: Column, t) -> Column:
    return a * (1 - t) + b * t


def smoothstep(a: float, b: float, x: Column) -> Column:
    t = clamp((x - a) / (b - a))
    return t * t * (3 - 2 * t)


def srgb_decode(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((F.greatest(x, F.lit(0.0)) + 0.055) / 1.055, 2.4))


def srgb_encode(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(F.greatest(x, F.lit(0.0)), 1 / 2.4) * 1.055 - 0.055)


def pq_encode(x: Column) -> Column:
    """ST 2084 of linear light with 1 at 10,000 nits; its numbers are fixed values."""
    p = F.pow(F.greatest(x, F.lit(0.0)), 2610 / 16384)
    return F.pow((p * (2413 / 4096 * 32) + 3424 / 4096) / (p * (2392 / 4096 * 32) + 1), 2523 / 4096 * 128)


def film(x: Column) -> Column:
    """A fitted film curve; its numbers are fixed values."""
    return clamp(x * (x * 2.51 + 0.03) / (x * (x * 2.43 + 0.59) + 0.14))


# Point kernels, with the parameters that the queries use as defaults.
def exposure_adjust(ev: float = 0.5) -> Rgb:
    return source().each(lambda c: c * 2.0**ev)


def contrast_adjust(factor: float = 1.2, pivot: float = 0.18) -> Rgb:
    return source().each(lambda c: (c - pivot) * factor + pivot)


def cdl_correct(slope: float = 1.1, offset: float = -0.02, power: float = 0.9, saturation: float = 1.2) -> Rgb:
    p = source().each(lambda c: F.pow(F.greatest(c * slope + offset, F.lit(0.0)), power))
    luma = dot(p, LUMA_AP1)
    return p.each(lambda c: luma + (c - luma) * saturation)


def idt_rec709_to_acescg() -> Rgb:
    return matrix(source().each(srgb_decode), REC709_TO_ACESCG)


def idt_linear_rec709_to_acescg() -> Rgb:
    return matrix(source(), REC709_TO_ACESCG)


def aces_tonemap() -> Rgb:
    return source().each(film)


def fx_tonemap_aces(exposure: float = 0.3) -> Rgb:
    p = matrix(source().each(lambda c: c * 2.0**exposure), ACESCG_TO_REC709)
    return p.each(lambda c: F.pow(film(c), 1 / 2.2))


def fx_color_grade_simple(exposure: float = 0.2, contrast: float = 1.1, saturation: float = 0.9, temperature: float = 0.3, tint: float = -0.2) -> Rgb:
    p = source().each(lambda c: mix(F.lit(0.5), c * 2.0**exposure, contrast))
    luma = dot(p, LUMA_709)
    p = p.each(lambda c: mix(luma, c, saturation))
    return Rgb(p.r + temperature * 0.1, p.g + tint * 0.1, p.b - temperature * 0.1)


def fx_bloom_threshold(threshold: float = 0.45) -> Rgb:
    return source().each(lambda c: F.when(dot(source(), LUMA_AP1) > threshold, c).otherwise(0.0))


def fx_anamorphic_threshold(threshold: float = 0.6) -> Rgb:
    return source().each(lambda c: F.when(F.greatest("r", "g", "b") > threshold, c).otherwise(0.0))


def watermark_diagonal_stripes(opacity: float = 0.5, spacing: int = 5, width: int = 2) -> Rgb:
    inside = (F.col("x") + F.col("y")) % spacing < min(width, spacing)
    return source().each(lambda c: F.when(inside, c * (1 - opacity * 0.35)).otherwise(c))


def pq_output(nits: float = 1000.0) -> Rgb:
    return source().each(lambda c: pq_encode(c * nits / 10000))


def masked_grade(exposure: float = 0.5, key: tuple[float, float, float] = (0.6, 0.5, 0.4), tolerance: float = 0.1, softness: float = 0.2) -> Rgb:
    """Exposure where the colour is near a key by box distance."""
    far = F.greatest(*[F.abs(c - k) for c, k in zip(source(), key)])
    mask = 1 - smoothstep(tolerance, tolerance + softness, far)
    return source().each(lambda c: mix(c, c * 2.0**exposure, mask))


POINT_KERNELS = {
    f.__name__: f
    for f in (
        exposure_adjust, contrast_adjust, cdl_correct, idt_rec709_to_acescg, idt_linear_rec709_to_acescg, aces_tonemap, fx_tonemap_aces,
        fx_color_grade_simple, fx_bloom_threshold, fx_anamorphic_threshold, watermark_diagonal_stripes, pq_output, masked_grade,
    )
}


# Generators need no input.
def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))


def _ladder(u: Column, colours, n: int) -> Rgb:
    at = F.least(F.lit(len(colours) - 1), F.floor(u * n)).cast("int")
    return Rgb(*[F.element_at(F.array(*[F.lit(c[k]) for c in colours]), at + 1) for k in range(3)])


def smpte_bars(spark: SparkSession, width: int = 64, height: int = 36) -> DataFrame:
    u, v = F.col("x") / width, F.col("y") / height
    top, middle, low = _ladder(u, BARS_TOP, 7), _ladder(u, BARS_MIDDLE, 7), _ladder(u, BARS_LOW, 6)
    out = [F.when(v < 0.67, a).when(v < 0.75, b).otherwise(c) for a, b, c in zip(top, middle, low)]
    return grid(spark, width, height).select("x", "y", *[c.alias(n) for n, c in zip("rgb", out)])


def macbeth(spark: SparkSession, width: int = 60, height: int = 40) -> DataFrame:
    u, v = F.col("x") / width * 6.0, F.col("y") / height * 4.0
    cell = F.floor(v) * 6 + F.floor(u)
    patch = _ladder(cell / 24.0 + 0.001, MACBETH, 24)
    fu, fv = u - F.floor(u), v - F.floor(v)
    border = (fu < 0.05) | (fu > 0.95) | (fv < 0.05) | (fv > 0.95)
    return grid(spark, width, height).select("x", "y", *[F.when(border, 0.02).otherwise(c).alias(n) for n, c in zip("rgb", patch)])


def zone_plate(spark: SparkSession, width: int = 64, height: int = 36, time: float = 1.5) -> DataFrame:
    import math

    u, v = (F.col("x") / width * 2 - 1) * (width / height), F.col("y") / height * 2 - 1
    c, s = math.cos(time * 0.5), math.sin(time * 0.5)
    px, py = u * c - v * s, u * s + v * c
    value = F.sin((px * px + py * py) * (50 + 40 * math.sin(time * 0.2))) * 0.5 + 0.5
    return grid(spark, width, height).select("x", "y", *[value.alias(n) for n in "rgb"])


def linear_ramp(spark: SparkSession, width: int = 64, height: int = 4) -> DataFrame:
    return grid(spark, width, height).select("x", "y", *[(F.col("x") / width * 5.0).alias(n) for n in "rgb"])


def test_color(spark: SparkSession, width: int = 64, height: int = 4) -> DataFrame:
    u = F.col("x") / width
    return grid(spark, width, height).select("x", "y", u.alias("r"), (u * 0.5).alias("g"), (1 - u).alias("b"))


_FEW_FACES = 3


def face_mask(faces: DataFrame, spark: SparkSession, width: int = 16, height: int = 9) -> DataFrame:
    """(pos, x, y, mask): the largest of soft ellipses over the faces of each sample; the grid is fixed and small."""
    one = F.array_sort(F.collect_list(F.struct("x", "y", "w", "h"))).alias("faces")
    each = faces.groupBy("pos").agg(one).crossJoin(F.broadcast(grid(spark, width, height)))

    def soft(f: Column) -> Column:
        dx = (F.col("x") / width - (f["x"] + f["w"] * 0.5)) / (f["w"] * 0.5)
        dy = (F.col("y") / height - (f["y"] + f["h"] * 0.5)) / (f["h"] * 0.5)
        return 1 - smoothstep(0.5, 1.5, dx * dx + dy * dy)

    # faces are grouped before pixels are made; the first few are plain columns, any more an array
    few = [soft(F.get("faces", F.lit(k))) for k in range(_FEW_FACES)]
    more = F.when(F.size("faces") > _FEW_FACES, F.array_max(F.transform(F.slice("faces", _FEW_FACES + 1, F.greatest(F.lit(0), F.size("faces") - _FEW_FACES)), soft)))
    there = [F.when(F.size("faces") > k, m) for k, m in enumerate(few)]
    return each.select("pos", "x", "y", F.greatest(*there, more).alias("mask"))


# Two frames, the second with channels r2, g2, b2.
def second() -> Rgb:
    return Rgb(F.col("r2"), F.col("g2"), F.col("b2"))


def crossfade(t: float = 0.3) -> Rgb:
    return Rgb(*[mix(a, b, t) for a, b in zip(source(), second())])


def alpha_blend(alpha1: float = 0.6, alpha2: float = 0.8) -> Rgb:
    return Rgb(*[a * alpha1 + b * alpha2 * (1 - alpha1) for a, b in zip(source(), second())])


def dip(p: float = 0.83, colour: tuple[float, float, float] = (0.1, 0.0, 0.2)) -> Rgb:
    t = min(1.0, max(0.0, p))
    if t < 0.5:
        return Rgb(*[mix(a, F.lit(c), t * 2) for a, c in zip(source(), colour)])
    return Rgb(*[mix(F.lit(c), b, (t - 0.5) * 2) for b, c in zip(second(), colour)])


def wipe(p: float = 0.4, direction: int = 1, width: int = 8, height: int = 8) -> Rgb:
    u, v = F.col("x") / max(1, width - 1), F.col("y") / max(1, height - 1)
    shown = {0: u <= p, 1: u >= 1 - p, 2: v <= p, 3: v >= 1 - p}.get(direction, u <= p)
    return Rgb(*[F.when(shown, b).otherwise(a) for a, b in zip(source(), second())])


def tinted_add(intensity: float = 0.4, tint: tuple[float, float, float] = (0.5, 0.8, 1.0)) -> Rgb:
    return Rgb(*[a + b * t * intensity for a, b, t in zip(source(), second(), tint)])


def halation(intensity: float = 0.4, tint: tuple[float, float, float] = (1.0, 0.4, 0.2), width: int = 8, height: int = 8) -> Rgb:
    off = F.sqrt(F.pow((F.col("x") + 0.5) / width - 0.5, 2) + F.pow((F.col("y") + 0.5) / height - 0.5, 2)) * 2
    fall = 1 - smoothstep(0.3, 1.0, off)
    return Rgb(*[a + b * t * intensity * fall for a, b, t in zip(source(), second(), tint)])


TWO_FRAME_KERNELS = {f.__name__: f for f in (crossfade, alpha_blend, dip, wipe, tinted_add, halation)}


# Stencils: taps are a short literal array, so every pixel meets only its neighbours.
def gaussian_blur(frames: DataFrame, axis: str, radius: float = 2.0, size: int = 8) -> DataFrame:
    """Blur along x or y with clamped edges; sigma is half the radius, radii under a half leave frames alone."""
    import math

    if radius < 0.5:
        return frames
    sigma, reach = max(radius / 2, 0.01), math.ceil(radius)
    taps = [(i, math.exp(-i * i / (2 * sigma * sigma))) for i in range(-reach, reach + 1)]
    total = sum(w for _, w in taps)
    # a source pixel gives to targets; at the edges it also stands for what lies outside
    tap = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w / total).alias("w")) for i, w in taps])).alias("tap")
    other = "y" if axis == "x" else "x"
    targets = frames.select("frame", "x", "y", tap).withColumn("s", F.least(F.lit(size - 1), F.greatest(F.lit(0), F.col(axis) + F.col("tap.i"))))
    neighbours = frames.select("frame", F.col(axis).alias("s"), other, "r", "g", "b")
    return targets.join(neighbours, ["frame", "s", other]).groupBy("frame", "x", "y").agg(*[F.sum(F.col("tap.w") * F.col(c)).alias(c) for c in "rgb"])


def bilinear_resize(frames: DataFrame, width: int, height: int, size: int = 8) -> DataFrame:
    """Resample every frame at pixel centres with clamped edges."""
    spark = frames.sparkSession
    sx, sy = (F.col("x") + 0.5) / width * size - 0.5, (F.col("y") + 0.5) / height * size - 0.5
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("k")
    at = grid(spark, width, height).withColumn("sx", sx).withColumn("sy", sy).select("x", "y", "sx", "sy", corner)
    clip = lambda c: F.least(F.lit(size - 1), F.greatest(F.lit(0), c)).cast("int")
    fx, fy = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    weight = F.when(F.col("k.i") == 1, fx).otherwise(1 - fx) * F.when(F.col("k.j") == 1, fy).otherwise(1 - fy)
    taps = at.select("x", "y", clip(F.floor("sx") + F.col("k.i")).alias("px"), clip(F.floor("sy") + F.col("k.j")).alias("py"), weight.alias("w"))
    p = frames.select("frame", F.col("x").alias("px"), F.col("y").alias("py"), "r", "g", "b")
    return p.join(taps, ["px", "py"]).groupBy("frame", "x", "y").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in "rgb"])
