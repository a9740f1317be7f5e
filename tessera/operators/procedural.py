"""Noise fields and what is drawn from them: stars, film grain, light leaks; and remaps of a frame by position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.effects import _sampled
from tessera.operators.pixels import LUMA_AP1, clamp, dot, grid, mix, smoothstep, source

_WORD = (1 << 32) - 1
# A 32-bit mixer's shifts and factors, and the factors and increments of two sequences.
MIXER = ((17, 0xED5AD4BB), (11, 0xAC4C1B51), (15, 0x31848BAB), (14, 1))
SEEDS = ((1664525, 1013904223), (22695477, 1))
# Skew and unskew of the triangle grid.
SKEW, UNSKEW = 0.366025403784439, 0.211324865405187


def times32(x: Column, factor: int) -> Column:
    """x * factor in 32 bits, for a long x under 2**32; halves keep the product within a long."""
    low, high = x.bitwiseAND(0xFFFF) * factor, (F.shiftright(x, 16) * factor).bitwiseAND(0xFFFF)
    return (low + high * 65536).bitwiseAND(_WORD)


def hash_unit(frames: DataFrame, seed: Column, name: str) -> DataFrame:
    """Add ``name``: a number in [0, 1) from a 32-bit seed."""
    q = frames.withColumn(name, seed)
    for shift, factor in MIXER:
        q = q.withColumn(name, times32(F.col(name).bitwiseXOR(F.shiftright(name, shift)), factor))
    return q.withColumn(name, F.col(name).bitwiseAND(0xFFFFFF) / float(1 << 24))


def starfield(spark: SparkSession, width: int = 256, height: int = 144) -> DataFrame:
    """Sparse stars on a faint gradient; a pixel's place alone decides."""
    q = grid(spark, width, height).withColumn("at", F.col("y").cast("long") * width + F.col("x"))
    for (factor, more), name in zip(SEEDS, ("r0", "r1")):
        q = hash_unit(q, (times32(F.col("at"), factor) + more).bitwiseAND(_WORD), name)
    u, v = (F.col("x") + 0.5) / width, (F.col("y") + 0.5) / height
    chance = (F.sin(u * 17.0) * 0.5 + 0.5) * 0.00030 + 0.00045
    star = F.when(F.col("r0") < chance, F.pow(F.greatest(1 - F.col("r1"), F.lit(1e-6)), 6.0) * 0.92 + 0.08).otherwise(0.0)
    value = (1 - v) * 0.004 + 0.002 + star
    return q.select("x", "y", *[value.alias(c) for c in "rgb"])


def fraction(x: Column) -> Column:
    return x - F.floor(x)


def place_noise(frames: DataFrame, px: Column, py: Column, name: str) -> DataFrame:
    """Add ``name``: a number in [0, 1) that jumps from place to place; its numbers are fixed values."""
    q = frames.withColumns({"n0": fraction(px * 0.1031), "n1": fraction(py * 0.1031)})
    lift = F.col("n0") * (F.col("n1") + 33.33) + F.col("n1") * (F.col("n0") + 33.33) + F.col("n0") * (F.col("n0") + 33.33)
    q = q.withColumn("n2", lift)
    return q.withColumn(name, fraction((F.col("n0") + F.col("n1") + F.col("n2") * 2) * (F.col("n0") + F.col("n2")))).drop("n0", "n1", "n2")


def film_grain(frames: DataFrame, time: float = 0.5, intensity: float = 0.2, size: float = 1.3, shadows: float = 2.0) -> DataFrame:
    """Normal noise by pixel and time, stronger in shadows and weaker in highlights."""
    scale = max(0.1, size)
    px, py = F.col("x") / scale + time * 100.0, F.col("y") / scale + time * 200.0
    q = place_noise(place_noise(frames, px, py, "u1"), px + 1000.0, py + 1000.0, "u2")
    q = q.withColumn("normal", F.sqrt(F.log(clamp(F.col("u1"), 0.00001, 0.99999)) * -2) * F.cos(F.col("u2") * (2 * math.pi)))
    q = q.withColumn("luma", dot(source(), LUMA_AP1))
    weight = (1 - smoothstep(0.7, 1.0, F.col("luma")) * 0.7) * ((1 - smoothstep(0.0, 0.5, F.col("luma"))) * (shadows - 1) + 1)
    q = q.withColumn("grain", clamp(F.col("normal") * min(1.0, max(0.0, intensity)) * weight, -0.5, 0.5))
    return q.withColumns({c: F.col(c) + F.col("grain") for c in "rgb"}).drop("u1", "u2", "normal", "luma", "grain")


def simplex(frames: DataFrame, px: Column, py: Column, name: str) -> DataFrame:
    """Add ``name``: smooth noise of about -1 to 1 on a grid of triangles; its numbers are fixed values."""
    q = frames.withColumns({"px": px, "py": py}).withColumn("lean", (F.col("px") + F.col("py")) * SKEW)
    q = q.withColumns({"i": F.floor(F.col("px") + F.col("lean")).cast("double"), "j": F.floor(F.col("py") + F.col("lean")).cast("double")})
    q = q.withColumn("back", (F.col("i") + F.col("j")) * UNSKEW)
    q = q.withColumns({"x0": F.col("px") - F.col("i") + F.col("back"), "y0": F.col("py") - F.col("j") + F.col("back")})
    first = F.when(F.col("x0") > F.col("y0"), 1.0).otherwise(0.0)
    q = q.withColumns({"di1": first, "dj1": 1 - first})
    wrap = lambda c: c - F.floor(c / 289.0) * 289.0
    turn = lambda c: wrap((c * 34.0 + 1.0) * c)
    q = q.withColumns({"i": wrap(F.col("i")), "j": wrap(F.col("j"))})
    total = F.lit(0.0)
    for n, (di, dj) in enumerate(((F.lit(0.0), F.lit(0.0)), (F.col("di1"), F.col("dj1")), (F.lit(1.0), F.lit(1.0)))):
        q = q.withColumns({f"x{n}": F.col("x0") - di + n * UNSKEW, f"y{n}": F.col("y0") - dj + n * UNSKEW, f"p{n}": turn(F.col("j") + dj)})
        q = q.withColumn(f"p{n}", turn(F.col(f"p{n}") + F.col("i") + di)).withColumn(f"a{n}", fraction(F.col(f"p{n}") / 41.0) * 2 - 1)
        q = q.withColumn(f"h{n}", F.abs(F.col(f"a{n}")) - 0.5).withColumn(f"a{n}", F.col(f"a{n}") - F.floor(F.col(f"a{n}") + 0.5))
        x, y, a, h = (F.col(f"{c}{n}") for c in "xyah")
        near = F.pow(F.greatest(0.5 - (x * x + y * y), F.lit(0.0)), 4)
        total = total + near * (1.79284291400159 - (a * a + h * h) * 0.85373472095314) * (a * x + h * y)
    return q.withColumn(name, total * 130.0).select(*frames.columns, name)


def light_leak(frames: DataFrame, intensity: float = 0.6, tint: tuple[float, float, float] = (1.0, 0.5, 0.2), place: tuple[float, float] = (0.2, 0.3), size: float = 0.5, softness: float = 0.4, angle: float = 0.7, time: float = 0.3, width: int = 8, height: int = 8) -> DataFrame:
    """A turned, stretched glow with a noisy edge, added with a tint."""
    if intensity <= 0:
        return frames
    dx, dy = F.col("x") / width - place[0], F.col("y") / height - place[1]
    c, s = math.cos(angle), math.sin(angle)
    # the rotation is given by columns
    q = frames.withColumns({"lx": dx * c + dy * s + math.sin(time * 6.28318) * 0.1 * 0.05, "ly": dx * -s + dy * c})
    q = simplex(q, F.col("lx") * 3.0 + time, F.col("ly") * 3.0 + time, "noise")
    far = F.sqrt(F.pow(F.col("lx") / (size * 1.5), 2) + F.pow(F.col("ly") / size, 2)) + F.col("noise") * 0.3
    q = q.withColumn("leak", (1 - smoothstep(0.0, 1.0 + softness, far)) * intensity)
    return q.withColumns({k: F.col(k) + F.col("leak") * t for k, t in zip("rgb", tint)}).drop("lx", "ly", "noise", "leak")


def dispersion(frames: DataFrame, intensity: float = 0.8, spread: float = 900.0, center: tuple[float, float] = (0.5, 0.5), falloff: float = 1.2, angle: float = 0.0, width: int = 8, height: int = 8) -> DataFrame:
    """Red and blue read from the pixel that lies apart from the centre, or along an angle, in either direction."""
    if intensity <= 0:
        return frames
    u, v = F.col("x") / width, F.col("y") / height
    dx, dy = u - center[0], v - center[1]
    amount = F.pow(F.sqrt(dx * dx + dy * dy), falloff) * intensity * (spread * (height / 1080.0) / height)
    if angle == 0:
        length = F.sqrt(F.pow(dx + 0.0001, 2) + F.pow(dy + 0.0001, 2))
        ux, uy = (dx + 0.0001) / length, (dy + 0.0001) / length
    else:
        ux, uy = F.lit(math.cos(angle)), F.lit(math.sin(angle))
    inside = lambda at, n: F.least(F.lit(n - 1.0), F.greatest(F.lit(0.0), at * n)).cast("int")
    out = frames
    for c, side in (("r", -1), ("b", 1)):
        reads = frames.select("frame", "x", "y", inside(u + ux * amount * side, width).alias("px"), inside(v + uy * amount * side, height).alias("py"))
        other = frames.select("frame", F.col("x").alias("px"), F.col("y").alias("py"), F.col(c).alias(c + "_far"))
        out = out.join(reads.join(other, ["frame", "px", "py"]).select("frame", "x", "y", c + "_far"), ["frame", "x", "y"])
    return out.select("frame", "x", "y", mix(F.col("r"), F.col("r_far"), intensity).alias("r"), "g", mix(F.col("b"), F.col("b_far"), intensity).alias("b"))


def remapped(frames: DataFrame, reads: dict[str, tuple[Column, Column]], *, black: Column | None = None, width: int = 8, height: int = 8) -> DataFrame:
    """Every channel read bilinearly at its own (u, v), given by (x, y, cx, cy, r2) of the pixel; black where told."""
    at = grid(frames.sparkSession, width, height).withColumn("cx", F.col("x") / width - 0.5).withColumn("cy", F.col("y") / height - 0.5)
    at = at.withColumn("r2", F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"))
    out = None
    for c, (u, v) in reads.items():
        one = _sampled(frames, at.select("x", "y", u.alias("u"), v.alias("v")), c, width, height)
        out = one if out is None else out.join(one, ["frame", "x", "y"])
    if black is None:
        return out
    return out.join(at.select("x", "y", black.alias("black")), ["x", "y"]).select("frame", "x", "y", *[F.when(F.col("black"), 0.0).otherwise(F.col(c)).alias(c) for c in reads])


def radial_distortion(frames: DataFrame, k1: float = 0.3, k2: float = -0.9) -> DataFrame:
    """Lens distortion without colour; what comes from outside is black."""
    scale = 1 - F.col("r2") * k1 - F.col("r2") * F.col("r2") * k2
    u, v = F.col("cx") * scale + 0.5, F.col("cy") * scale + 0.5
    return remapped(frames, {c: (u, v) for c in "rgb"}, black=(u < 0) | (u > 1) | (v < 0) | (v > 1))


def colour_fringes(frames: DataFrame, intensity: float = 0.4) -> DataFrame:
    """Red drawn in and blue pushed out with the square of the distance."""
    at = lambda side: tuple(F.col(c) * (F.col("r2") * (side * intensity) + 1) + 0.5 for c in ("cx", "cy"))
    return remapped(frames, {"r": at(-1), "g": at(0), "b": at(1)})


def polygon_mask(spark: SparkSession, corners: list[tuple[float, float]], width: int = 24, height: int = 16) -> DataFrame:
    """(x, y, mask): 255 where a pixel's centre is inside a polygon of the unit square, by the even-odd rule."""
    px, py = (F.col("x") + 0.5) / width, (F.col("y") + 0.5) / height
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        if ay != by:
            meets = ((F.lit(ay) > py) != (F.lit(by) > py)) & (px < (py - ay) * ((bx - ax) / (by - ay)) + ax)
            crossings = crossings + meets.cast("int")
    return grid(spark, width, height).withColumn("mask", F.when(crossings % 2 == 1, 255).otherwise(0))


