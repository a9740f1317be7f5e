"""Scalar functions: time, confidence, audio windows, hashes, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS = 60000

# Common frame rates as (numerator, denominator).
COMMON_RATES = ((24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (50, 1), (60000, 1001), (60, 1))


def seconds_to_ticks(s: Column) -> Column:
    """Rounded half away from zero; what isn't finite gives 0."""
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    return F.when(bad, 0).otherwise(F.round(s * TICKS).cast("long"))


def truncated_ticks(s: Column) -> Column:
    return (s * TICKS).cast("long")


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm in a bounded number of steps; longs need at most 92."""
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(F.abs(a).alias("x"), F.abs(b).alias("y")),
                       lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.when(s["y"] == 0, 0).otherwise(F.try_mod(s["x"], s["y"])).alias("y"))))
    return pair["x"]


def frame_quantise(t: Column, num: int, den: int) -> Column:
    """The time of the nearest frame at ``num/den`` frames a second."""
    return F.round(t * num / den) * den / num


def ease(t: Column, curve: str) -> Column:
    if curve == "in":
        return t * t
    if curve == "out":
        return 1 - (1 - t) * (1 - t)
    if curve == "inOut":
        return F.when(t < 0.5, t * t * 2).otherwise(1 - F.pow(t * -2 + 2, 2) / 2)
    return t


def timestamp_text(s: Column, separator: str = ".") -> Column:
    """HH:MM:SS.mmm with truncated milliseconds."""
    ms = F.floor(s * 1000).cast("long")
    part = lambda v, n: F.lpad(v.cast("string"), F.greatest(F.lit(n), F.length(v.cast("string"))), F.lit("0"))
    div = lambda n: F.floor(ms / n).cast("long")
    return F.concat(part(div(3600000), 2), F.lit(":"), part(div(60000) % 60, 2), F.lit(":"), part(div(1000) % 60, 2), F.lit(separator), part(ms % 1000, 3))


def parse_timestamp(text: Column, separator: str = ".") -> Column:
    """Seconds of HH:MM:SS with a fraction, whose digits count thousandths; anything else is null."""
    pattern = rf"^(\d+):(\d+):(\d+)[{separator}](\d+)$"
    g = lambda n: F.try_cast(F.regexp_extract(text, pattern, n), "double") if hasattr(F, "try_cast") else F.regexp_extract(text, pattern, n).try_cast("double")
    return F.when(text.rlike(pattern), g(1) * 3600 + g(2) * 60 + g(3) + g(4) / 1000)


def voicing(flatness: Column, zcr: Column, has_pitch: Column) -> Column:
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return unit((0.75 - flatness) / 0.6) * unit(1 - F.abs(zcr - 0.08) / 0.08) * F.when(has_pitch, 1.0).otherwise(0.75)


def seeded_pick(seed: Column, salt: str, n: int) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(seed, F.lit("|" + salt)), 256), 1, 8), 16, 10).cast("long") % n


def average_hash(luma: Column) -> Column:
    """Bit i is set where luma[i] is at least the whole-number mean of 64."""
    mean = F.floor(F.aggregate(luma, F.lit(0).cast("long"), lambda a, v: a + v) / 64)
    bits = F.transform(luma, lambda v, i: F.when(v >= mean, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Zero where lengths differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-6)).otherwise(0.0)


def deterministic_uuid(key: Column) -> Column:
    """The first half of a SHA-256 with version 5 and variant bits, in upper case."""
    h = F.sha2(key, 256)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.upper(F.concat_ws("-", *parts))


def clauses(text: Column) -> Column:
    """What stands between the word ``then``, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(text, r"(?i)\bthen\b"), lambda c: F.trim(c)), lambda c: c != "")


def redact(text: Column) -> Column:
    out = F.regexp_replace(text, r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>")
    return F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>")


def fourcc(code: Column) -> Column:
    return F.concat(*[F.chr(F.shiftright(code, s).bitwiseAND(F.lit(255))) for s in (24, 16, 8, 0)])
