"""Loudness brought to a target chunk by chunk: gain, compressor and limiter over arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The targets of the loudness standards, the bounds of the gain, when a gain calls for compression, and the limiter's ceiling.
TARGETS = {"ebuR128": -23.0, "aesStreaming": -14.0}
LEAST_GAIN, MOST_GAIN, COMPRESSED_FROM, CEILING = -20.0, 12.0, 3.0, 0.98
THRESHOLD_DB, RATIO = -12.0, 3.0


def decibels(db: Column | float) -> Column:
    """The factor of a level."""
    return F.pow(F.lit(10.0), (db if isinstance(db, Column) else F.lit(db)) / 20)


def engineer_gain(measured: Column, standard: Column) -> Column:
    """The gain in decibels that brings a measured loudness to its standard's target, bounded; other standards change nothing."""
    target = measured
    for name, level in TARGETS.items():
        target = F.when(standard == name, F.lit(level)).otherwise(target)
    return F.least(F.lit(MOST_GAIN), F.greatest(F.lit(LEAST_GAIN), target - measured))


def compressed(samples: Column, threshold_db: float = THRESHOLD_DB, ratio: float = RATIO, makeup_db: float = 0.0) -> Column:
    """A hard knee: what a sample has above the threshold is divided by the ratio. A ratio under one changes nothing."""
    if not ratio >= 1:
        return samples
    threshold, makeup = 10 ** (threshold_db / 20), 10 ** (makeup_db / 20)
    size = lambda x: F.when(F.abs(x) <= threshold, F.abs(x)).otherwise(threshold + (F.abs(x) - threshold) / ratio)
    return F.transform(samples, lambda x: F.signum(x) * size(x) * makeup)


def limited(samples: Column, ceiling: float = CEILING) -> Column:
    """A whole chunk made quieter if its peak is over the ceiling."""
    peak = F.array_max(F.transform(samples, F.abs))
    scale = F.when((peak > ceiling) & (peak < float("inf")), ceiling / peak).otherwise(1.0)
    return F.transform(samples, lambda x: x * scale)


def mastered(samples: Column, gain_db: Column) -> Column:
    """Gain, then the compressor if the gain is large, then the limiter."""
    louder = F.transform(samples, lambda x: x * decibels(gain_db))
    return limited(F.when(F.abs(gain_db) >= COMPRESSED_FROM, compressed(louder)).otherwise(louder))
