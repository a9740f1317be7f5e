"""Half precision in column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format: bits of the fraction, least exponent of a normal number, and where rounding reaches infinity.
FRACTION, LEAST, OVERFLOW = 10, -14, 65520.0


def round_half(x: Column) -> Column:
    """The nearest half-precision number, ties to even; subnormal numbers keep their steps, what is too large becomes infinite."""
    size = F.abs(x)
    finite = (size > 0) & (size < float("inf"))
    guess = F.floor(F.log2(F.when(finite, size)))
    # the logarithm may be off by one beside powers of two
    exponent = guess + F.when(F.pow(F.lit(2.0), guess + 1) <= size, 1).when(F.pow(F.lit(2.0), guess) > size, -1).otherwise(0)
    step = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(LEAST)) - FRACTION)
    sign = F.when(x < 0, -1.0).otherwise(1.0)
    return F.when(~finite | F.isnan(x), x).when(size >= OVERFLOW, sign * float("inf")).otherwise(F.rint(x / step) * step)
