"""Fixed-point numbers with 16 fractional bits, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1 << 16
MOD = 1 << 48  # ring of the masks: sums of up to 2^15 clients fit in a BIGINT


def to_int(x: Column) -> Column:
    """Towards zero; BIGINT, since 32 bits overflow on large sums."""
    return x.cast("bigint")


def to_fixed(x: Column) -> Column:
    return (x * F.lit(float(SCALE))).cast("bigint")


def unscale(x: Column) -> Column:
    return x.cast("double") / F.lit(float(SCALE))
