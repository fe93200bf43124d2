"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(x: Column, digits: int) -> Column:
    """Rounds x in [0, 1] by its exact binary value, ties to even.

    round() and bround() go through the shortest decimal text of a double and so see ties where there are
    none. Scaled by 2^62 the double is a whole number, and whole numbers are compared.
    """
    one, scale = 1 << 62, 10 ** digits
    wide = "decimal(38,0)"
    n = (x * F.lit(float(one))).cast("bigint").cast(wide) * F.lit(scale).cast("decimal(7,0)")
    low = F.floor(n / F.lit(one).cast(wide)).cast("bigint")
    # the quotient has a rounded fraction, so the remainder decides on its own
    rest = (n - low.cast(wide) * F.lit(one).cast("decimal(19,0)")).cast(wide)
    low = F.when(rest < 0, low - 1).when(rest >= one, low + 1).otherwise(low)
    rest = F.when(rest < 0, rest + one).when(rest >= one, rest - one).otherwise(rest)
    up = (rest * 2 > one) | ((rest * 2 == one) & (low % 2 == 1))
    return F.when(up, low + 1).otherwise(low) / F.lit(float(scale))
