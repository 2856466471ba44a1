"""Rounding that does not depend on how a double is printed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_exact(value: Column, digits: int) -> Column:
    """Half-even rounding of the double's exact binary value.

    The value is split into a part of 24 bits and the rest, whose products
    with a small power of ten are exact, so a tie is a real tie.
    """
    scale = float(10**digits)

    def rounded(x):
        high = x.cast("float").cast("double")
        low = x - high
        below = F.floor(high * scale + low * scale).cast("double")
        beyond = (high * scale - (below + 0.5)) + low * scale
        up = (beyond > 0) | ((beyond == 0) & (below % 2 != 0))
        return (below + F.when(up, 1.0).otherwise(0.0)) / scale

    return F.transform(F.array(value.cast("double")), rounded)[0]
